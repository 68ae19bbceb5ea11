"""Clustering around centroids (Lloyd's rounds) in whole numbers, each assignment by annulus search.

The centroids are sorted by norm. The distance of a vector to some of them, spread over that order, is an upper bound of its distance to the nearest; since two points are never nearer than their
norms are, only centroids whose norm is within that bound of the vector's own can be as near. Binary search finds where this annulus begins and ends, and the centroids in it are
compared exactly: distances are whole numbers, and of equal ones the smaller number wins. The annulus is widened by more than a square root can be off, so that ties on its edge are inside.

The vectors stay where they are: a round reads them once, each task adds up its own by cluster, and only sums by cluster are shuffled and reach the driver, as many as there are centroids.
"""

from __future__ import annotations

import decimal
import hashlib
import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut

COMPONENTS, CENTROIDS, ROUNDS, SEED, SCALE = 64, 8, 10, 3, 1024
#: Below these sizes of components distances are exact in doubles and in 64-bit integers; beyond, Python's integers are taken.
IN_DOUBLE, IN_LONG = 1 << 21, 1 << 27
#: A vector with a component of this size, scaled, isn't kept: it has no place in a long.
BEYOND = 1 << 62
#: By how much of the norms a bound is widened.
SLACK = 1e-9


def kept(vector: Column, components: int = COMPONENTS) -> Column:
    """Whether vector has that many components, all of them finite numbers with a place in a long."""
    number = lambda x: F.coalesce(F.abs(x) < float(BEYOND // SCALE), F.lit(False))
    return F.coalesce((F.size(vector) == components) & F.forall(vector, number), F.lit(False))


def whole(vectors: pa.Array, components: int = COMPONENTS) -> np.ndarray:
    """floor(SCALE * x) of each component of kept vectors, one row for each."""
    x = pc.cast(vectors.flatten(), pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, components)
    return np.floor(SCALE * x).astype(np.int64)


class Annuli:
    """Centroids by norm, to find the nearest of."""

    def __init__(self, centroids: list[list[int]]):
        self.centroids = sorted(enumerate(centroids), key=lambda x: (sum(v * v for v in x[1]), x[0]))
        self.norms = np.array([math.sqrt(sum(v * v for v in c)) for _, c in self.centroids])
        self.largest = max((abs(v) for c in centroids for v in c), default=0)
        k = len(centroids)
        self.probes = sorted({i * (k - 1) // max(1, math.isqrt(k)) for i in range(math.isqrt(k) + 1)}) if k else []

    def annulus(self, norm: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Where the centroids begin and end, by norm, that can be within bound of vectors of these norms."""
        reach = bound + SLACK * (norm + bound + 1)
        return np.searchsorted(self.norms, norm - reach, "left"), np.searchsorted(self.norms, norm + reach, "right")

    def nearest(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each row of x the number of its centroid and the squared distance."""
        largest = max(self.largest, int(np.abs(x).max(initial=0)))
        kind = np.float64 if largest < IN_DOUBLE else np.int64 if largest < IN_LONG else object
        x, c = x.astype(kind), np.array([v for _, v in self.centroids], dtype=object).astype(kind)
        own, theirs = (x * x).sum(1), (c * c).sum(1)
        bound = np.sqrt((own[:, None] + theirs[self.probes] - 2 * (x @ c[self.probes].T)).min(1).astype(np.float64))
        first, end = self.annulus(np.sqrt(own.astype(np.float64)), bound)
        number = np.full(len(x), len(c))
        least = np.full(len(x), -1, kind)
        for i, (j, _) in enumerate(self.centroids):
            rows = np.flatnonzero((first <= i) & (i < end))
            d = own[rows] + theirs[i] - 2 * (x[rows] @ c[i])
            better = (least[rows] < 0) | (d < least[rows]) | ((d == least[rows]) & (j < number[rows]))
            number[rows[better]], least[rows[better]] = j, d[better]
        return number, least if kind is object else least.astype(np.int64)


def start(vectors: DataFrame, k: int = CENTROIDS, seed: int = SEED) -> list[list[int]]:
    """The k kept vectors with the smallest digests of seed and vec_id; each task sends its k smallest only."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")).cast("binary"), 256)
    rows = vectors.select(digest.alias("_digest"), F.col("embedding").cast("array<double>").alias("embedding")).orderBy(F.asc_nulls_last("_digest"), "embedding").limit(k).collect()
    return [[math.floor(SCALE * x) for x in r["embedding"]] for r in rows]


def cluster_sums(vectors: DataFrame, centroids: list[list[int]]) -> list[tuple[int, list[int]]]:
    """For each centroid the number of its vectors and their sum, component by component."""
    k, components = len(centroids), len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        count, total = np.zeros(k, np.int64), np.zeros((k, components), object)
        for batch in batches:
            x = whole(batch.column(0), components)
            number, _ = annuli.nearest(x)
            if np.abs(x).max(initial=0) >= 1 << 40:
                x = x.astype(object)
            for j in np.unique(number).tolist():
                rows = x[number == j]
                count[j] += len(rows)
                total[j] += rows.sum(0).astype(object)
        exact = pa.array([[decimal.Decimal(v) for v in row] for row in total], pa.list_(pa.decimal128(38, 0)))
        yield pa.RecordBatch.from_arrays([pa.array(range(k), pa.int32()), pa.array(count), exact], names=["cluster", "n", "total"])

    sums = vectors.select("embedding").mapInArrow(run, "cluster int, n long, total array<decimal(38,0)>").where("n > 0")
    rows = sums.select("cluster", "n", F.posexplode("total").alias("i", "v")).groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()
    out: list[tuple[int, list[int]]] = [(0, [0] * components) for _ in range(k)]
    for r in rows:
        out[r["cluster"]] = (r["n"], out[r["cluster"]][1])
        out[r["cluster"]][1][r["i"]] = int(r["v"])
    return out


def assigned(vectors: DataFrame, centroids: list[list[int]]) -> DataFrame:
    """vec_id, cluster and distance (squared; null where a long can't hold it) for each row of vectors."""
    components = len(centroids[0])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        annuli = Annuli(centroids)
        for batch in batches:
            number, least = annuli.nearest(whole(batch.column(1), components))
            fits = [v if v < 1 << 63 else None for v in least.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(number, pa.int32()), pa.array(fits, pa.int64())], names=["vec_id", "cluster", "distance"])

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, cluster int, distance long")


def clusters(vectors: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, components: int = COMPONENTS, progress: Callable[[int], None] | None = None) -> DataFrame:
    """vec_id, cluster, distance, cluster_inertia, inertia and centroid_sha256 for each vector kept.

    Kept are vectors with that many components, none of them null, infinite, not a number or of 2^52 and more in size. Fewer than k kept vectors are a centroid each. Vectors that repeat count as
    often and may both become centroids, of which the smaller number wins; ties of vec_id are put in order by the vectors; null vec_ids come last and stay null. Where no vector is kept, and for an empty
    table, there are no rows. A distance or sum that a long can't hold is null. Other columns don't matter. progress is told the number of each round that is done.
    """
    spark = vectors.sparkSession
    vectors = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").alias("embedding")).where(kept(F.col("embedding"), components))
    centroids = start(vectors, k)
    columns = ["vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"]
    if not centroids:
        return spark.createDataFrame([], "vec_id long, cluster int, distance long, cluster_inertia long, inertia long, centroid_sha256 string").select(*columns)
    for i in range(rounds):
        sums = cluster_sums(vectors, centroids)
        centroids = [[v // n for v in total] if n else old for (n, total), old in zip(sums, centroids, strict=True)]
        if progress:
            progress(i)
    rows = cut(assigned(vectors, centroids))
    by = rows.groupBy("cluster").agg(F.sum(F.col("distance").cast("decimal(38,0)")).alias("total"), F.min(F.col("distance").isNotNull()).alias("known")).collect()  # one for each centroid
    whole_sums = {r["cluster"]: int(r["total"]) if r["known"] and r["total"] < 1 << 63 else None for r in by}
    total = None if None in whole_sums.values() or sum(whole_sums.values()) >= 1 << 63 else sum(whole_sums.values())
    digests = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    told = spark.createDataFrame([(j, whole_sums.get(j), total, x) for j, x in enumerate(digests)], "cluster int, cluster_inertia long, inertia long, centroid_sha256 string")
    return rows.join(F.broadcast(told), "cluster").select(*columns)  # told has a row for each centroid
