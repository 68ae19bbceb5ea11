"""SimHash near-duplicates, found by the general pigeonhole principle.

The 64 bits are grouped into m parts, correlated bits together. If two fingerprints differ in at most k bits, then for thresholds
t of the parts with sum k - m + 1 there is a part in which they differ in at most its t bits (-1: the part is left out). A part with threshold t is
probed with all values within t bits. For each m a dynamic program deals out the thresholds so that the estimated rows probed and candidates
compared cost least; the estimates use histograms and bit counts over all fingerprints. The cheapest m is taken.
All this concerns speed alone: any allocation finds every pair. Equal fingerprints are one before any pair is looked for.

Only components matter, so buckets (a part with a value) are worked off by contraction. First the rows of a bucket meet some pivots of it, and what
links is joined; so a dense group becomes one component by some links a row. Then the probes of rows outside a bucket's largest component meet all its rows,
and the probes of rows inside it meet the rows outside: pairs within the largest component are never looked at, and no link between two components is lost.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup
from .graph import components

WORDS, BITS, SEED = 4, 4, 42
#: What a row probed and a candidate compared cost, in microseconds.
PROBE_COST, CANDIDATE_COST = 2.0, 0.05
BLOCK = 1 << 16
#: Pivots of a bucket.
PIVOTS = 6


def hashes(text: str, words: int = WORDS) -> np.ndarray:
    """XXH64 of each shingle of whole words, A-Z lower-cased; of the whole sequence if it is shorter, of nothing if there is no word."""
    found = text.encode().lower().split()  # of bytes: A-Z alone, and white space is \x20 and \x09-\x0D
    if not found:
        return np.empty(0, np.uint64)
    joined, digest = b" ".join(found), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, found), np.int64, len(found)) + 1) - 1
    starts = np.concatenate(([0], ends[:-1] + 1))
    n = max(1, len(found) - words + 1)
    last = ends[words - 1 :] if len(found) >= words else ends[-1:]
    return np.array([digest(joined[a:b], SEED) for a, b in zip(starts[:n].tolist(), last.tolist(), strict=True)], np.uint64)


def fingerprint(h: np.ndarray) -> int:
    """A bit is 1 if it is set in over half of h; 0 for no h. Signed, as Spark's long."""
    if not len(h):
        return 0
    counts = np.zeros(64, np.int64)
    for i in range(0, len(h), BLOCK):
        counts += np.unpackbits(h[i : i + BLOCK].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits(2 * counts > len(h), bitorder="little").view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = WORDS) -> DataFrame:
    """doc_id and fp for each row of docs."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [fingerprint(hashes(x.as_py() or "", words)) for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


@dataclass
class Part:
    bits: list[int]
    threshold: int = -1

    @property
    def mask(self) -> int:
        return sum(1 << b for b in self.bits)

    def value(self, fp: Column) -> Column:
        """The part's bits of fp, side by side."""
        out = F.lit(0).cast("long")
        for j, b in enumerate(self.bits):
            out = out.bitwiseOR(F.shiftleft(F.shiftrightunsigned(fp, b).bitwiseAND(F.lit(1).cast("long")), j))
        return out

    def ball(self) -> list[int]:
        """What to XOR a value with to get all values within the threshold."""
        return [sum(1 << i for i in c) for t in range(self.threshold + 1) for c in combinations(range(len(self.bits)), t)]


def ball_size(width: int, t: int) -> int:
    return sum(math.comb(width, i) for i in range(t + 1))


def bit_counts(fps: DataFrame) -> tuple[int, np.ndarray]:
    """Over all fingerprints: their number, and in how many of them two bits are both set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        both, n = np.zeros((64, 64), np.int64), 0
        for batch in batches:
            n += len(batch)
            x = np.unpackbits(np.asarray(batch.column(0)).astype("<i8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.float32)
            both += (x.T @ x).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(range(4097), pa.int32()), pa.array([*both.ravel().tolist(), n])], names=["i", "n"])

    rows = fps.select("fp").mapInArrow(run, "i int, n long").groupBy("i").agg(F.sum("n").alias("n")).collect()  # 4097 sums
    both = np.zeros(4097, np.int64)
    for i, n in rows:
        both[i] = n
    return int(both[4096]), both[:4096].reshape(64, 64)


def grouped(n: int, both: np.ndarray, m: int) -> list[Part]:
    """m parts of near equal width; each begins with the free bit most correlated with the others and takes those most correlated with its own."""
    p = np.diag(both) / n
    cov = both / n - np.outer(p, p)
    sd = np.sqrt(np.maximum(np.diag(cov), 1e-9))
    close = np.abs(cov / np.outer(sd, sd))
    np.fill_diagonal(close, 0)
    free, parts = list(range(64)), []
    for i in range(m):
        own = [max(free, key=lambda b: (close[b, free].sum(), -b))]
        free.remove(own[0])
        while len(own) < 64 // m + (i < 64 % m):
            own.append(max(free, key=lambda b: (close[b, own].sum(), -b)))
            free.remove(own[-1])
        parts.append(Part(sorted(own)))
    return parts


def within(q: np.ndarray, t: int) -> float:
    """How many times more likely it is that a pair differs in at most t of the bits than in none, where they differ with chances q."""
    chance = np.zeros(len(q) + 1)
    chance[0] = 1
    for x in q:
        chance[1:] = chance[1:] * (1 - x) + chance[:-1] * x
        chance[0] *= 1 - x
    return float(chance[: t + 1].sum() / max(chance[0], 1e-300))


def allocate(n: int, parts: list[Part], same: list[float], q: np.ndarray, k: int) -> float:
    """Sets the parts' thresholds to the least estimated cost and returns it. same: pairs that agree in the whole part."""
    need = k - len(parts) + 1
    best: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}  # by sum of t + 1
    for part, pairs in zip(parts, same, strict=True):
        costs = [0.0]
        for t in range(min(k, len(part.bits)) + 1):
            costs.append(PROBE_COST * n * (1 + ball_size(len(part.bits), t)) + CANDIDATE_COST * pairs * within(q[part.bits], t))
        further: dict[int, tuple[float, list[int]]] = {}
        for total, (cost, chosen) in best.items():
            for t, more in enumerate(costs, -1):
                if total + t + 1 <= need + len(parts) and ((total + t + 1) not in further or cost + more < further[total + t + 1][0]):
                    further[total + t + 1] = (cost + more, [*chosen, t])
        best = further
    cost, chosen = best[need + len(parts)]
    for part, t in zip(parts, chosen, strict=True):
        part.threshold = t
    return cost


def plan(fps: DataFrame, k: int) -> list[Part]:
    n, both = bit_counts(fps)
    if not n:
        return []
    p = np.diag(both) / n
    q = 2 * p * (1 - p)
    tried = []
    for m in range(2, min(k + 1, 8) + 1):
        parts = grouped(n, both, m)
        tried.append((allocate(n, parts, [n * n / 2 * float(np.prod(1 - q[x.bits])) for x in parts], q, k), m, parts))
    tried = sorted(tried, key=lambda x: x[:2])[:2]  # the histograms decide between the best two
    every = [(i, j, part) for i, (_, _, parts) in enumerate(tried) for j, part in enumerate(parts)]
    values = fps.select(F.explode(F.array(*(F.struct(F.lit(f"{i} {j}").alias("part"), x.value(F.col("fp")).alias("value")) for i, j, x in every))).alias("x"))
    counted = values.groupBy("x.part", "x.value").count()
    same = {r[0]: r[1] for r in counted.groupBy("part").agg(F.sum(F.col("count").cast("double") * (F.col("count") - 1) / 2)).collect()}
    costs = [(allocate(n, parts, [same[f"{i} {j}"] for j in range(len(parts))], q, k), i) for i, (_, _, parts) in enumerate(tried)]
    return tried[min(costs)[1]][2]


def buckets(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """nodes (fp, root), once for each part, with part and value."""
    keys = F.array(*(F.struct(F.lit(i).alias("part"), x.value(F.col("fp")).alias("value")) for i, x in enumerate(parts)))
    return nodes.select("fp", "root", F.explode(keys).alias("x")).select("fp", "root", "x.part", "x.value")


def probes(nodes: DataFrame, parts: list[Part]) -> DataFrame:
    """nodes (fp, root), once for each part and value within the part's threshold."""

    def ball(i: int, part: Part) -> Column:
        value = part.value(F.col("fp"))
        return F.transform(F.array(*(F.lit(m).cast("long") for m in part.ball())), lambda m: F.struct(F.lit(i).alias("part"), value.bitwiseXOR(m).alias("value")))

    keys = F.concat(*(ball(i, x) for i, x in enumerate(parts)))
    return nodes.select("fp", "root", F.explode(keys).alias("x")).select("fp", "root", "x.part", "x.value")


def largest_roots(held: DataFrame) -> DataFrame:
    """part, value and top, the root that most rows of the bucket have."""
    counted = held.groupBy("part", "value", "root").agg(F.count("*").alias("n"))
    return counted.groupBy("part", "value").agg(F.max(F.struct("n", "root")).alias("x")).select("part", "value", F.col("x.root").alias("top"))


def link_roots(fps: DataFrame, k: int) -> DataFrame:
    """fp and root, the least fingerprint that links of at most k differing bits lead to, for each of the distinct fingerprints fps."""
    parts = [x for x in plan(fps, k) if x.threshold >= 0]
    nodes = fps.select("fp", F.col("fp").alias("root"))
    if not parts:
        return nodes
    close = lambda a, b: F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= k
    by = ["part", "value"]
    held = buckets(nodes, parts)
    order = [F.min_by("fp", F.xxhash64("fp", F.lit(j))) for j in range(PIVOTS)]
    pivots = held.groupBy(*by).agg(F.array_distinct(F.array(*order)).alias("pivots"), F.count("*").alias("n")).where("n > 1")
    met = held.join(pivots, by).select("fp", F.explode("pivots").alias("pivot")).where((F.col("fp") != F.col("pivot")) & close("fp", "pivot"))
    nodes = rooted(fps, met.select(F.least("fp", "pivot").alias("a"), F.greatest("fp", "pivot").alias("b")).distinct())
    held = buckets(nodes, parts)
    tops = largest_roots(held)
    asking = probes(nodes, parts).join(tops, by).select(F.col("fp").alias("a"), F.col("root").alias("roota"), *by, (F.col("root") == F.col("top")).alias("inside"))
    asked = held.join(tops, by).withColumn("inside", F.explode(F.when(F.col("root") == F.col("top"), F.array(F.lit(False))).otherwise(F.array(F.lit(False), F.lit(True)))))
    found = asking.join(asked.select(F.col("fp").alias("b"), F.col("root").alias("rootb"), *by, "inside"), [*by, "inside"]).where((F.col("roota") != F.col("rootb")) & close("a", "b"))
    more = found.select(F.least("roota", "rootb").alias("a"), F.greatest("roota", "rootb").alias("b")).distinct()
    far = components(more).select(F.col("node").alias("root"), F.col("root").alias("_far"))
    return lookup(nodes, far, ["root"], F.col("fp")).select("fp", F.coalesce("_far", "root").alias("root"))


def rooted(fps: DataFrame, links: DataFrame) -> DataFrame:
    roots = components(links).withColumnRenamed("node", "fp")
    return cut(fps.join(roots, "fp", "left").select("fp", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame, words: int = WORDS, bits: int = BITS) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id for each row of docs.

    component_id is the least doc_id that links of at most bits differing bits lead to. A null text counts as empty; texts without a word have fingerprint zero and link like any
    other; null doc_ids are left out of the least one, which is null where all are. Whole texts count, however long. Rows that repeat, and ties, are in one component. An empty
    table gives no rows; other columns don't matter.
    """
    rows = cut(fingerprints(docs, words))
    distinct = cut(rows.groupBy("fp").agg(F.min("doc_id").alias("least")))
    roots = cut(link_roots(distinct.select("fp"), bits))
    known = distinct.join(roots, "fp")
    least = known.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = cut(lookup(known.select("fp", "root"), least, ["root"], F.col("fp")).drop("root"))
    return lookup(rows, by_fp, ["fp"], F.col("doc_id")).select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
