"""Connected components of a table of links: forests within blocks of links, then alternating large and small stars between the blocks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import cut, lookup

#: So many links (two numbers each) make up a block, which one task turns into a forest.
BLOCK = 1 << 18


def _state(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())


def roots_of(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The nodes of the links (a, b), and the least node of each one's component."""
    nodes, place = np.unique(np.concatenate([a, b]), return_inverse=True)
    one, two = place[: len(a)], place[len(a) :]
    root = np.arange(len(nodes))
    while len(one):
        np.minimum.at(root, np.maximum(one, two), np.minimum(one, two))  # one and two are roots here: each hangs on its least neighbour
        while not np.array_equal(up := root[root], root):
            root = up
        one, two = root[one], root[two]
        one, two = one[one != two], two[one != two]
    return nodes, nodes[root]


def forests(links: DataFrame, blocks: int, size: int) -> DataFrame:
    """node and root, the least node that the links of a block lead to, for each block (of size links, or a task's last) and node of it. In one block these are the components."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        for batch in batches:
            held.append(np.stack([np.asarray(batch.column(i)) for i in (0, 1)]))
            if sum(x.shape[1] for x in held) > size:
                yield made(held)
                held = []
        if held:
            yield made(held)

    def made(held: list[np.ndarray]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x) for x in roots_of(*np.concatenate(held, axis=1))], names=["node", "root"])

    return links.select("a", "b").coalesce(blocks).mapInArrow(run, "node long, root long")


def components(links: DataFrame, size: int = BLOCK) -> DataFrame:
    """node and root (the least node of its component) for each node of links (a, b); no links, no rows.

    Each block of links becomes a forest in its task. So few links as fit in one block need nothing more. Else what is left of all blocks goes on by stars:
    first each node keeps its link to its least neighbour alone, a forest with a link a node at most, whose components become nodes of their own. Between
    those the other links stand once, so however many links a dense group has, the further rounds see few.
    """
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b"))
    n = links.count()
    if n > size:
        links = cut(forests(links, -(-n // size), size).where("root < node").select(F.col("root").alias("a"), F.col("node").alias("b")).distinct())
        n = links.count()
    if n <= size:
        return forests(links, 1, size)
    both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    near = cut(stars(both.groupBy("a").agg(F.min("b").alias("b"))))
    low = near.select(F.col("node").alias("low"), F.col("root").alias("a"))
    high = near.select(F.col("node").alias("high"), F.col("root").alias("b"))
    named = links.select(F.col("a").alias("low"), F.col("b").alias("high"))
    between = lookup(cut(lookup(named, low, ["low"], F.col("high"))), high, ["high"], F.col("low")).select("a", "b").where("a <> b")
    far = stars(between).select(F.col("node").alias("root"), F.col("root").alias("_far"))
    return lookup(near, far, ["root"], F.col("node")).select("node", F.coalesce("_far", "root").alias("root"))


def stars(links: DataFrame) -> DataFrame:
    """The same by stars alone. In a large star each node hangs its larger neighbours on its least one, in a small star its smaller ones. Rounds go on until nothing
    changes; each is held in the shared folder. A node's least neighbour reaches its links by way of runs, so that no task gets all links of a hub.
    """
    links = cut(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a < b").distinct())
    before = _state(links)
    while before[0]:
        both = links.union(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        larger = lookup(both.where("b > a"), least, ["a"], F.col("b"))
        links = larger.select(F.col("m").alias("a"), "b").where("a < b").distinct()
        least = links.groupBy("b").agg(F.min("a").alias("m"))
        smaller = lookup(links, least, ["b"], F.col("a"))
        links = smaller.select(F.explode(F.array(F.struct("a", "m"), F.struct(F.col("b").alias("a"), "m"))).alias("x"))
        links = cut(links.select(F.col("x.m").alias("a"), F.col("x.a").alias("b")).where("a < b").distinct())
        after = _state(links)
        if after == before:
            break
        before = after
    roots = links.select(F.col("b").alias("node"), F.col("a").alias("root"))
    return roots.union(links.select(F.col("a").alias("node"), F.col("a").alias("root")).distinct())
