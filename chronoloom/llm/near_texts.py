"""Near-duplicate texts as groups: by SimHash fingerprints, and by their sets of word shingles where these differ more.

Texts whose fingerprints differ in few bits are brought together as in simhash, by its probing of buckets, and verified by their sets. A similarity of 0.8 moves some ten of 64 bits, more
than can be probed; so pairs that fingerprints miss are found by bands. Texts with equal sets are one node, named by a hash of the set. Nodes meet in the buckets of their min-hash bands, and each pair that counts is
verified set against set. Only groups matter, not pairs, and so a bucket is worked off by contraction:

1. each node meets the most popular node that near fingerprints lead to, and that of its buckets (that which shares most buckets with most others): a group of very many near copies hangs on
   the text they were made from;
2. buckets whose nodes are all in one group are done. In small ones of those left every two nodes of different groups meet, in the others each node meets the bucket's most
   popular node. The groups are joined, and the buckets that are done go;
3. in what is left every two nodes of different groups meet, but for nodes too many of whose shingles are in no other group's node: these have no link. So nothing is
   lost, and a dense group needs about one pair a node.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, drop_rows, lookup, narrow, row_key
from .graph import components
from .shingles import SEED, SIMILARITY, band_keys, shingle_sets
from .simhash import BITS, fingerprint, hashes, link_roots

#: Buckets of so few nodes are small. Rows whose sets a worker holds at once.
SMALL, BATCH = 8, 512


def set_name(x: np.ndarray) -> int:
    return xxhash.xxh64_intdigest(x.tobytes(), SEED) - (1 << 63)


def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    """The batches in slices of BATCH rows, each with the sets of its last column's texts."""
    for batch in batches:
        for at in range(0, len(batch), BATCH):
            part = batch.slice(at, BATCH)
            yield part, list(shingle_sets([x or "" for x in part.column(part.num_columns - 1).to_pylist()]))


def rows_of(docs: DataFrame) -> DataFrame:
    """doc_id, _k1, _k2 (the row's key), node, its bands' keys and the fingerprint for each row of docs; a null text counts as empty, and has no keys like any other without a word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, sets in slices(batches):
            prints = [fingerprint(hashes(x.as_py() or "")) for x in part.column(3)]
            columns = [*part.columns[:3], pa.array([set_name(x) for x in sets], pa.int64()), pa.array([band_keys(x) if len(x) else [] for x in sets], pa.list_(pa.int64())), pa.array(prints, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "_k1", "_k2", "node", "keys", "fp"])

    one, two = row_key(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), one.alias("_k1"), two.alias("_k2"), "text")
    return rows.mapInArrow(run, "doc_id long, _k1 long, _k2 long, node long, keys array<long>, fp long")


def sets_of(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, n and x, the upper halves of the set's hashes, for each row of docs whose key (_k1, _k2) is wanted. Within two sets halves of hashes are told apart nearly as well as whole ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, sets in slices(batches):
            halves = [np.unique((x >> np.uint64(32)).astype(np.uint32)) for x in sets]
            columns = [pa.array([set_name(x) for x in sets], pa.int64()), pa.array([len(x) for x in halves], pa.int64()), pa.array([x.view(np.int32) for x in halves], pa.list_(pa.int32()))]
            yield pa.RecordBatch.from_arrays(columns, names=["node", "n", "x"])

    one, two = row_key(docs)
    keyed = docs.select(one.alias("_k1"), two.alias("_k2"), "text").join(narrow(wanted), ["_k1", "_k2"], "left_semi")
    return keyed.select("text").mapInArrow(run, "node long, n long, x array<int>")


def alike(least: float) -> Column:
    """Whether the sets xa and xb, of na and nb shingles, have at least that similarity; the sizes alone rule out most that don't."""
    sizes = (F.col("na") >= least * F.col("nb") - 1e-9) & (F.col("nb") >= least * F.col("na") - 1e-9)
    return sizes & (F.size(F.array_intersect("xa", "xb")) * (1 + least) >= least * (F.col("na") + F.col("nb")) - 1e-9)  # common >= least * (na + nb - common)


def verified(pairs: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets have at least that similarity. pairs is held already; many of them may share a node."""
    one, two = (sets.select(F.col("node").alias(x), F.col("n").alias(f"n{x}"), F.col("x").alias(f"x{x}")) for x in "ab")
    return cut(lookup(pairs, one, ["a"], F.col("b")).join(two, "b").where(alike(least)).select("a", "b"))


def fingerprint_pairs(rows: DataFrame, popular: DataFrame, bits: int = BITS) -> DataFrame:
    """Pairs (a, b) of each node of rows with the most popular (node, popular) of those that fingerprints of at most bits differing bits lead to.

    A node may have several fingerprints; texts without a word are one node and take no part.
    """
    known = cut(rows.where(F.size("keys") > 0).select("node", "fp").distinct())
    roots = link_roots(cut(known.select("fp").distinct()), bits)
    rooted = cut(lookup(known, roots, ["fp"], F.col("node")).select("node", "root").distinct().join(popular, "node"))
    pivots = rooted.groupBy("root").agg(F.max(F.struct("popular", "node")).alias("pivot"))
    met = lookup(rooted, pivots, ["root"], F.col("node")).select(F.least("pivot.node", "node").alias("a"), F.greatest("pivot.node", "node").alias("b"))
    return cut(met.where("a < b").distinct())


def groups(rows: DataFrame, docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """node and root for each node of rows that is not alone; root is the least node of its group."""
    nodes = cut(rows.groupBy("node").agg(F.min(F.struct("_k1", "_k2")).alias("of"), F.first("keys").alias("keys")))
    keyed = nodes.select("node", F.explode("keys").alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    mine = keyed.join(shared, "key").groupBy("node").agg(F.collect_list(F.struct("key", "size")).alias("own"))  # BANDS keys at most
    popular = F.aggregate("own", F.lit(0).cast("long"), lambda s, x: s + x["size"])
    members = cut(mine.select("node", popular.alias("popular"), F.explode("own.key").alias("key")))
    ranked = nodes.select("node").join(members.select("node", "popular").distinct(), "node", "left").select("node", F.coalesce("popular", F.lit(0)).alias("popular"))
    printed = fingerprint_pairs(rows, ranked)
    wanted = members.select("node").union(printed.select("a")).union(printed.select("b")).distinct()
    sets = cut(sets_of(docs, cut(nodes.join(wanted, "node", "left_semi").select("of.*"))).dropDuplicates(["node"]))

    pivots = members.groupBy("key").agg(F.max(F.struct("popular", "node")).alias("pivot"))
    best = members.join(pivots, "key").groupBy("node").agg(F.max("pivot").alias("pivot"))
    met = best.select(F.least("pivot.node", "node").alias("a"), F.greatest("pivot.node", "node").alias("b"))
    tested = cut(met.where("a < b").union(printed).distinct())
    links = verified(tested, sets, least)
    open_ = still_open(members, components(links))
    small, large = open_.where(F.col("size") <= SMALL), open_.where(F.col("size") > SMALL)
    one, two = (small.select("key", F.col("node").alias(x), F.col("root").alias(f"root{x}")) for x in "ab")
    pairs = one.join(two, "key").where("a < b and roota <> rootb").select("a", "b")  # SMALL nodes a key at most
    pivots = large.groupBy("key").agg(F.max(F.struct("popular", "node", "root")).alias("pivot"))
    met = large.join(pivots, "key").where("root <> pivot.root").select(F.least("pivot.node", "node").alias("a"), F.greatest("pivot.node", "node").alias("b"))
    more = cut(pairs.union(met).distinct().join(tested, ["a", "b"], "left_anti"))
    links = cut(links.union(verified(more, sets, least)))
    open_ = still_open(large, components(links))
    rest = supported(open_, sets, least)
    rest = rest.join(rest.groupBy("node").agg(F.collect_list("key").alias("keys")).join(sets, "node"), "node")  # BANDS keys a node at most
    one, two = (rest.select(F.col("key").alias(f"key{x}"), F.col("keys").alias(f"keys{x}"), F.col("node").alias(x), F.col("root").alias(f"root{x}"), F.col("n").alias(f"n{x}"), F.col("x").alias(f"x{x}")) for x in "ab")
    once = F.array_min(F.array_intersect("keysa", "keysb")) == F.col("keya")  # two nodes meet in the first of their common buckets alone
    last = one.join(two, (F.col("keya") == F.col("keyb")) & F.expr("a < b and roota <> rootb") & once & alike(least))  # plain shuffles: adaptive execution splits a hot key's rows
    return components(links.union(cut(last.select("a", "b").distinct())))


def supported(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The rows (node, root and more) of nodes that may have a link to another root: so large a share of their shingles occurs in nodes of other roots too. The rest can have none."""
    each = cut(rows.select("node", "root").distinct().join(sets, "node").select("node", "root", F.explode("x").alias("shingle")))
    common = each.groupBy("shingle").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low < high").select("shingle")
    found = each.join(common, "shingle").groupBy("node").agg(F.count("*").alias("found"))
    good = found.join(sets.select("node", "n"), "node").where(F.col("found") >= least * F.col("n") - 1e-9).select("node", F.lit(True).alias("_good"))
    return cut(lookup(rows, cut(good), ["node"], F.col("key")).where("_good").drop("_good"))


def still_open(members: DataFrame, roots: DataFrame) -> DataFrame:
    """The rows of members whose key has nodes of more than one group, with their root and the number of the key's nodes."""
    rooted = lookup(members, roots.withColumnRenamed("root", "_root"), ["node"], F.col("key"))
    rooted = cut(rooted.select("node", "popular", "key", F.coalesce("_root", "node").alias("root")))
    keys = rooted.groupBy("key").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("size")).where("low < high").select("key", "size")
    return cut(lookup(rooted, keys, ["key"], F.col("node")).where("size > 0"))


def near_groups(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """doc_id, _k1, _k2 (the row's key) and root, the number of its group, for each row of docs.

    A group is what links of similarity least or more lead to, found by fingerprints or by bands. Texts with no word are one group, as are rows that repeat; null texts count as empty and null ids stay null. An empty
    table gives no rows; other columns don't matter. Whole texts count, however long.
    """
    rows = cut(rows_of(docs))
    roots = groups(rows, docs, least).withColumnRenamed("root", "_root")
    return lookup(rows.select("doc_id", "_k1", "_k2", "node"), roots, ["node"], F.xxhash64("_k1")).select("doc_id", "_k1", "_k2", F.coalesce("_root", "node").alias("root"))


def drop_near(docs: DataFrame, least: float = SIMILARITY) -> DataFrame:
    """docs with one row of each group of near-duplicates, that with the largest doc_id; all columns stay as they are.

    Of ties, among them rows without an id, which rank last, the largest row key decides; of rows that repeat one stays. Texts with no word, null or empty, are a group of their own. An
    empty table stays empty; columns of any other name may be there.
    """
    known = cut(near_groups(docs, least))
    key: Column = F.struct("doc_id", "_k1", "_k2")
    stays = known.groupBy("root").agg(F.max(key).alias("_stays"))
    told = lookup(known, stays, ["root"], F.xxhash64("_k1")).select("_k1", "_k2", ((F.col("_k1") == F.col("_stays._k1")) & (F.col("_k2") == F.col("_stays._k2"))).alias("stays"))
    counted = cut(told.groupBy("_k1", "_k2", "stays").agg(F.count("*").alias("n")))
    return drop_rows(docs, counted.where("not stays").select("_k1", "_k2"), counted.where("stays and n > 1").select("_k1", "_k2"))
