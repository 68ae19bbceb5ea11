"""Exact dedup by a tree merge of sorted digest runs.

Rows are dealt into 2 ** k runs, each with one entry for a digest. In round r run i takes in run i + 2 ** r, for each i that
2 ** (r + 1) divides: the two runs' entries are brought together by digest and run, sorted, and merged to one entry, the identifier that stays and the
number of rows. After k rounds one run is left, with one entry for each digest. The winner of a digest then goes back down to the runs of the first
round and on to the rows. So no task ever holds the rows of a hot digest: it meets two entries at most. Only digests move, never texts.

Two texts count as equal when SHA-256, a second 64-bit hash and the length in bytes of their normal forms agree:
all three are part of the key in every round, which is the verification of each merge.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, drop_rows, row_key

#: Rows for which there is a run, and the least and largest number of runs.
ROWS_A_RUN, RUNS, MOST_RUNS = 1 << 20, 64, 4096
KEY = ["_sha", "_check", "_bytes"]
#: The two parts of a row's key, where it is asked for.
KEYS = ["_k1", "_k2"]


def text_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", keys: bool = False) -> DataFrame:
    """doc_id, the digest columns and a number of its own, with keys also the row's key, for each row; a null text counts as empty. The number is good only where the result is held."""
    normal = ascii_lower(F.coalesce(F.col(text), F.lit("")))
    key = [k.alias(name) for k, name in zip(row_key(docs), KEYS, strict=True)] if keys else []
    rows = docs.select(F.col(doc_id).alias("doc_id"), *key, F.monotonically_increasing_id().alias("_row"), normal.alias("_text"))
    return rows.select(
        "doc_id", *KEYS[: len(key)], "_row", F.unhex(F.sha2(F.col("_text").cast("binary"), 256)).alias("_sha"), F.xxhash64("_text").alias("_check"),
        F.octet_length("_text").alias("_bytes"),
    )


def runs_for(n: int) -> int:
    """The number of runs, a power of two."""
    runs = RUNS
    while runs < MOST_RUNS and runs * ROWS_A_RUN < n:
        runs *= 2
    return runs


def merge_runs(digests: DataFrame, runs: int, largest: bool = True) -> tuple[DataFrame, DataFrame]:
    """The entries of the first runs, and those of the last: the row that stays and the group's size for each digest. digests has _run, from 0 to runs - 1."""
    pick: type | Column
    pick = F.max if largest else F.min
    first = digests.groupBy(*KEY, "_run").agg(pick(F.struct("doc_id", "_row")).alias("_stays"), F.count("*").alias("_size"))
    level, stride = first, 1
    while stride < runs:
        met = level.withColumn("_run", F.col("_run") - F.col("_run") % (2 * stride)).repartition(*KEY, "_run").sortWithinPartitions(*KEY, "_run")
        level = met.groupBy(*KEY, "_run").agg(pick("_stays").alias("_stays"), F.sum("_size").alias("_size"))
        stride *= 2
    return first, level.drop("_run")


def exact_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", largest: bool = True, keys: bool = False) -> DataFrame:
    """A row for each row of docs: doc_id, keep_id, group_size, kept, text_sha256, and with keys _k1 and _k2, the row's key over all columns.

    The row with the largest (or smallest) doc_id of a group stays. Null texts equal empty ones. A null doc_id is
    smaller than any other. Where a whole row repeats, or rows tie on doc_id, one of them is kept. Texts of any length count whole. An empty table gives no rows;
    other columns don't matter.
    """
    digests = cut(text_digests(docs, doc_id, text, keys))
    runs = runs_for(digests.count())
    digests = digests.withColumn("_run", F.pmod(F.xxhash64("_row"), F.lit(runs)).cast("int"))
    first, last = merge_runs(digests, runs, largest)
    down = first.select(*KEY, "_run").join(last, KEY)
    return digests.join(down, [*KEY, "_run"]).select(
        "doc_id", F.col("_stays.doc_id").alias("keep_id"), F.col("_size").alias("group_size"),
        (F.col("_row") == F.col("_stays._row")).alias("kept"), F.lower(F.hex("_sha")).alias("text_sha256"), *(KEYS if keys else []),
    )


def drop_exact(docs: DataFrame) -> DataFrame:
    """docs without the rows that exact_dedup drops; all columns stay as they are.

    Nulls, ties and long texts are as there; of rows that repeat one stays, whatever the files are split into when they are read again. An empty table stays empty; columns of any
    other name may be there.
    """
    told = cut(exact_dedup(docs, keys=True).groupBy("_k1", "_k2").agg(F.max("kept").alias("kept"), F.count("*").alias("n")))
    return drop_rows(docs, told.where("not kept").select("_k1", "_k2"), told.where("kept and n > 1").select("_k1", "_k2"))
