"""Quality rules by host.

Each document is held against the rules on its own. The failures are counted by host and rule, and a host's rate is shrunk towards the rate of all:
(failed + alpha) / (documents + alpha + beta), where the beta prior of a rule is fitted to all hosts by moments. So a host with few documents says little, one with many
speaks for itself. A host at or above LIMIT in any rule is rejected, with all its documents; a document that fails a base rule goes wherever it comes from.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, arrow_map, cut, lookup

SYMBOLS = "#*$%&|<>"
SPACES = " \t\n\v\f\r"
WINDOW = 3
MEASURES = "doc_id long, host string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lines long"
#: By name, what a document fails; the base rules first. All numbers are whole, so that no rounding decides.
RULES: dict[str, Callable[[], Column]] = {
    "short": lambda: F.col("n_words") < 50,
    "repeats": lambda: 100 * F.col("n_repeat_words") > 50 * F.col("n_words"),
    "lines": lambda: 100 * F.col("n_dup_lines") > 30 * F.col("n_lines"),
    "symbols": lambda: 10 * F.col("n_symbols") > F.col("n_words"),
    "lengths": lambda: (F.col("word_chars") < 2 * F.col("n_words")) | (F.col("word_chars") > 15 * F.col("n_words")),
}
BASE = ("short", "repeats")
#: The shrunk share of failures from which on a host is rejected.
LIMIT = 0.5
#: The share of the variance that lies between hosts is kept inside these: the prior weighs as much as one document at least, and as a million at most.
LEAST_BETWEEN, MOST_BETWEEN = 1e-6, 0.5


def repeat_words(ids: np.ndarray) -> int:
    """Words inside windows of three that are found twice or more."""
    n = len(ids) - WINDOW + 1
    if n < 2:
        return 0
    key = ids[:n]
    for j in range(1, WINDOW):
        key = np.unique(key, return_inverse=True)[1] * (int(ids.max()) + 1) + ids[j : j + n]
    _, own, count = np.unique(key, return_inverse=True, return_counts=True)
    change = np.zeros(len(ids) + 1, np.int64)
    at = np.flatnonzero(count[own] > 1)
    np.add.at(change, at, 1)
    np.add.at(change, at + WINDOW, -1)
    return int((np.cumsum(change) > 0).sum())


def measured(text: str) -> tuple[int, ...]:
    """What the rules look at, in the order of MEASURES."""
    words = text.encode().split()  # of bytes: white space is \x20 and \x09-\x0D
    known = dict(zip(dict.fromkeys(words), range(len(words))))
    ids = np.fromiter(map(known.__getitem__, words), np.int64, len(words))
    lines = [x for x in text.split("\n") if x.strip(SPACES)]
    chars = len(text) - sum(text.count(c) for c in SPACES)
    return len(words), chars, sum(text.count(c) for c in SYMBOLS), len(lines) - len(set(lines)), repeat_words(ids) if len(known) < len(words) else 0, len(lines)


def measures(docs: DataFrame, host: str = "source") -> DataFrame:
    """doc_id, host and what the rules look at, for each row of docs; a null text counts as empty."""
    names = [x.split()[0] for x in MEASURES.split(", ")]

    def make():
        def f(ids, hosts, texts):
            rows = [measured(x or "") for x in texts]
            return {"doc_id": ids, "host": hosts} | {k: [r[i] for r in rows] for i, k in enumerate(names[2:])}

        return f

    return arrow_map(docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(f"`{host}`").cast("string").alias("host"), F.col("text").alias("text")), ["doc_id", "host", "text"], make, MEASURES)


def host_counts(rows: DataFrame) -> DataFrame:
    """host, docs and, by rule, failed_<rule>; a null host is none and is left out."""
    failed = [F.sum(F.when(rule(), 1).otherwise(0)).alias(f"failed_{k}") for k, rule in RULES.items()]
    return rows.where("host IS NOT NULL").groupBy("host").agg(F.count("*").alias("docs"), *failed)


def priors(hosts: DataFrame) -> dict[str, tuple[float, float]]:
    """alpha and beta of each rule, by moments over all hosts, each with the weight of its documents. One row of sums reaches the driver."""
    n, x = F.col("docs").cast("double"), lambda k: F.col(f"failed_{k}").cast("double")
    each = [F.struct(F.sum(x(k)).alias("failed"), F.sum(x(k) * x(k) / n).alias("squares")).alias(k) for k in RULES]
    total = hosts.agg(F.count("*").alias("_hosts"), F.sum(n).alias("_docs"), F.sum(n * n).alias("_docs2"), *each).first()
    out = {}
    for k in RULES:
        out[k] = (1.0, 1.0)
        if total is None or not total["_hosts"]:
            continue
        size, m = total["_docs"], total[k]["failed"] / total["_docs"]
        inside = m * (1 - m)
        spread = total[k]["squares"] - size * m * m
        room = inside * (size - total["_docs2"] / size - total["_hosts"] + 1)
        between = (spread - inside * (total["_hosts"] - 1)) / room if room > 0 else LEAST_BETWEEN
        strength = 1 / min(max(between, LEAST_BETWEEN), MOST_BETWEEN) - 1
        out[k] = (m * strength, (1 - m) * strength)
    return out


def host_verdicts(hosts: DataFrame, limit: float = LIMIT) -> DataFrame:
    """host, docs, by rule rate_<rule>, the shrunk share of failures, and rejected, the names of the rules in which it reaches limit."""
    known = priors(hosts)
    rates = {f"rate_{k}": (F.col(f"failed_{k}") + F.lit(a)) / (F.col("docs") + F.lit(a + b)) for k, (a, b) in known.items()}
    told = hosts.withColumns(rates)
    rejected = F.filter(F.array(*(F.when(F.col(f"rate_{k}") >= limit, F.lit(k)) for k in RULES)), lambda x: x.isNotNull())
    return told.select("host", "docs", *rates, rejected.alias("rejected"))


def quality(docs: DataFrame, host: str = "source", limit: float = LIMIT) -> DataFrame:
    """doc_id, the measures, base_failed, kept, host, host_docs and host_rejected (the rules for which its host is rejected) for each row of docs.

    A null text has no words and fails as short. A null host is no host: its documents are judged on their own, with host_docs and host_rejected null; an empty
    host is a host like any other. Rows that repeat count as often as they are there; a null doc_id stays null; an empty table gives no rows; texts of any length count whole; other
    columns don't matter. Hosts are counted before anything is shuffled, and a hot host's documents meet its verdict in many tasks.
    """
    rows = cut(measures(docs, host))
    verdicts = cut(host_verdicts(cut(host_counts(rows)), limit).select("host", F.col("docs").alias("host_docs"), F.col("rejected").alias("host_rejected")))
    few = verdicts.count() <= BROADCAST_ROWS
    met = rows.join(F.broadcast(verdicts), "host", "left") if few else lookup(rows, verdicts, ["host"], F.col("doc_id"))
    base = F.lit(False)
    for k in BASE:
        base = base | RULES[k]()
    return met.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", base.alias("base_failed"),
        (~base & (F.coalesce(F.size("host_rejected"), F.lit(0)) == 0)).alias("kept"), "host", "host_docs", "host_rejected",
    )
