"""Runs of periodic words in texts, found by divide and conquer after Main and Lorentz.

The words of a text are numbered by identity. A stretch is halved again and again; a run belongs to the one stretch whose midpoint it crosses first, and lies
inside it. A run of four periods or more that crosses a midpoint has two periods on one side of it at least, so the Z-function of the words right of the midpoint (or of
those left of it, backwards) is q or more at place q for its period q; a second Z-function says how far it extends on the other side. What goes on beyond the stretch is no run of it: a
stretch further up has had it. Of equal intervals the smallest period stays; by the theorem of Fine and Wilf all others are its multiples.

All stretches of one size, of many texts, are looked at together: few have a place where the first words after the midpoint come back, and only for these Z-functions are made. Inside a stretch that
is periodic as a whole only much shorter periods are looked for.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_schema

#: A run has so many words, and so many periods, at least.
LEAST, EXPONENT = 6, 4
#: Words compared for all stretches of a size at once, before Z-functions are made.
FIRST = 6
#: Texts are worked off together until they have so many words.
GROUP = 1 << 17
SCHEMA = "doc_id long, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string"

Change = Callable[[int | None, list[bytes]], list[bytes]]


def z_function(s: list[int]) -> np.ndarray:
    """For each place how many elements from there on equal those from the beginning on."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return np.array(z, np.int64)


def repeated(right: list[int], left: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Periods of which two stand at the beginning of right, how far each goes on in right, and how far back into left, whose first element is the one nearest to right."""
    z = z_function(right)
    q = np.arange(1, len(right) // 2 + 1)
    q = q[z[q] >= q]
    if not len(q):
        return q, q, q
    back = z_function([*left, -2, *reversed(right), *left])  # at the place of right's element q - 1: how far what precedes element q equals left
    return q, q + z[q], back[len(left) + 1 + len(right) - q]


def candidates(s: np.ndarray, m: np.ndarray, room: np.ndarray, step: int) -> np.ndarray:
    """Which of the midpoints m have a period q, of at most room, of which two may stand from m on in the direction of step, as part of a run."""
    node = np.repeat(np.arange(len(m)), room)
    q = np.arange(1, len(node) + 1) - np.repeat(np.cumsum(room) - room, room)
    at = m[node]
    for j in range(FIRST):
        here = at + step * np.where(q > j, j, 0)  # shorter periods are known to stand twice
        same = s[here] == s[here + step * q]
        node, q, at = node[same], q[same], at[same]
    # the run is longer than those two periods: by half of what is missing at least, onwards or back
    onwards, back, half = np.ones(len(q), bool), np.ones(len(q), bool), np.maximum((LEAST + 1) // 2 - q, ((EXPONENT - 2) * q + 1) // 2)
    for j in range(1, FIRST + 1):
        for ok, here in ((onwards, at + step * (q + j - 1)), (back, at - step * j)):
            ok &= (j > half) | (s[np.clip(here, 0, len(s) - 1)] == s[np.clip(here + step * q, 0, len(s) - 1)])
    return np.unique(node[onwards | back])


def inner(period: int) -> int:
    """The largest period that a run inside a stretch of this period may have. With EXPONENT periods of its own it is shorter than both periods together, or it would be no run but part of the stretch."""
    return (period - 1) // (EXPONENT - 1)


def find_runs(texts: list[list[bytes]]) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each of the texts, given as words; by start, then period."""
    stream, begins = [-1], []
    for words in texts:
        begins.append(len(stream))
        stream.extend(map(dict(zip(dict.fromkeys(words), range(len(words)))).__getitem__, words))
        stream.append(-1)
    s = np.array(stream, np.int64)
    a = np.array(begins, np.int64)
    b = a + np.array([len(x) for x in texts], np.int64)
    doc = np.arange(len(texts))
    most = np.full(len(texts), len(s))  # the largest period that is still looked for in a stretch
    found: list[dict[tuple[int, int], int]] = [{} for _ in texts]
    while True:
        wide = (b - a >= LEAST) & (most > 0)
        a, b, doc, most = a[wide], b[wide], doc[wide], most[wide]
        if not len(a):
            break
        m = (a + b) // 2
        halves = [most, most.copy()]
        for step, hits in ((1, candidates(s, m, np.minimum(most, (b - m) // 2), 1)), (-1, candidates(s, m - 1, np.minimum(most, (m - a) // 2), -1))):
            for i in hits.tolist():
                low, mid, high = int(a[i]), int(m[i]), int(b[i])
                after, before = stream[mid:high], stream[low:mid][::-1]
                q, own, other = repeated(after, before) if step == 1 else repeated(before, after)
                starts, ends = (mid - other, mid + own) if step == 1 else (mid - own, mid + other)
                long = ends - starts >= np.maximum(LEAST, EXPONENT * q)
                if not long.any():
                    continue
                q, starts, ends = q[long], starts[long], ends[long]
                for half, covers in zip(halves, (starts <= low, ends >= high), strict=True):
                    half[i] = min(half[i], int(inner(q[covers].min(initial=EXPONENT * len(s)))))
                runs, origin = found[doc[i]], begins[doc[i]]
                for start, end, period in zip(starts.tolist(), ends.tolist(), q.tolist(), strict=True):
                    if stream[start - 1] != stream[start - 1 + period] and stream[end] != stream[end - period]:
                        key = (start - origin, end - start)
                        runs[key] = min(period, runs.get(key, period))
        a, b, doc, most = np.concatenate((a, m)), np.concatenate((m, b)), np.concatenate((doc, doc)), np.concatenate(halves)
    return [sorted((start, length, q) for (start, length), q in x.items()) for x in found]


def collapsed(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without those that any run has after its first period, joined by one space."""
    if runs:
        inside = np.zeros(len(words) + 1, np.int64)
        for start, length, q in runs:
            inside[start + q] += 1
            inside[start + length] -= 1
        words = [w for w, x in zip(words, np.cumsum(inside).tolist(), strict=False) if not x]
    return b" ".join(words)


def periodic_runs(docs: DataFrame, change: Change | None = None) -> DataFrame:
    """doc_id, n_words, runs and collapsed, the text without what its runs repeat, for each row of docs.

    Words are what ASCII white space separates. runs has each maximal stretch of LEAST words or more that is made of EXPONENT periods or more, by start. change may
    replace the words of a text before they are looked at. A null text counts as empty: no words, no runs, and an empty collapsed text. Rows that repeat give repeated
    results; a null doc_id stays null; an empty table gives no rows; texts of any length count whole; other columns don't matter. The time is n log n for n words whatever they are.
    """
    schema = arrow_schema(SCHEMA)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list[int | None] = []
        texts: list[list[bytes]] = []

        def give() -> pa.RecordBatch:
            runs = find_runs(texts)
            rows = [[{"start": x, "length": y, "period": q} for x, y, q in r] for r in runs]
            plain = [collapsed(w, r).decode() for w, r in zip(texts, runs, strict=True)]
            columns = [pa.array(x, f.type) for x, f in zip((ids, [len(x) for x in texts], rows, plain), schema, strict=True)]
            return pa.RecordBatch.from_arrays(columns, schema=schema)

        held = 0
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                words = (text.as_py() or "").encode().split()  # of bytes: white space is \x20 and \x09-\x0D
                texts.append(change(doc_id, words) if change else words)
                ids.append(doc_id)
                held += len(words) + 1
                if held >= GROUP:
                    yield give()
                    ids, texts, held = [], [], 0
        yield give()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, SCHEMA)


def with_repeats(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words of a tenth of the documents, told by the checksum of the doc_id, repeated from some place on; others, and those without doc_id, as they are."""
    h = 1 if doc_id is None else zlib.crc32(str(doc_id).encode())
    if h % 10 or not words:
        return words
    n, g = len(words), h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + (words[a : a + p] * ((n - a) // p + 1))[: n - a]


def run_digests(docs: DataFrame) -> DataFrame:
    """A row for each row of docs, whose texts are changed by with_repeats: n_runs, the longest run (ties: least start, then period) or nulls, and digests of all runs and of the collapsed text.

    Nulls, repeated rows, long texts and empty tables are as in periodic_runs(); a text without runs has the digest of the empty string for its runs.
    """
    best = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    lines = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return (
        periodic_runs(docs, with_repeats).withColumn("_best", best)
        .select(
            "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("_best.start")).alias("start"), F.col("_best.length").alias("length"), (-F.col("_best.period")).alias("period"),
            F.expr("1000 * _best.length div -_best.period").alias("exponent_milli"), F.sha2(F.array_join(lines, "").cast("binary"), 256).alias("runs_sha256"),
            F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"), "n_words",
        )
    )
