"""Language identification by a string kernel.

A text's features are the n-grams of one to four bytes that occur in it, hashed; the kernel of two texts is the cosine of their presence vectors
(a blended spectrum kernel). Nystroem landmarks turn it into features, on which ridge regression learns each language
against the rest. The kernel is linear in the presence vectors, so landmarks, their inverse root and the weights multiply into
one matrix of fixed size, and a batch of texts is scored by one matrix product.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, cut, held_out, narrow

SPECTRUM = (1, 2, 3, 4)
DIMENSIONS = 1 << 14
#: The model learns from so many texts of a language at most, of which so many are landmarks. With many languages each gets an equal share of so many texts and landmarks in all, but one at least: no language is left out.
SAMPLE, LANDMARKS, TEXTS_IN_ALL, LANDMARKS_IN_ALL = 400, 64, 25_600, 2_048
RIDGE = 1e-3
BATCH, BLOCK = 256, 1 << 18
LETTER = re.compile(r"[^\W\d_]")
UNKNOWN = "und"


def presence(text: str) -> np.ndarray:
    """For each dimension whether an n-gram of the whole lower-cased text hashes there."""
    raw = np.frombuffer(text.lower().encode(), np.uint8)
    out = np.zeros(DIMENSIONS, bool)
    overlap = max(SPECTRUM) - 1
    for at in range(0, len(raw), BLOCK):
        part = raw[at : at + BLOCK + overlap].astype(np.uint32)
        code = np.zeros(len(part), np.uint32)
        for n in range(1, max(SPECTRUM) + 1):
            if n > len(part):
                break
            code = code[: len(part) - n + 1] * np.uint32(257) + part[n - 1 :] + np.uint32(1)
            if n in SPECTRUM:
                out[(code * np.uint32(0x9E3779B1)) >> np.uint32(18)] = True
    return out


def has_letter(text: str | None) -> bool:
    if not text:
        return False
    m = LETTER.search(text)
    return bool(m) and (m[0].isalpha() or any(x.isalpha() for x in text))


def quota(languages: int) -> tuple[int, int]:
    """Texts and landmarks of each of so many languages."""
    n = max(1, languages)
    return max(1, min(SAMPLE, TEXTS_IN_ALL // n)), max(1, min(LANDMARKS, LANDMARKS_IN_ALL // n))


def kernel_rows(bits: np.ndarray) -> np.ndarray:
    """Presence vectors, given as packed bits, at length 1."""
    x = np.unpackbits(bits, axis=1).astype(np.float32)
    return x / np.sqrt(np.maximum(1, x.sum(1, keepdims=True)))


def fit(bits: np.ndarray, langs: list[str]) -> tuple[list[str], np.ndarray]:
    """The languages and the matrix that maps a presence vector of length 1 to their scores; bits are the packed vectors of the texts."""
    names = sorted(set(langs))
    own = np.array([names.index(v) for v in langs])
    each = quota(len(names))[1]
    marks = np.concatenate([np.flatnonzero(own == i)[:each] for i in range(len(names))])
    land = kernel_rows(bits[marks])
    values, turn = np.linalg.eigh(land.astype(np.float64) @ land.T.astype(np.float64))
    good = values > 1e-8 * values.max()
    root = turn[:, good] / np.sqrt(values[good])
    features = np.concatenate([(kernel_rows(bits[i : i + BATCH]) @ land.T).astype(np.float64) @ root for i in range(0, len(bits), BATCH)])
    mean = features.mean(0)
    y = (own[:, None] == np.arange(len(names))).astype(np.float64)
    # languages weigh alike, whatever their share of the sample
    weight = (1 / np.maximum(1, y.sum(0)))[own][:, None]
    weight /= weight.mean()
    centred = features - mean
    w = np.linalg.solve(centred.T @ (weight * centred) + RIDGE * len(bits) * np.eye(features.shape[1]), centred.T @ (weight * (y - y.mean(0))))
    bias = y.mean(0) - mean @ w
    return names, np.vstack((land.T @ (root @ w).astype(np.float32), bias)).astype(np.float32)


def sample_of(docs: DataFrame) -> DataFrame:
    """lang, _order and text of the rows to learn from: of each language those of the least hashes of doc_id and text, quota() of them at most, repeats once."""
    known = docs.where(~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()).select(F.col("lang").alias("_lang"), F.xxhash64("doc_id", "text").alias("_order"), "text")
    counts = cut(known.groupBy("_lang").agg(F.approx_count_distinct("_order").alias("_n")))  # of different texts: a language of many repeats has few
    texts = quota(counts.count())[0]
    chance = F.pmod("_order", F.lit(1 << 30)) / (1 << 30)
    some = known.join(narrow(counts), "_lang").where(chance < 2 * texts / F.col("_n")).dropDuplicates(["_lang", "_order"])  # about twice what is wanted
    ranked = some.withColumn("_rank", F.row_number().over(Window.partitionBy("_lang").orderBy(F.pmod("_order", F.lit(1 << 30)), "_order")))
    return ranked.where(F.col("_rank") <= texts).select("_lang", "_order", "text")


def train(docs: DataFrame) -> tuple[list[str], np.ndarray] | None:
    """Fits on sample_of(docs), at most max(TEXTS_IN_ALL, number of languages) texts, of which only presence bits reach the driver."""

    def make():
        return lambda langs, orders, texts: {"lang": langs, "order": orders, "bits": [np.packbits(presence(x)).tobytes() if has_letter(x) else None for x in texts]}

    rows = arrow_map(sample_of(docs), ["_lang", "_order", "text"], make, "lang string, order long, bits binary").where("bits is not null").collect()
    if not rows:
        return None
    rows.sort(key=lambda r: (r["order"], r["lang"]))
    return fit(np.frombuffer(b"".join(bytes(r["bits"]) for r in rows), np.uint8).reshape(len(rows), -1), [r["lang"] for r in rows])


def languages(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred and score for each row of docs; predictions use the text alone.

    A text that is null or has no letter is und with score 0, and so is every text where there is nothing to learn from. Of languages that tie the first by name is given. Rows that repeat give
    repeated results; a null doc_id counts as held out; an empty table gives no rows; texts of any length count whole, in blocks; other columns don't matter.
    """
    model = train(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a column of DIMENSIONS floats for each language

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, matrix = shared.value or ([UNKNOWN], np.zeros((DIMENSIONS + 1, 1), np.float32))
        for batch in batches:
            texts = batch.column(2)
            for at in range(0, len(batch), BATCH):
                part = [x.as_py() for x in texts[at : at + BATCH]]
                spoken = np.array([has_letter(x) for x in part]) & (shared.value is not None)
                x = np.zeros((len(part), DIMENSIONS + 1), np.float32)
                for i in np.flatnonzero(spoken):
                    bits = presence(part[i])
                    x[i, :-1] = bits / np.float32(np.sqrt(max(1, bits.sum())))
                x[:, -1] = 1
                scores = x @ matrix
                best = scores.argmax(1)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0)[at : at + BATCH], batch.column(1)[at : at + BATCH],
                        pa.array([names[i] if ok else UNKNOWN for i, ok in zip(best, spoken, strict=True)], pa.string()),
                        pa.array(np.where(spoken, np.clip(scores.max(1), 0, 1), 0).astype(float)),
                    ],
                    names=["doc_id", "held_out", "lang_pred", "score"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), "text")
    return rows.mapInArrow(run, "doc_id long, held_out boolean, lang_pred string, score double")
