"""Toxicity by a factorization machine over hashed terms.

score = sigmoid(b + sum of w_i + sum over pairs of <v_i, v_j>) over the terms of a text: the pairs catch what single terms
don't say, such as an insult together with the mention of a group. The sum over pairs takes time in proportion to the terms.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_map, held_out

#: The model learns from so many labelled texts of either label at most. It knows the terms that go with the label by a chi-square of CHI or more, alone, or in a pair with another
#: term, beyond what the first ones say, by a z-score of PAIR_Z in PAIR_DOCS texts or more. Pairs are looked for among the PAIRED terms with the largest loadings on
#: the leading directions of the interactions; all other terms have no evidence in the sample and weigh nothing.
SAMPLE, CHI, PAIR_DOCS, PAIR_Z, PAIRED, DIRECTIONS, ROUNDS = 4_000, 20.0, 8, 6.5, 256, 4, 8
FACTORS, EPOCHS, BATCH, RATE, DECAY, START, SEED = 4, 20, 64, 0.02, 1e-3, 0.1, 42
STRIP = ".,;:!?\"'()[]{}<>|*_-"
THRESHOLD = 0.5


def terms(text: str) -> np.ndarray:
    """Hashes of the distinct words of the whole text, lower-cased and without punctuation around them; sorted."""
    found = {x.strip(STRIP) for x in set(text.lower().split())}
    found.discard("")
    return np.sort(np.fromiter((zlib.crc32(x.encode()) for x in found), np.uint32, len(found)))


def sums(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive rows of values, lengths of them at a time; zeros for none."""
    total = np.concatenate((np.zeros((1, values.shape[1])), np.cumsum(values, 0, dtype=np.float64)))
    ends = np.cumsum(lengths)
    return total[ends] - total[ends - lengths]


@dataclass
class Machine:
    known: np.ndarray  # sorted hashes
    bias: float
    linear: np.ndarray
    factors: np.ndarray

    def places(self, hashes: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.empty(0, np.int64)
        at = np.minimum(np.searchsorted(self.known, hashes), len(self.known) - 1)
        return at[self.known[at] == hashes]

    def margins(self, places: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """For each text what the sigmoid is of, and its sums of factors; the last are all places in a row."""
        lengths, at = np.array([len(x) for x in places], np.int64), np.concatenate([*places, np.empty(0, np.int64)])
        v = self.factors[at]
        s = sums(np.column_stack((self.linear[at], v, (v * v).sum(1))), lengths)
        inner = s[:, 1:-1]
        return self.bias + s[:, 0] + ((inner**2).sum(1) - s[:, -1]) / 2, inner, at

    def score(self, hashes: list[np.ndarray]) -> np.ndarray:
        m = self.margins([self.places(x) for x in hashes])[0]
        return 1 / (1 + np.exp(-np.clip(m, -30, 30)))


def fit(hashes: list[np.ndarray], toxic: np.ndarray, prior: float) -> Machine:
    """Adam on the logistic loss with weight decay. prior: the share of toxic texts outside the sample, to which the bias is set."""
    every, own, docs = np.unique(np.concatenate(hashes), return_inverse=True, return_counts=True)
    bad, total = np.bincount(own, np.repeat(toxic, [len(x) for x in hashes]), len(every)), toxic.sum()
    size = len(hashes)
    a, b, c, d = bad, docs - bad, total - bad, size - total - docs + bad
    chi = size * (a * d - b * c) ** 2 / np.maximum(1, docs * (size - docs) * total * (size - total))
    odds = np.log((a + 0.5) / (c + 0.5)) - np.log((b + 0.5) / (d + 0.5))
    alone = chi >= CHI
    lengths = [len(x) for x in hashes]
    said = sums(np.where(alone, odds, 0.0)[own][:, None], np.array(lengths))[:, 0]
    chosen = np.union1d(np.flatnonzero(alone), paired_terms(own, np.repeat(np.arange(size), lengths), toxic, said, docs))
    known, rng, n = every[chosen], np.random.default_rng(SEED), len(chosen)
    machine = Machine(known, float(np.log(total / (size - total))) - 1, odds[chosen] / 2, rng.normal(0, START, (n, FACTORS)))
    places = [machine.places(x) for x in hashes]
    theta = [machine.linear, machine.factors]
    first, second = [np.zeros_like(x) for x in theta], [np.zeros_like(x) for x in theta]
    step = 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(places))
        for a in range(0, len(order), BATCH):
            some = order[a : a + BATCH]
            own = [places[i] for i in some]
            margin, inner, at = machine.margins(own)
            error = (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - toxic[some]) / len(some)
            each = np.repeat(error, [len(x) for x in own])
            by = np.bincount(at, each, n)
            pulls = np.repeat(inner, [len(x) for x in own], axis=0) * each[:, None]
            grads = [by, np.column_stack([np.bincount(at, pulls[:, f], n) for f in range(FACTORS)]) - machine.factors * by[:, None]]
            step += 1
            machine.bias -= RATE * error.sum()
            for x, g, m, v in zip(theta, grads, first, second, strict=True):
                m *= 0.9
                m += 0.1 * g
                v *= 0.999
                v += 0.001 * g * g
                x -= RATE * (m / (1 - 0.9**step) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8) + DECAY * x)
    share = float(np.clip(toxic.mean(), 1e-3, 1 - 1e-3))
    prior = float(np.clip(prior, 1e-3, 1 - 1e-3))
    machine.bias += np.log(prior / (1 - prior)) - np.log(share / (1 - share))
    return machine


def paired_terms(term: np.ndarray, text: np.ndarray, toxic: np.ndarray, said: np.ndarray, docs: np.ndarray) -> np.ndarray:
    """Terms of pairs that go with the label beyond what terms alone say. (text, term): which text has which term; said: the sum of log odds of the terms that count alone; docs: texts a term is in.

    The interactions are the matrix X' diag(r) X of the centred terms and the residuals r. Some rounds of subspace iteration give its leading directions, without any pair being listed;
    the pairs among the terms that load most on them are then counted exactly.
    """
    size = len(toxic)
    group = np.sign(said).astype(int) + 1  # texts that the terms alone call clean, that they say nothing of, and that they call toxic
    share = np.array([toxic[group == g].mean() if (group == g).any() else 0.0 for g in range(3)])
    expected = share[group]
    residual = toxic - expected
    often = np.flatnonzero((docs >= PAIR_DOCS) & (docs < size))
    if len(often) < 2:
        return np.empty(0, np.int64)
    place = np.full(len(docs), -1)
    place[often] = np.arange(len(often))
    keep = place[term] >= 0
    term, text = place[term[keep]], text[keep]
    p = docs[often] / size
    scale = 1 / np.sqrt(size * p * (1 - p))
    directions = np.random.default_rng(SEED).normal(size=(len(often), DIRECTIONS))
    for _ in range(ROUNDS):
        directions = np.linalg.qr(directions)[0]
        scaled = scale[:, None] * directions
        by_text = np.column_stack([np.bincount(text, x[term], size) for x in scaled.T]) - p @ scaled
        pulls = residual[:, None] * by_text
        directions = scale[:, None] * (np.column_stack([np.bincount(term, x[text], len(often)) for x in pulls.T]) - p[:, None] * pulls.sum(0))
    top = np.sort(np.argsort(-(directions**2).sum(1), kind="stable")[:PAIRED])
    column = np.full(len(often), -1)
    column[top] = np.arange(len(top))
    has = np.zeros((size, len(top)), np.float32)
    inside = column[term] >= 0
    has[text[inside], column[term[inside]]] = 1
    together, bad, wanted = (has.T @ (w[:, None] * has) for w in (np.ones(size, np.float32), toxic.astype(np.float32), expected.astype(np.float32)))
    spread = has.T @ ((expected * (1 - expected)).astype(np.float32)[:, None] * has)
    z = np.abs(bad - wanted) / np.sqrt(np.maximum(spread, 4.0))
    np.fill_diagonal(z, 0)
    return often[top[((z >= PAIR_Z) & (together >= PAIR_DOCS)).any(0)]]


def train(docs: DataFrame, labels: DataFrame) -> Machine:
    """Fits on a sample drawn by a hash of doc_id from the labelled rows that may be learnt from; of repeated labels the largest counts."""
    known = labels.where(~held_out(F.col("doc_id")) & F.col("toxic").isNotNull()).groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("_toxic"))
    counts = {r[0]: r[1] for r in known.groupBy("_toxic").count().collect()}
    nothing = Machine(np.empty(0, np.uint32), -2.0, np.empty(0), np.empty((0, FACTORS)))
    if len(counts) < 2:
        return nothing
    share = F.when(F.col("_toxic") == 1, 2 * SAMPLE / counts[1]).otherwise(2 * SAMPLE / counts[0])
    order = F.xxhash64("doc_id", F.lit("toxicity"))
    ranked = known.where(F.pmod(order, F.lit(1 << 30)) / (1 << 30) < share).withColumn("_rank", F.row_number().over(Window.partitionBy("_toxic").orderBy(F.pmod(order, F.lit(1 << 30)), "doc_id")))
    sample = F.broadcast(ranked.where(F.col("_rank") <= SAMPLE).select("doc_id", "_toxic"))  # at most 2 * SAMPLE rows of two numbers

    def make():
        return lambda toxic, texts: {"toxic": toxic, "terms": [terms(x or "").tobytes() for x in texts]}

    # a doc_id may repeat: of each label the SAMPLE texts of the least hashes count, equal ones once
    found = docs.select("doc_id", "text", F.xxhash64("text", "doc_id").alias("_order")).join(sample, "doc_id").dropDuplicates(["doc_id", "_order"])
    found = found.withColumn("_rank", F.row_number().over(Window.partitionBy("_toxic").orderBy("_order", "doc_id"))).where(F.col("_rank") <= SAMPLE)
    rows = arrow_map(found, ["_toxic", "text"], make, "toxic int, terms binary").collect()
    rows.sort(key=lambda r: (zlib.crc32(r["terms"]), bytes(r["terms"]), r["toxic"]))
    if len({r["toxic"] for r in rows}) < 2:
        return nothing
    return fit([np.frombuffer(bytes(r["terms"]), np.uint32) for r in rows], np.array([r["toxic"] for r in rows], float), counts[1] / (counts[0] + counts[1]))


def scored(docs: DataFrame, labels: DataFrame, text: Column) -> Column:
    """A column with the score of a text of docs, by a machine trained on docs and labels. Nulls count as empty."""
    shared = docs.sparkSession.sparkContext.broadcast(train(docs, labels))  # the terms of a sample of bounded size, FACTORS + 2 numbers each

    @F.pandas_udf("double")
    def score(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        machine = shared.value
        for texts in batches:
            yield pd.Series(np.concatenate([np.empty(0), *(machine.score([terms(x or "") for x in texts[a : a + BATCH]]) for a in range(0, len(texts), BATCH))]))

    return score(text)


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for each row of docs.

    A null text counts as empty and gets the score that the bias alone gives. Without labels of both kinds to learn from all scores are low and alike. Rows that
    repeat give repeated results, and of a label that repeats the largest counts; a null doc_id counts as held out; an empty table gives no rows; texts of any length count
    whole; other columns don't matter.
    """
    rows = docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), scored(docs, labels, F.col("text")).alias("score"))
    return rows.withColumn("predicted", (F.col("score") >= THRESHOLD).cast("int"))


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs without the rows whose score reaches THRESHOLD; all columns stay as they are.

    Nulls, empty and long texts are as in toxicity(); rows that repeat, and ties, stay or go together. An empty table stays empty; columns of any other name may be there.
    """
    return docs.where(scored(docs, labels, F.col("text")) < THRESHOLD)
