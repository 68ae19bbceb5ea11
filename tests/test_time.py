"""Literal cases of the two clocks, and folds against plain loops."""

import random

import pytest
from pyspark.sql import functions as F

from chronoloom.operators import intervals as iv
from chronoloom.operators import sequences as sq
from chronoloom.operators import stateful as st

BY = ["plan_id"]


def frames(spark, cuts, duration=10.0):
    c = spark.createDataFrame([(1, a, b, e) for a, b, e in cuts], "plan_id int, start double, end double, enabled boolean")
    return c, spark.createDataFrame([(1, duration)], "plan_id int, duration double")


@pytest.mark.parametrize(
    ("cuts", "kept"),
    [
        ([(2, 4, True), (3, 5, True), (5.03, 6, None)], [(0, 2), (6, 10)]),
        ([(-3, 1, True), (8, 99, True), (6, 5, True), (3, 4, False), (None, 5, True), (float("nan"), 2, True)], [(1, 5), (6, 8)]),
        ([(0, 10, True)], []),
        ([], [(0, 10)]),
    ],
)
def test_keeps(spark, cuts, kept):
    c, p = frames(spark, [(None if a is None else float(a), float(b), e) for a, b, e in cuts])
    assert [(r.a, r.b) for r in iv.keeps(c, p, BY).orderBy("a").collect()] == kept
    total = iv.kept_seconds(iv.keeps(c, p, BY), p, BY).first()
    assert total.kept == sum(b - a for a, b in kept)


def test_both_clocks(spark):
    kept = spark.createDataFrame([(1, 1.0, 3.0, 0.0), (1, 4.0, 6.0, 2.0), (1, 8.0, 10.0, 4.0)], "plan_id int, a double, b double, offset double")
    times = spark.createDataFrame([(1, t) for t in (0.5, 1.0, 2.5, 3.5, 4.0, 12.0)], "plan_id int, t double")
    assert [(r.final, r.clamped) for r in iv.remapped(times, kept, BY).orderBy("t").collect()] == [(None, 0.0), (0.0, 0.0), (1.5, 1.5), (None, 2.0), (2.0, 2.0), (None, 6.0)]
    back = iv.inverted(spark.createDataFrame([(1, 2.0), (1, 4.5)], "plan_id int, t double"), kept, BY)
    assert [r.original for r in back.orderBy("t").collect()] == [4.0, 8.5]
    ranges = spark.createDataFrame([(1, 2.5, 4.5), (1, 3.1, 3.9)], "plan_id int, start double, end double")
    assert [(r.final_start, r.final_end) for r in iv.range_remapped(ranges, kept, BY).collect()] == [(1.5, 2.5)]


def test_frame_grid(spark):
    kept = spark.createDataFrame([(1, 0.01, 1.01), (1, 1.5, 1.6), (1, 3.02, 4.0)], "plan_id int, a double, b double")
    assert sorted((r.first_frame, r.end_frame) for r in iv.gridded(kept, BY, 30.0).collect()) == [(0, 31), (90, 120)]
    alone = kept.where("a = 1.5")
    assert iv.gridded(alone, BY, 30.0).count() == 1


def test_overlaps_against_all_pairs(spark):
    rng = random.Random(3)
    mk = lambda n: [(1, i, float(a := rng.randint(0, 400)), float(a + rng.choice([0, 1, 5, 300]))) for i in range(n)]
    left, right = mk(60), mk(70)
    schema = "plan_id int, id int, start double, end double"
    got = iv.overlapping(spark.createDataFrame(left, schema), spark.createDataFrame(right, schema), BY, 16.0)
    assert sorted((r.id, r.r_id) for r in got.collect()) == sorted((x[1], y[1]) for x in left for y in right if x[3] > y[2] and x[2] < y[3])


def test_nearest_and_ties(spark):
    left = spark.createDataFrame([(1, 2.0), (1, 5.0), (2, 1.0)], "plan_id int, t double")
    right = spark.createDataFrame([(1, 1.0), (1, 3.0), (1, 9.0)], "plan_id int, x double")
    assert [(r.plan_id, r.t, r.near) for r in iv.nearest(left, right, BY, "t", "x", 1.5).orderBy("plan_id", "t").collect()] == [(1, 2.0, 1.0), (1, 5.0, None), (2, 1.0, None)]


def series(spark, values):
    return spark.createDataFrame([(1, i, float(i), float(v)) for i, v in enumerate(values)], "plan_id int, idx long, start double, value double")


def test_folds_against_loops(spark):
    rng = random.Random(1)
    values = [rng.random() * 100 for _ in range(80)]
    got = [r.level for r in st.attack_release(series(spark, values), BY, 0.5, 0.1).orderBy("idx").collect()]
    y, expected = values[0], []
    for x in values:
        y += (0.5 if x > y else 0.1) * (x - y)
        expected.append(y)
    assert got == pytest.approx(expected)
    taken = []
    for i in sorted(range(80), key=lambda i: (-values[i], i)):
        if all(abs(i - j) >= 5 for j in taken):
            taken.append(i)
    minus = series(spark, values).withColumn("minus", -F.col("value"))
    assert sorted(r.idx for r in st.spaced(minus, BY, ["minus", "idx"], 5).collect()) == sorted(taken)
    still = st.followed(series(spark, [5.0, 5.5, 4.8, 5.1]), BY, 1.0, 0.5)
    assert [r.followed for r in still.orderBy("idx").collect()] == [5.0] * 4


def test_rows_never_overlap(spark):
    rng = random.Random(2)
    items = [(1, i, float(a := rng.randint(0, 60)), float(a + rng.randint(1, 20))) for i in range(50)]
    got = st.packed_rows(spark.createDataFrame(items, "plan_id int, id int, start double, end double"), BY).collect()
    for r in got:
        for s in got:
            assert r.id == s.id or r.row != s.row or r.end <= s.start or s.end <= r.start
    depth = max(sum(x[2] <= t < x[3] for x in items) for t in range(90))
    assert max(r.row for r in got) + 1 == depth


def words(spark, texts, pause=0.1):
    return spark.createDataFrame([(1, i, t, i * 0.5, i * 0.5 + 0.5 - pause) for i, t in enumerate(texts)], "plan_id int, word_i long, text string, start double, end double")


def test_sentences_and_segments(spark):
    texts = "one two. three four five six seven eight, nine the ten".split()
    got = [r.sentence for r in st.sentences(words(spark, texts), BY, 2.0).orderBy("word_i").collect()]
    # "one two." / "three four five six seven", which ends with the word that reaches 2 seconds / "eight, nine the ten"
    assert got == [0, 0, 1, 1, 1, 1, 1, 2, 2, 2, 2]
    seg = [r.segment for r in st.segmented(words(spark, texts), BY, 3, 18, 12, ("the",)).orderBy("word_i").collect()]
    assert seg == sorted(seg) and all(seg.count(x) <= 3 for x in seg)
    at = texts.index("the")
    assert seg[at] == seg[at + 1]


def test_segmentation_is_the_best(spark):
    from itertools import product

    rng = random.Random(5)
    texts = ["w" * rng.randint(1, 9) for _ in range(9)]
    got = [r.segment for r in st.segmented(words(spark, texts, 0.0), BY, 4, 20, 14).orderBy("word_i").collect()]

    def cost(cuts):
        total, begin = 0.0, 0
        for i in range(1, len(texts) + 1):
            if i == len(texts) or cuts[i - 1]:
                size = sum(len(x) + 1 for x in texts[begin:i]) - 1
                if i - begin > 4:
                    return 1e9
                total += abs(size - 14) + 10 * max(0, size - 20) - 5 * (1.0 if i == len(texts) else 0.0)
                begin = i
        return total

    best = min(cost(c) for c in product([0, 1], repeat=len(texts) - 1))
    assert cost([int(a != b) for a, b in zip(got, got[1:])]) == pytest.approx(best)


def test_matched_words(spark):
    title = spark.createDataFrame([(1, 0, "hello"), (1, 1, "zzz"), (1, 2, "worlds")], "plan_id int, word_i long, text string")
    spoken = spark.createDataFrame([(1, 0, "well", 0.0), (1, 1, "Hello", 1.0), (1, 2, "big", 2.0), (1, 3, "world", 3.0)], "plan_id int, word_i long, text string, start double")
    assert [r.start for r in st.matched_words(title, spoken, BY).orderBy("word_i").collect()] == [1.0, 2.0, 3.0]


def test_sections_and_suppression(spark):
    got = [r.label for r in st.sections(series(spark, [0] * 8 + [5] * 8 + [10] * 8 + [0] * 8), BY).orderBy("idx").collect()]
    assert got[0] == "intro" and got[-1] == "outro" and "drop" in got
    picks = spark.createDataFrame([(1, 0, 1.0), (1, 3, 5.0), (1, 10, 2.0)], "plan_id int, idx long, value double")
    assert [(r.idx, r.value) for r in sq.suppressed(picks, BY, 6).orderBy("idx").collect()] == [(3, 5.0), (10, 2.0)]


def test_gate_at_the_mean_is_exact(spark):
    """The first value is just 40 under the mean and goes, though the sum of doubles in this order says that it isn't."""
    values = [12.24, 18.21, 71.23, 17.73, 96.26, 70.74, 70.76, 105.45, 21.26, 38.52]
    for turned in (values, values[::-1], sorted(values), sorted(values, reverse=True), values[5:] + values[:5]):
        got = sq.gated(series(spark, turned).coalesce(1), BY, 5.0, 40.0)
        assert sorted(r.value for r in got.collect()) == sorted(values)[1:]


def test_section_edges_fall_as_in_sql():
    """A value a third of the way from one quantile to the other falls on the side that quantile_cont puts it."""
    import duckdb
    import numpy as np

    rng = np.random.default_rng(1)
    for _ in range(300):
        values = np.round(rng.exponential(50, rng.integers(2, 90)), 2)
        low, high = duckdb.execute("SELECT quantile_cont(x, 0.1), quantile_cont(x, 0.9) FROM (SELECT unnest(?::DOUBLE[]) AS x)", [values.tolist()]).fetchone()
        assert (st.quantile(values, 0.1), st.quantile(values, 0.9)) == (low, high)
