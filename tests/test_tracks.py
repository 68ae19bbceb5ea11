import random

import pytest
from pyspark.sql import functions as F

from chronoloom.functions import tags
from chronoloom.operators import tracks as tr

BY = ["plan_id"]


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_folds_against_loops(spark):
    rng = random.Random(6)
    spans = [(1, i, float(a := rng.randint(0, 80)), float(a + rng.randint(1, 12)), rng.randint(0, 5)) for i in range(40)]
    taken = []
    for s in sorted(spans, key=lambda s: (s[4], s[1])):
        if all(s[2] >= t[3] or s[3] <= t[2] for t in taken):
            taken.append(s)
    got = tr.greedy_spans(spark.createDataFrame(spans, "plan_id int, id long, start double, end double, rank int"), BY).collect()
    assert sorted(r.id for r in got) == sorted(s[1] for s in taken)

    lengths = [rng.random() * 2 for _ in range(12)]
    end, starts = 0.0, []
    for i, d in enumerate(lengths):
        over = max(0.0, min(0.5, d - 0.05, end - 0.05)) if i else 0.0
        starts.append(end - over)
        end += d - over
    clips = spark.createDataFrame([(1, i, d) for i, d in enumerate(lengths)], "plan_id int, i long, duration double")
    assert [r.at for r in tr.crossfaded(clips, BY, 0.5).orderBy("i").collect()] == pytest.approx(starts)

    wanted = [rng.random() < 0.6 for _ in range(30)]
    kept = []
    for i, w in enumerate(wanted):
        if w and (not kept or i - kept[-1] > 1):
            kept.append(i)
    rows = spark.createDataFrame([(1, i, w) for i, w in enumerate(wanted)], "plan_id int, idx long, wanted boolean")
    assert sorted(r.idx for r in tr.alternating(rows, BY, "idx", "wanted").collect()) == kept


@pytest.mark.parametrize(("key", "pitch"), [("C", 0), ("f#", 6), ("Bb minor", 10), ("Cb", 11), ("H", None), ("", None)])
def test_pitch(spark, key, pitch):
    assert value(spark, tags.pitch_class(F.lit(key))) == pitch


def test_tags(spark):
    assert value(spark, tags.genre(F.lit("Calm house"))) == "ambient" and value(spark, tags.genre(F.lit("speech"))) is None
    assert value(spark, tags.emoji(F.lit("Dinerito"))) is None and value(spark, tags.emoji(F.lit("¡Dineros!"))) == "💰"
    assert value(spark, tags.repaired(F.lit("Medico y medico bien"), {"medico": "médico"})) == "Médico y médico bien"
    assert value(spark, tags.message(F.lit("late:5"), {"late": "{} minutes late"})) == "5 minutes late" and value(spark, tags.message(F.lit("x:1"), {"late": "y"})) == "x:1"
    assert value(spark, tags.same_words(F.lit("¡Sí, señor!"), F.lit("si senor"))) is True
    assert [value(spark, tags.word_match(F.lit(a), F.lit(b))) for a, b in (("cat", "cats"), ("ca", "cats"), ("x", "x"))] == [True, False, True]
    assert value(spark, tags.merged_defaults(F.create_map(F.lit("a"), F.lit(1)), F.create_map(F.lit("a"), F.lit(9), F.lit("b"), F.lit(2)))) == {"b": 2, "a": 1}
    assert [value(spark, tags.keyword_target(F.lit(n), 10.0)) for n in (0, 25, 35)] == [1, 2, 4]
    r = value(spark, tags.unit_random(F.lit("a"), F.lit("1")))
    assert 0 <= r < 1 and r == value(spark, tags.unit_random(F.lit("a"), F.lit("1")))


def test_weighted_quality_is_exact(spark):
    """Sums of doubles come out under or over 0.05, and half a digit under or over, as the rows happen to be dealt; the exact ones don't."""
    rows = [("even", 0.1, 1.0), ("even", 0.0, 1.0), *(("even", d / 100, q) for d in range(11) for q in (3.0, 17.0, 29.0)), *(("tie", x, 1.0) for x in (0.1, 0.2, 0.3, 0.7, 0.000065)), ("none", None, 2.0), ("odd", 1 / 3, 3.0)]
    expected = {("even", 0.05, 0.0, False), ("tie", 0.260013, 0.000065, False), ("none", None, None, None), ("odd", 0.333333, 1 / 3, False)}
    for turned in (rows, rows[::-1], sorted(rows, key=lambda r: (r[1] or 0) * r[2]), sorted(rows, key=lambda r: -(r[1] or 0) * r[2])):
        got = tr.weighted_quality(spark.createDataFrame(turned, "k string, v double, w double").coalesce(1), ["k"], "v", "w", 0.05)
        assert {(r.k, r.q, r.worst, r.warn) for r in got.select("k", F.round("quality", 6).alias("q"), "worst", "warn").collect()} == expected
