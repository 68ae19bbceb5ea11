"""Tracks on the final clock against plain code."""

import math
import random

from pyspark.sql import functions as F

from chronoloom.operators import clocks, intervals as iv

KEPT = "p long, a double, b double, i int, offset double"


def plain_groups(words, size, gap=0.45):
    groups, now = [], []
    for i, (text, start, _) in enumerate(words):
        if now and (words[i - 1][0].rstrip()[-1:] in (".", "!", "?") or start - words[i - 1][2] > gap):
            groups, now = [*groups, now], []
        now.append(i)
        if len(now) >= size:
            groups, now = [*groups, now], []
    groups += [now] if now else []
    for i in range(len(groups) - 1, 0, -1):
        before, first = groups[i - 1], groups[i][0]
        if len(groups[i]) == 1 and len(before) < size + 1 and words[first][1] - words[before[-1]][2] < gap:
            before += groups.pop(i)
    return groups


def test_preview_groups_against_a_loop(spark):
    rng = random.Random(3)
    for size in (1, 2, 4):
        rows, want = [], {}
        for p in range(60):
            t, words = 0.0, []
            for _ in range(rng.randint(0, 30)):
                start = t + rng.choice([0.0, 0.1, 0.4, 0.5, 2.0])
                t = start + 0.25
                words.append((rng.choice(["a", "b.", "c! ", "d", "e?", "f"]), start, t))
            rows += [(p, i, *w) for i, w in enumerate(words)]
            want |= {(p, i): g for g, group in enumerate(plain_groups(words, size)) for i in group}
        got = clocks.preview_groups(spark.createDataFrame(rows, "p long, i int, text string, start double, end double"), ["p"], "i", size)
        assert {(r.p, r.i): r.group for r in got.collect()} == want


def kept_of(spark):
    """Of 0 to 100, 10 to 20 and 50 to 60 are cut."""
    return spark.createDataFrame([(1, 0.0, 10.0, 0, 0.0), (1, 20.0, 50.0, 1, 10.0), (1, 60.0, 100.0, 2, 40.0)], KEPT), spark.createDataFrame([(1, 100.0), (2, 5.0)], "p long, duration double")


def test_items_by_range_or_point(spark):
    kept, _ = kept_of(spark)
    rows = [(1, "r", 30.0, 5.0, None, None), (1, "in", 11.0, 19.0, None, None), (1, "at", None, None, 55.0, 2.0), (1, "half", 3.0, None, 25.0, None), (1, "no", None, None, None, 1.0), (1, "nan", math.nan, 4.0, None, None), (2, "none", 0.0, 4.0, None, None)]
    got = clocks.items_mapped(spark.createDataFrame(rows, "p long, id string, start double, end double, at double, dur double"), kept, ["p"], ["id"])
    assert {r.id: (r.final_start, r.final_end) for r in got.collect()} == {"r": (5.0, 20.0), "at": (40.0, 42.0), "half": (15.0, 15.0)}


def test_risers_look_back_and_bad_sounds_are_told(spark):
    kept, plans = kept_of(spark)
    rows = [(1, 1, "riser_long", 25.0, 10.0, True), (1, 2, "pop", 45.0, 20.0, True), (1, 3, "pop", None, 1.0, True), (1, 4, "pop", 12.0, 3.0, True), (1, 5, "pop", 100.0, 1.0, True), (1, 6, "pop", 5.0, None, False), (1, 7, None, 5.0, None, None)]
    sounds = spark.createDataFrame(rows, "p long, id int, name string, at double, dur double, enabled boolean")
    sounds = sounds.select("*", F.lit(None).cast("double").alias("gain_db"), F.lit("x").alias("pan"), F.lit(-1).alias("variant"), F.lit(90.0).alias("pitch"))
    got, skipped = clocks.sounds_mapped(sounds, plans, kept, ["p"])
    assert {r.id: (r.at, r.dur, r.gain_db, r.pan, r.variant, r.pitch) for r in got.collect()} == {
        1: (15.0, 5.0, -6.0, 0.0, None, 24.0), 2: (35.0, 10.0, -6.0, 0.0, None, 24.0), 4: (10.0, 3.0, -6.0, 0.0, None, 24.0), 7: (5.0, None, -6.0, 0.0, None, 24.0),
    }
    assert [(r.id, r.reason) for r in skipped.collect()] == [(3, "sfx:3:dato_invalido")]


def test_music_keeps_what_is_left_of_silences(spark):
    kept, _ = kept_of(spark)
    rows = [(1, [("45", 10.0), ("11", 5.0), ("x", 1.0), ("70", None)], [(5.0, 25.0, 3.0), (51.0, 59.0, 1.0), (None, 2.0, 1.0), (30.0, 22.0, -2.0)], "60", None, None), (2, None, None, None, False, "ai")]
    music = spark.createDataFrame(rows, "p long, stops array<struct<at:string,dur:double>>, swells array<struct<start:double,end:double,db:double>>, drop_at string, enabled boolean, source string")
    config, skipped = clocks.music_mapped(music, kept, ["p"])
    got = {r.p: r for r in config.collect()}
    assert [tuple(x) for x in got[1].stops] == [(35.0, 5.0), (10.0, 0.05), (50.0, None)]
    assert [tuple(x) for x in got[1].swells] == [(5.0, 15.0, 3.0), (12.0, 20.0, -2.0)]
    assert (got[1].drop_at, got[1].active, got[2].stops, got[2].drop_at, got[2].active) == (40.0, True, [], None, False)
    assert sorted((r.p, r.i, r.reason) for r in skipped.collect()) == [(1, 2, "music:stops:dato_invalido"), (1, 2, "music:swells:dato_invalido")]


def test_one_shuffle_a_side_for_two_times(spark):
    kept, _ = kept_of(spark)
    items = spark.createDataFrame([(1, 1, 2.0, 3.0)], "p long, id int, start double, end double")
    plan = clocks.all_remapped(items, kept, ["p"], ["id"], {"x": F.col("start"), "y": F.col("end")})._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_tables(spark):
    kept, plans = kept_of(spark)
    words = spark.createDataFrame([], "p long, i int, text string, start double, end double")
    assert clocks.captions_on_both_clocks(words, kept, ["p"], "i").count() == 0
    assert iv.keeps(spark.createDataFrame([], "p long, start double, end double, enabled boolean"), plans, ["p"]).count() == 2


def test_preview_groups_sort_twice_and_shuffle_no_text(spark):
    """One shuffle by plan, a sort up and one down; the text is left behind where nobody asks for it."""
    words = spark.range(40).select((F.col("id") % 3).alias("p"), F.col("id").alias("i"), F.concat(F.col("id").cast("string"), F.lit(".")).alias("text"), F.col("id").cast("double").alias("start"), (F.col("id") + 0.5).alias("end"))
    plan = clocks.preview_groups(words, ["p"], "i").select("p", "i", "group")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and plan.count("Sort [") == 2
