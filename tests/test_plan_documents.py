"""Plans as documents: what is kept, coerced, dropped, and that a second time changes nothing."""

import json

from pyspark.sql import functions as F

from chronoloom.operators import plan_documents as pd

RULES = [
    ("text", "title_pop", None, None, None, None, None, None, None, None, None, None, None),
    ("text", "stack", "scale", "num", 0.5, 2.0, None, None, None, None, None, True, "1"),
    ("text", "stack", "lines", "num", 1.0, 5.0, 1.0, None, None, None, None, False, "2"),
    ("text", "stack", "pos", "num", 0.0, 1.0, None, None, 2, None, None, False, "[0.5,0.5]"),
    ("text", "stack", "color", "color", None, None, None, None, None, None, False, True, '"#FFFFFF"'),
    ("text", "stack", "side", "select", None, None, None, ["left", "right"], None, None, None, False, '"left"'),
    ("text", "stack", "glow", "bool", None, None, None, None, None, None, None, False, "true"),
    ("text", "stack", "tags", "text", None, None, None, None, None, True, None, False, None),
    ("sfx", "pop", "gain_db", "num", -40.0, 6.0, None, None, None, None, None, True, "-6"),
    ("transitions", "flash", None, None, None, None, None, None, None, None, None, None, None),
]
DEFAULTS = '{"entities":{"topic":"","name":""},"director":{"style":"dinamico"},"fx":{"captions":{"size":0.05,"y":0.7},"music":{"gain":1},"grade":{}}}'


def run(spark, *plans, fill=False):
    rows = spark.createDataFrame([(i, p if isinstance(p, (str, type(None))) else json.dumps(p)) for i, p in enumerate(plans)], "plan_id int, json string")
    catalog = spark.createDataFrame(RULES, pd.CATALOG)
    done, dropped = pd.normalised(rows, catalog, DEFAULTS, ["plan_id"], fill)
    out = {r.plan_id: r.json for r in done.collect()}
    again = pd.normalised(done, catalog, DEFAULTS, ["plan_id"], fill)[0]
    assert {r.plan_id: r.json for r in again.collect()} == out
    return {k: json.loads(v) for k, v in out.items()}, sorted(tuple(r) for r in dropped.collect())


def test_items_are_coerced_and_dropped(spark):
    text = [
        {"preset": "stack", "start": 9, "end": 2, "scale": 7, "lines": 2.6, "pos": [3, "0.25"], "color": "abc", "side": "up", "glow": 0, "tags": "a, b\n,c", "id": "tx_7", "own": {"k": [1, None]}},
        {"preset": "stack", "start": "1", "end": 1.01, "pos": [1], "color": 5, "side": "right", "glow": "x", "tags": ["q", 1], "id": "tx_7", "intensity": 3, "z": 1.5, "enabled": 0, "src": "user"},
        {"start": 99.99, "end": 200}, {"preset": "nope", "start": 1, "end": 2}, 5, {"preset": "stack", "end": 2}, {"preset": "stack", "start": 100, "end": 120}, {"preset": "stack", "start": True, "end": 3},
    ]
    plan = {"version": 2, "duration": 100, "mine": "ñ\"x", "fx": {"text": text, "sfx": [{"name": "pop", "at": -3}, {"name": "pop", "at": "x"}], "transitions": [{"kind": "flash", "at": 500, "dur": 9}, {"kind": "flash", "at": 1}], "effects": "bad"}}
    got, dropped = run(spark, plan)
    fx = got[0]["fx"]
    one, two, three = fx["text"]
    same = {"enabled": True, "locked": False, "src": "ai", "intensity": 1}
    assert one == same | {"preset": "stack", "start": 2, "end": 9, "scale": 2, "lines": 3, "pos": [1, 0.25], "color": "#AABBCC", "side": "left", "glow": False, "tags": ["a", "b", "c"], "id": "tx_7", "own": {"k": [1, None]}}
    assert two == same | {"preset": "stack", "start": 1, "end": 1.05, "scale": 1, "pos": [0.5, 0.5], "color": "#FFFFFF", "side": "right", "glow": True, "tags": ["q", "1"], "id": "tx_8", "z": 2, "enabled": False, "src": "user"}
    assert three == same | {"preset": "title_pop", "start": 99.95, "end": 100, "id": "tx_9"}
    assert fx["sfx"] == [{"name": "pop", "at": 0, "gain_db": -6, "enabled": True, "locked": False, "src": "ai", "id": "sf_1"}]
    assert [(x["at"], x["dur"], x["id"]) for x in fx["transitions"]] == [(100, 2, "tr_1"), (1, 0.35, "tr_2")]
    assert fx["effects"] == fx["graphics"] == fx["cutaways"] == [] and got[0]["mine"] == 'ñ"x'
    assert dropped == [(0, "sfx", 1, "no_times"), *((0, "text", i, r) for i, r in [(3, "unknown_kind"), (4, "not_object"), (5, "no_times"), (6, "no_times"), (7, "no_times")])]


def test_lists_of_music_and_captions(spark):
    music = {"stops": [{"at": 30, "dur": 20, "mode": "x"}, {"at": -1}, {"at": 2, "dur": 0}, {"dur": 1}, 7, {"at": 5, "mode": "cut"}], "swells": [{"start": 9, "end": 4, "db": 99}, {"start": 1, "end": 1.01}, {"start": 2, "end": 3, "k": 1}], "drop_at": "x", "gain": 2}
    captions = {"y_ranges": [{"start": 8, "end": 900, "y": 2}, {"start": 3, "end": 1, "y": 0.5}, {"start": 1, "end": 2}, {"start": 60, "end": 70, "y": 0.2}]}
    got, _ = run(spark, {"duration": 50, "fx": {"music": music, "captions": captions}, "entities": {"topic": None, "n": 5}}, None, "[1]", "broken{")
    fx = got[0]["fx"]
    assert fx["music"] == {"stops": [{"at": 0}, {"at": 5, "mode": "cut"}, {"at": 30, "dur": 10}], "swells": [{"start": 2, "end": 3, "k": 1, "db": 3}, {"start": 4, "end": 9, "db": 12}], "drop_at": None, "gain": 2}
    assert fx["captions"] == {"y_ranges": [{"start": 1, "end": 3, "y": 0.5}, {"start": 8, "end": 50, "y": 0.9}], "size": 0.05, "y": 0.7}
    assert got[0]["entities"] == {"topic": "", "n": "5", "name": ""} and got[0]["version"] == 2
    assert got[1] == got[2] == got[3] and got[1]["director"] == {"style": "dinamico"}


def test_caption_options_of_old_plans(spark):
    custom = '{"cap_pos":2,"cap_color":"#0f0","base_color":"zz","cap_case":"upper","cap_scale":1.5}'
    rows = spark.createDataFrame([(1, '{"fx":{"captions":{"color":"#111111"}}}'), (2, '{"version":2,"fx":{}}')], "p int, j string")
    got = {r.p: json.loads(r.j)["fx"]["captions"] for r in rows.select("p", pd.migrated(F.col("j"), DEFAULTS, F.lit(custom)).alias("j")).collect()}
    assert got == {1: {"y": 0.9, "accent": "#00FF00", "color": "#111111", "case": "upper", "size": 0.075}, 2: {"size": 0.05, "y": 0.7}}


def test_media_descriptors(spark):
    rows = ['{"sid":" ab-1 ","type":"image","w":3.5,"h":-1,"dur":"2.00004","crop":[2,0,"0.5",-1],"path":"/x"}', '{"sid":"../x"}', "[]", None, '{"sid":5}', '{"sid":"a","type":"gif","name":5,"crop":[1,2]}']
    got = spark.createDataFrame([(i, x) for i, x in enumerate(rows)], "i int, j string").select("i", pd.media(F.col("j")).alias("m")).collect()
    assert [r.m and json.loads(r.m) for r in sorted(got)] == [{"sid": "ab-1", "type": "image", "w": 4, "dur": 2, "crop": [1, 0, 0.5, 0]}, None, None, None, None, {"sid": "a"}]


def test_items_are_written_once(spark):
    """Items come from the plan as it was given, not from the migrated plan written and parsed again, and their text is what writing them again gives."""
    rows = spark.createDataFrame([(1, '{"fx":{"text":[{"preset":"stack","start":1e5,"end":100001,"own":{"k":2e3},"say":"\\u00f1\\"[x]\\\\"},"[\\u0001]"]}}')], "plan_id int, json string")
    assert [r.item for r in pd.items(rows, ["plan_id"]).orderBy("i").collect()] == ['{"end":100001,"own":{"k":2000},"preset":"stack","say":"ñ\\"[x]\\\\","start":100000}', '"[\\u0001]"']
    done = pd.normalised(rows, spark.createDataFrame(RULES, pd.CATALOG), DEFAULTS, ["plan_id"])[0]
    plan = done._jdf.queryExecution().optimizedPlan().toString()
    assert "map_concat" in plan and "map_concat" not in plan[plan.index("Generate inline"):]
    item = json.loads(done.first().json)["fx"]["text"][0]
    assert item["start"] == 100000 and item["own"] == {"k": 2000} and item["say"] == 'ñ"[x]\\'
