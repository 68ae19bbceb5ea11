import pytest
from pyspark.sql import functions as F

from chronoloom.functions import links, maths, text
from chronoloom.operators import jobs as jb
from chronoloom.operators import resolve as rs
from chronoloom.sources import readers, writers


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize(
    ("given", "kind", "found"),
    [
        ("mail me: a.b@example.com or @me", "email", "a.b@example.com"), ("see https://instagram.com/dr.demo?x=1", "url", "https://instagram.com/dr.demo?x=1"),
        ("follow @some_one", "handle", "@some_one"), ("call +34 600 100 200 now", "phone", "+34 600 100 200"), ("nothing here", None, None),
    ],
)
def test_single_link(spark, given, kind, found):
    x = value(spark, links.single(F.lit(given)))
    assert (x and x.kind, x and x.value) == (kind, found)


def test_platform_and_handle(spark):
    urls = {"https://www.instagram.com/dr.demo?igsh=1": ("instagram", "@dr.demo"), "m.youtube.com/@chan": ("youtube", "@chan"), "https://example.org/a": ("web", None), "notinstagram.com/x1": ("web", None)}
    for url, (name, at) in urls.items():
        assert (value(spark, links.platform(F.lit(url))), value(spark, links.handle(F.lit(url)))) == (name, at)
    for url, ok in {"http://localhost/x": False, "https://10.0.0.1/": False, "ftp://example.org": False, "https://example.org": True, "http://172.20.1.1": False}.items():
        assert value(spark, links.public(F.lit(url))) is ok


def test_all_links_of_a_text(spark):
    rows = [
        (1, "Write to Ana.B@mail.example.com, see https://www.instagram.com/ana.b/?igsh=1 and @ana.b (or tiktok: @ana_b). Call +34 600 100 200!"), (2, "on youtube @@chan and www.youtube.com/watch?v=1 (http://example.org/a/b/)."),
        (3, "@lonely. 12-34"), (4, None), (5, "x@y.zz x@y.zz mail http://a.example.org:8080/p?q=a@b.cc"),
    ]
    got = links.all_links(spark.createDataFrame(rows, "id long, text string"), ["id"]).collect()
    assert {(r.id, r.kind, r.platform, r.handle, r.ambiguous, r.n) for r in got if r.id < 4} == {
        (1, "email", "email", None, False, 1), (1, "url", "instagram", "@ana.b", False, 1), (1, "handle", "tiktok", "@ana_b", False, 1), (1, "phone", "phone", None, False, 1),
        (2, "handle", "youtube", "@chan", False, 1), (2, "url", "youtube", None, False, 1), (2, "url", "web", None, False, 1), (3, "handle", "instagram", "@lonely", True, 1),
    }
    addresses = {(r.id, r.address) for r in got}
    assert {(1, "https://instagram.com/ana.b"), (1, "mailto:ana.b@mail.example.com"), (1, "tel:+34600100200"), (2, "https://example.org/a/b"), (2, "https://youtube.com/watch")} <= addresses
    assert [(r.n, r.value) for r in got if r.id == 5 and r.kind == "email" and r.address == "mailto:x@y.zz"] == [(2, "x@y.zz")]


def test_text_functions(spark):
    assert value(spark, text.key_words(F.lit("  ¡Niño, CAFÉ-bar!  "))) == "nino cafe bar"
    assert value(spark, text.key_letters(F.lit("L'Été 2"))) == "l'ete"
    assert value(spark, text.titled(F.lit("mcDonald o'neil"))) == "McDonald O'neil"
    assert value(spark, text.without_ellipsis(F.lit("so..."), F.lit("end"))) == "so"
    assert value(spark, text.without_ellipsis(F.lit("so..."), F.lit("end…"))) == "so..."
    assert value(spark, text.subtitle_clock(F.lit(3661.239))) == "1:01:01.24"
    assert value(spark, text.cased_like(F.lit("hola"), F.lit("HELLO"))) == "HOLA"
    assert value(spark, text.cased_like(F.lit("hola"), F.lit("Hello"))) == "Hola"
    assert value(spark, text.number(F.lit("1e999"))) is None
    assert value(spark, text.leaks(F.lit("und so"), "en")) is True and value(spark, text.leaks(F.lit(None).cast("string"), "en")) is False
    assert value(spark, links.phone_display(F.lit("600-100-200"))) == "600 100 200"


def test_numbers(spark):
    assert value(spark, maths.easing("nonsense", F.lit(0.5))) == pytest.approx(0.875)
    for name in ("linear", "in_quad", "out_quint", "inout_cubic", "in_sine", "inout_sine", "out_expo", "out_back"):
        assert value(spark, maths.easing(name, F.lit(0.0))) == pytest.approx(0, abs=1e-9) and value(spark, maths.easing(name, F.lit(1.0))) == pytest.approx(1)
    assert value(spark, maths.normal_color(F.lit("#a1f"))) == "#AA11FF" and value(spark, maths.normal_color(F.lit("red"))) is None
    assert value(spark, maths.contrast(F.lit("#FFFFFF"), F.lit("#000000"))) == pytest.approx(21)
    assert value(spark, maths.remap(F.lit(3.0), 2.0, 2.0, 0.0, 7.0)) == 7.0


def test_claims_and_revisions(spark):
    rows = spark.createDataFrame([("j", 1, 0), ("j", 2, 0), ("j", 3, 1), ("k", 1, 1)], "id string, seq long, expected long")
    got = {(r.id, r.seq): (r.accepted, r.rev) for r in jb.claims(rows, ["id"], ["seq"]).collect()}
    assert got == {("j", 1): (True, 1), ("j", 2): (False, 1), ("j", 3): (True, 2), ("k", 1): (False, 0)}
    events = spark.createDataFrame([(1, 1, "a"), (1, 2, None), (1, 3, "a"), (1, 4, "b")], "id int, seq int, c string")
    assert [r.rev for r in jb.revisions(events, ["id"], ["seq"], F.col("c")).orderBy("seq").collect()] == [1, 1, 1, 2]


def test_resolution(spark):
    names = spark.createDataFrame([("whoosh",), ("hit",), ("hit_deep",)], "name string")
    wanted = spark.createDataFrame([("hit",), ("whoosh_3",), ("swish",), ("hit_deeper",), ("zap",)], "name string")
    got = {r.name: r.found for r in rs.resolved(wanted, names, spark.createDataFrame([("swish", "whoosh")], "alias string, name string")).collect()}
    assert got == {"hit": "hit", "whoosh_3": "whoosh", "swish": "whoosh", "hit_deeper": "hit_deep", "zap": None}
    items = spark.createDataFrame([(1, 0, "tx_3"), (1, 1, None), (1, 2, "tx_3"), (1, 3, "mine")], "p int, ord int, id string")
    assert [r.id for r in rs.renumbered(items, ["p"], "tx").orderBy("ord").collect()] == ["tx_3", "tx_4", "tx_5", "mine"]
    handles = spark.createDataFrame([(1, "@A", True), (1, "@a", False), (1, "@b", True)], "p int, handle string, ambiguous boolean")
    assert sorted(r.handle for r in rs.unambiguous(handles, ["p"]).collect()) == ["@a", "@b"]


PAGE = """<html><head><meta property="og:image" content="/a.png"><meta name='twitter:image' content='/t.png'>
<link rel="icon" href="/x.svg"><link rel="apple-touch-icon" sizes="180x180" href="/apple.png"><link rel=icon sizes=16x16 href=/small.png></head><body><meta name="image" content="no"></body>"""


def test_page_media(spark):
    got = readers.page_media(spark.createDataFrame([(1, PAGE), (2, None), (3, "")], "page_id int, html string"), ["page_id"])
    assert [(r.kind, r.url) for r in got.orderBy("kind", "rank").collect()] == [("logo", "/x.svg"), ("logo", "/apple.png"), ("photo", "/a.png"), ("photo", "/t.png")]


def test_transcripts_and_catalogs(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"transcription": [{"text": " hi ", "offsets": {"from": 0, "to": 500}}, {"text": "  ", "offsets": {"from": 1, "to": 2}}]}')
    assert [(r.file, r.text, r.start, r.end) for r in readers.read_transcripts(spark, str(tmp_path)).collect()] == [("a.json", "hi", 0.0, 0.5)]
    raw = spark.createDataFrame([('{"boom": {"dur": 1.5, "tags": ["x"]}}',), ("broken",)], "json string")
    assert [(r.name, r.dur, r.tags) for r in readers.catalog(raw, "dur:double,tags:array<string>").collect()] == [("boom", 1.5, ["x"])]
    lines = writers.subtitle_lines(spark.createDataFrame([(1, 0.0, 1.5, "a\nb{x}")], "id int, start double, end double, text string"), ["id"])
    assert lines.first().line == "Dialogue: 0,0:00:00.00,0:00:01.50,Default,,0,0,0,,a\\Nbx"
    writers.write_grouped(lines, ["id"], "start", str(tmp_path / "out"))
    assert spark.read.text(str(tmp_path / "out")).count() == 1
    jobs = spark.createDataFrame([('{"a": 1}',), ("oops",), (None,)], "params string")
    assert [r.x for r in readers.tolerant_params(jobs).select(F.to_json("params").alias("x")).collect()] == ['{"a":1}', "{}", "{}"]


def test_handles_in_context(spark):
    from chronoloom.functions import links

    texts = {
        1: "instagram here\ntiktok: see @ana_b", 2: "tiktok:@ana_b", 3: "ig @foo, yt/@no but a@b.com", 4: "see shop.example.com/a/b.", 5: "https://instagram.com/live https://instagram.com/p/x https://tiktok.com/live", 6: "@who",
        7: "word@yy @@twice", 8: None, 9: "t.me/c and t.me/joe", 10: "facebook.com/live @live", 11: "plain. text",
    }
    rows = spark.createDataFrame(list(texts.items()), "id long, text string")
    got = {}
    for r in links.all_links(rows, ["id"]).collect():
        got.setdefault(r.id, set()).add((r.kind, r.platform, r.handle, r.ambiguous))
    assert got == {
        1: {("handle", "tiktok", "@ana_b", False)}, 2: {("handle", "tiktok", "@ana_b", False)}, 3: {("handle", "instagram", "@foo", False), ("email", "email", None, False)}, 4: {("url", "web", None, False)},
        5: {("url", "instagram", "@live", False), ("url", "instagram", None, False), ("url", "tiktok", None, False)}, 6: {("handle", "instagram", "@who", True)}, 7: {("handle", "instagram", "@twice", True)},
        9: {("url", "telegram", None, False), ("url", "telegram", "@joe", False)}, 10: {("url", "facebook", "@live", False)},
    }, got


def test_claims_stream_through_many_jobs(spark):
    """No call for each job: 20,000 jobs in one partition are one pass, and a job's revision starts anew whatever batch it begins in."""
    rows = spark.range(60_000, numPartitions=1).select((F.col("id") % 20_000).alias("job"), (F.col("id") / 20_000).cast("int").alias("seq")).withColumn("expected", F.when(F.col("seq") < 2, 0).otherwise(1).cast("long"))
    got = jb.claims(rows, ["job"], ["seq"])
    assert "FlatMapGroupsInPandas" not in got._jdf.queryExecution().toString()
    assert [tuple(r) for r in got.groupBy("seq", "accepted", "rev").count().orderBy("seq").collect()] == [(0, True, 1, 20_000), (1, False, 1, 20_000), (2, True, 2, 20_000)]
