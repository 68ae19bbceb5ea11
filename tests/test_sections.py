"""Chunks, sweeps, repeats and track segments against plain loops."""

import random

from pyspark.sql import functions as F

from chronoloom.operators import chains, sections

BY = ["plan_id"]


def plain_chunks(words, seconds, look, clear, lead):
    """(first, last, start, end) by walking through the words once."""
    out, first, begin, i = [], 0, max(0.0, words[0][0] - lead), 0
    while i < len(words):
        if words[i][1] - begin >= seconds and i + 1 < len(words):
            best, at = -1.0, i
            for j in range(i, min(i + look, len(words) - 1)):
                gap = words[j + 1][0] - words[j][1]
                if gap > best:
                    best, at = gap, j
                if gap >= clear:
                    break
            cut = (words[at][1] + words[at + 1][0]) / 2
            out.append((first, at, begin, cut))
            first, begin, i = at + 1, cut, at + 1
            continue
        i += 1
    if first < len(words):
        out.append((first, len(words) - 1, begin, None))
    return out


def timed(rng, n):
    t, words = rng.choice([0.0, 0.1, 3.0]), []
    for _ in range(n):
        end = t + rng.choice([0.125, 0.25, 0.5])
        words.append((t, end))
        t = end + rng.choice([0.0, 0.0, 0.0625, 0.25, 0.5, -0.0625])
    return words


def chunked(spark, plans, *args):
    rows = spark.createDataFrame([(p, i, a, b) for p, w in plans.items() for i, (a, b) in enumerate(w)], "plan_id long, word_i long, start double, end double")
    got = {}
    for r in chains.chunks_at_gaps(rows, BY, *args).orderBy("plan_id", "chunk").collect():
        got.setdefault(r.plan_id, []).append((r["first"], r["last"], r.start, r.end))
    return got


def test_chunks_are_those_of_the_loop(spark):
    rng = random.Random(5)
    plans = {p: timed(rng, rng.choice([1, 2, 5, 60, 300])) for p in range(60)}
    for args in ((3.0, 12, 0.35, 0.2), (0.0, 3, 9.0, 0.2), (1e9, 12, 0.35, 0.2)):
        assert chunked(spark, plans, *args) == {p: plain_chunks(w, *args) for p, w in plans.items()}


def test_chunks_of_one_very_long_plan(spark):
    rng = random.Random(6)
    w = timed(rng, 300_000)
    assert chunked(spark, {1: w, 2: w[:3]}, 5.0, 12, 0.35, 0.2) == {1: plain_chunks(w, 5.0, 12, 0.35, 0.2), 2: plain_chunks(w[:3], 5.0, 12, 0.35, 0.2)}


def test_chains_of_any_length(spark):
    rng = random.Random(7)
    links = [(k, i, rng.choice([None, *range(i + 1, min(i + 4, 100))]) if i < 99 else None) for k in range(40) for i in range(100)] + [(99, i, i + 1) for i in range(1000)]
    want = set()
    to = {(k, i): j for k, i, j in links}
    for k in [*range(40), 99]:
        i = 0
        while i is not None:
            want.add((k, i))
            i = to.get((k, i))
    rows = spark.createDataFrame(links, "k long, i long, j long")
    got = chains.chained(rows, rows.where("i = 0"), ["k"], "i", "j").collect()
    assert len(got) == len(want) and {tuple(r) for r in got} == want
    assert chains.chained(rows.limit(0), rows.limit(0), ["k"], "i", "j").count() == 0


def test_stretches_that_are_exclusive(spark):
    rng = random.Random(8)
    rows = [(p, p * 100 + i, a, a + rng.randint(-1, 9)) for p in range(20) for i in range(12) for a in [rng.randint(0, 30)]]
    df = spark.createDataFrame([(p, i, float(a), float(b)) for p, i, a, b in rows], "plan_id long, id long, start double, end double")
    got = {}
    for r in sections.exclusive_stretches(df, BY, "id").collect():
        for t in range(int(r.start), int(r.end)):
            got[r.plan_id, t] = r.id
    want = {}
    for p in range(20):
        for t in range(60):
            own = [i for q, i, a, b in rows if q == p and a <= t < b]
            if len(own) == 1:
                want[p, t] = own[0]
    assert got == want


def plain_segments(samples, cuts, most):
    out, last, n = {}, None, -1
    for i, (f, cx, w) in enumerate(samples):
        if cx is None:
            continue
        if last is None or i - last > most or abs(cx - samples[last][1]) > max(0.1, 1.2 * samples[last][2]) or max(w, samples[last][2]) / min(w, samples[last][2]) > 1.6 or any(samples[last][0] < c <= f for c in cuts):
            n += 1
        out[i], last = n, i
    return out


def test_segments_and_what_they_reach(spark):
    rng = random.Random(9)
    samples = {p: [(4 * i, rng.choice([None, 0.2, 0.25, 0.3, 0.9]), rng.choice([0.1, 0.12, 0.3])) for i in range(50)] for p in range(15)}
    cuts = {p: rng.sample(range(200), 3) for p in range(15)}
    rows = spark.createDataFrame([(p, i, f, x, None if x is None else 0.5, w) for p, s in samples.items() for i, (f, x, w) in enumerate(s)], "plan_id long, idx long, frame long, cx double, cy double, w double")
    marks = spark.createDataFrame([(p, c) for p, cs in cuts.items() for c in cs], "plan_id long, frame long")
    found = sections.segments(rows, marks, BY, 2)
    own = {p: plain_segments(s, cuts[p], 2) for p, s in samples.items()}
    assert {(r.plan_id, r.idx): r.segment for r in found.collect()} == {(p, i): n for p, s in own.items() for i, n in s.items()}
    plans = spark.createDataFrame([(p, 200) for p in samples], "plan_id long, frames long")
    got = {(r.plan_id, r.frame): r.segment for r in sections.reached_frames(found, marks, plans, BY, 4, 2).collect()}
    for p, s in own.items():
        spans = [[4 * i for i, m in s.items() if m == n] for n in sorted(set(s.values()))]
        inside = {f: n for n, x in enumerate(spans) for f in range(x[0], x[-1] + 1)}
        assert all(got[p, f] == n for f, n in inside.items())  # every frame of a segment is its own
        for f in range(200):
            n = got.get((p, f))
            if n is not None and f not in inside:
                assert not any(min(f, spans[n][0]) < c <= max(f, spans[n][-1]) for c in cuts[p])  # and nothing reaches over a cut
                assert min(abs(f - spans[n][0]), abs(f - spans[n][-1])) <= 4


def test_quiet_bars(spark):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate([0.1, 0.1, 0.9, 0.1, 0.9, 0.0, 0.0, 0.0])] + [(2, 0, 1.0)], "plan_id long, bar long, level double")
    assert {(r.plan_id, r.quiet, r.runs) for r in sections.quiet_bars(rows, BY, 0.2).collect()} == {(1, 5, 2), (2, 0, 0)}


def test_a_repeat_is_found_at_its_lag(spark):
    """Eight bars that come twice, all different: the pair at lag 8 is as alike as can be, and shorter ones aren't looked at."""
    rng = random.Random(10)
    theme = [[rng.random() for _ in range(12)] for _ in range(8)]
    rows = [(1, i, float(i), theme[i % 8], 0.5, 100.0, 0.9) for i in range(16)]
    df = spark.createDataFrame(rows, "plan_id long, bar long, start double, feature array<double>, energy double, last double, level double")
    r = sections.repeats(df, BY).first()
    assert (r.second - r["first"], r.lag, r.gate) == (8.0, 8, 0) and r.score > 1.6
    assert sections.repeats(df.where("bar = 0"), BY).count() == 0
    assert sections.repeats(df.withColumn("level", F.lit(0.1)), BY).first().gate == 1
