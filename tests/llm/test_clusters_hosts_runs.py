"""Clusters, host rules and periodic runs: against their SQL, plain loops and odd tables."""

import hashlib
import math
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from oracle import check

from chronoloom.llm import centroids, host_rules, periodic_runs, queries

SCHEMA = "doc_id long, text string, source string, host string, runs int, rejected map<string,array<map<string,int>>>"


@pytest.mark.parametrize("name", ["op11_centroids", "op12_host_rules", "op13_periodic_runs"])
def test_same_rows_as_sql(spark, sf, name):
    check(queries.queries()[name](spark, sf), queries.oracle_sql()[name], sf)


# clusters


def plain_clusters(rows, k, rounds, components):
    good = [(i, [math.floor(1024 * x) for x in v]) for i, v in rows if v is not None and len(v) == components and all(x is not None and math.isfinite(x) and abs(x) < 2**52 for x in v)]
    digest = lambda i: (i is None, hashlib.sha256(f"3:{i}".encode()).hexdigest())
    cs = [v for _, v in sorted(good, key=lambda r: (digest(r[0]), r[1]))[:k]]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b, strict=True))
    near = lambda v: min((far(v, c), j) for j, c in enumerate(cs))
    for _ in range(rounds):
        groups = [[] for _ in cs]
        for _, v in good:
            groups[near(v)[1]].append(v)
        cs = [[sum(x) // len(g) for x in zip(*g, strict=True)] if g else c for g, c in zip(groups, cs, strict=True)]
    fits = lambda x: x if x is not None and x < 2**63 else None
    told = [(i, j, d, hashlib.sha256(",".join(map(str, cs[j])).encode()).hexdigest()) for i, v in good for d, j in [near(v)]]
    sums, known = Counter(), Counter()
    for _, j, d, _ in told:
        sums[j] += d
        known[j] += fits(d) is None
    by = {j: fits(sums[j]) if not known[j] else None for j in sums}
    total = None if None in by.values() else fits(sum(by.values()))
    return sorted(((i, j, fits(d), by[j], total, x) for i, j, d, x in told), key=repr)


def embedded(spark, rows, kind="double"):
    return spark.createDataFrame([(i, v, 1, {"a": [1]}) for i, v in rows], f"vec_id long, embedding array<{kind}>, cluster int, distance map<string,array<int>>")


def test_clusters_against_all_distances(spark):
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=4).round(2).tolist()) for i in range(120)]
    rows += [(1000 + i, [0.5, 0.5, 0.0, 0.0]) for i in range(30)] + rows[:5] + [(None, [0.1, 0.2, 0.3, 0.4]), (7, None), (8, []), (9, [1.0, None, 1.0, 1.0]), (10, [math.nan, 1.0, 1.0, 1.0])]
    rows += [(11, [math.inf, 0.0, 0.0, 0.0]), (12, [1.0, 2.0, 3.0]), (13, [0.0, 0.0, 0.0, -math.inf]), (14, [2.0**52, 0.0, 0.0, 0.0])]
    got = centroids.clusters(embedded(spark, rows).repartition(3), k=5, rounds=4, components=4)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 5, 4, 4)


@pytest.mark.parametrize("size", [1.0, 3000.0, 2e5, 1e9, 1e15])
def test_clusters_of_any_size_of_numbers(spark, size):
    rng = np.random.default_rng(6)
    rows = [(i, (rng.normal(size=3) * size).clip(-4e15, 4e15).tolist()) for i in range(40)]
    got = centroids.clusters(embedded(spark, rows), k=4, rounds=3, components=3)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 4, 3, 3)


def test_clusters_of_few_and_of_none(spark):
    assert centroids.clusters(embedded(spark, []), components=3).collect() == []
    assert centroids.clusters(embedded(spark, [(1, [1.0]), (2, None)]), components=3).collect() == []
    rows = [(1, [0.5, 0.5, 0.5]), (2, [0.5, 0.5, 0.5]), (2, [0.25, 0.0, 1.0])]
    got = centroids.clusters(embedded(spark, rows, "float"), components=3)
    assert sorted(map(tuple, got.collect()), key=repr) == plain_clusters(rows, 8, 10, 3)


@settings(max_examples=60, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 40), st.sampled_from([3, 40, 10**6, 10**9]))
def test_annulus_finds_the_nearest_and_ties(seed, k, size):
    rng = np.random.default_rng(seed)
    cs = rng.integers(-size, size + 1, (k, 2)).tolist()
    cs += [[-a, b] for a, b in cs[: k // 2]]  # of equal norm: ties on the edge
    x = rng.integers(-size, size + 1, (50, 2))
    x[:10, 0] = 0
    number, least = centroids.Annuli(cs).nearest(x)
    for v, j, d in zip(x.tolist(), number.tolist(), least.tolist(), strict=True):
        assert (d, j) == min((sum((int(a) - b) ** 2 for a, b in zip(v, c, strict=True)), i) for i, c in enumerate(cs))


def test_annulus_leaves_out_centroids_of_other_norms():
    annuli = centroids.Annuli([[100 * i, 0] for i in range(100)])
    assert len(annuli.probes) <= 11
    assert annuli.nearest(np.array([[5003, 1]]))[0].tolist() == [50]
    first, end = annuli.annulus(np.array([5003.0]), np.array([500.0]))
    assert (end - first).tolist() == [10]


# host rules


def plain_measures(text):
    words = [w.decode() for w in (text or "").encode().split()]
    windows = Counter(zip(words, words[1:], words[2:], strict=False))
    twice = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), sum(x in lines[:i] for i, x in enumerate(lines)), len(twice), len(lines)


@settings(max_examples=150, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "é", "漢字", " ", " ", "\n", "\t", "\x0b", "\x1c", " ", "#", "<|>", "a a a a", "x y z x y z"]), max_size=60))
def test_measures_against_plain_counting(parts):
    text = "".join(parts)
    assert host_rules.measured(text) == plain_measures(text)


def plain_quality(rows):
    """The whole operator over (doc_id, text, host), in floats of Python."""
    each = [(i, h, *plain_measures(t)) for i, t, h in rows]
    fails = {
        "short": lambda m: m[0] < 50, "repeats": lambda m: 100 * m[4] > 50 * m[0], "lines": lambda m: 100 * m[3] > 30 * m[5], "symbols": lambda m: 10 * m[2] > m[0],
        "lengths": lambda m: m[1] < 2 * m[0] or m[1] > 15 * m[0],
    }
    docs = Counter(h for _, h, *_ in each if h is not None)
    rejected = {h: [] for h in docs}
    for name, rule in fails.items():
        bad = Counter(h for _, h, *m in each if h is not None and rule(m))
        size, k, m = sum(docs.values()), len(docs), sum(bad.values()) / sum(docs.values())
        spread = sum(docs[h] * (bad[h] / docs[h] - m) ** 2 for h in docs)
        room = m * (1 - m) * (size - sum(n * n for n in docs.values()) / size - k + 1)
        between = min(max((spread - m * (1 - m) * (k - 1)) / room if room > 0 else 1e-6, 1e-6), 0.5)
        a, b = m * (1 / between - 1), (1 - m) * (1 / between - 1)
        for h in docs:
            if (bad[h] + a) / (docs[h] + a + b) >= 0.5:
                rejected[h].append(name)
    return sorted(((i, *m[:5], fails["short"](m) or fails["repeats"](m), not (fails["short"](m) or fails["repeats"](m) or rejected.get(h)), h, docs.get(h), rejected.get(h)) for i, h, *m in each), key=repr)


def test_quality_by_host(spark):
    rng = np.random.default_rng(3)
    prose = lambda n: " ".join("w" + str(x) for x in rng.integers(0, 10**6, n))
    rows = [(i, prose(80), "good") for i in range(60)] + [(100 + i, prose(10), "good") for i in range(4)]
    rows += [(200 + i, prose(60) + " ##" * 20, "shop") for i in range(30)] + [(300 + i, prose(60), "shop") for i in range(5)]  # three words in four documents fail by symbols
    rows += [(400, prose(60) + " $$" * 20, "small"), (401, prose(300), "small2"), (402, "line a b c\n" * 40, "good"), (403, "", "empty"), (404, None, "empty"), (405, prose(70), None), (None, prose(70), ""), (406, None, None)]
    rows += [rows[0], rows[0], (407, "x " * 200_000, "good"), (408, prose(50_000), "good")]
    df = spark.createDataFrame([(*r, "h", 3, None) for r in rows], SCHEMA).repartition(5)
    got = host_rules.quality(df)
    assert sorted((tuple(r) for r in got.collect()), key=repr) == plain_quality(rows)
    kept = {r.doc_id: r.kept for r in got.collect()}
    assert not kept[300] and kept[0] and kept[401] and not kept[402] and kept[405]  # a rejected host's documents go, whatever they are
    told = {r.host: r.host_rejected for r in got.collect()}
    assert told["shop"] == ["symbols"] and told["good"] == []


def test_a_small_host_is_judged_by_the_others(spark):
    """One failing document of one: where hosts are alike that says little, where they differ much it says a lot."""
    text = lambda bad: " ".join(f"w{i}" for i in range(60)) + " ##" * 20 * bad
    alike = [(i, text(i % 10 == 0), f"h{i // 20}") for i in range(400)]
    apart = [(i, text(i // 20 % 5 == 0), f"h{i // 20}") for i in range(400)]
    for rows, verdict in ((alike, []), (apart, ["symbols"])):
        rows = [*rows, (1000, text(True), "small")]
        got = host_rules.quality(spark.createDataFrame([(*r, "h", 3, None) for r in rows], SCHEMA))
        assert sorted(map(tuple, got.collect()), key=repr) == plain_quality(rows)
        assert {r.doc_id: r.host_rejected for r in got.collect()}[1000] == verdict


def test_many_hosts_are_looked_up_by_shuffle(spark, monkeypatch):
    rows = [(i, "a b c d " * 20, f"h{i % 7}") for i in range(50)]
    df = spark.createDataFrame([(*r, "h", 3, None) for r in rows], SCHEMA)
    few = sorted(map(repr, host_rules.quality(df).collect()))
    monkeypatch.setattr(host_rules, "BROADCAST_ROWS", 2)
    assert sorted(map(repr, host_rules.quality(df).collect())) == few


def test_quality_of_nothing_and_of_alike_hosts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert host_rules.quality(empty).collect() == []
    alike = spark.createDataFrame([(i, "a b", "one", None, None, None) for i in range(3)], SCHEMA)
    assert [(r.kept, r.host_rejected) for r in host_rules.quality(alike).collect()] == [(False, ["short", "lengths"])] * 3
    nowhere = spark.createDataFrame([(1, "a b", None, None, None, None)], SCHEMA)
    assert [(r.kept, r.host_rejected) for r in host_rules.quality(nowhere).collect()] == [(False, None)]


# periodic runs


def plain_runs(w):
    found = {}
    for q in range(1, len(w) // 4 + 1):
        i = 0
        while i + q < len(w):
            j = i
            while j + q < len(w) and w[j] == w[j + q]:
                j += 1
            if j + q - i >= max(6, 4 * q):
                found.setdefault((i, j + q - i), q)
            i = max(i + 1, j)
    return sorted((s, n, q) for (s, n), q in found.items())


words = st.lists(st.sampled_from([b"a", b"b", b"c"]), max_size=14)
blocks = st.lists(st.tuples(words, st.integers(1, 9)), max_size=6)


@settings(max_examples=250, deadline=None)
@given(st.lists(blocks, min_size=1, max_size=4))
def test_runs_against_trying_all_periods(texts):
    texts = [[w for block, n in x for w in block * n] for x in texts]
    assert periodic_runs.find_runs(texts) == [plain_runs(x) for x in texts]


def test_runs_inside_runs():
    inner = [b"a"] * 7 + [b"b"]
    nested = (inner * 5 + [b"c"]) * 6
    fib = [b"a", b"ab"]
    while len(fib[-1]) < 600:
        fib.append(fib[-1] + fib[-2])
    texts = [nested, [bytes([x]) for x in fib[-1]], [b"x"] * 2000, [b"x", b"y"] * 900, []]
    assert periodic_runs.find_runs(texts) == [plain_runs(x) for x in texts]


@pytest.mark.parametrize("text", [[b"x"], [b"x", b"y"], [b"x"] * 50 + [b"y"], [str(i).encode() for i in range(997)]])
def test_work_on_repetitive_texts_is_near_linear(monkeypatch, text):
    """The elements that Z-functions look at, for a text and for one eight times as long."""
    seen, plain = [], periodic_runs.z_function

    def counted(s):
        seen.append(len(s))
        return plain(s)

    monkeypatch.setattr(periodic_runs, "z_function", counted)
    work = []
    for n in (5_000, 40_000):
        seen.clear()
        periodic_runs.find_runs([(text * (n // len(text) + 1))[:n]])
        work.append(sum(seen))
    assert work[1] <= 12 * work[0] and work[1] <= 40_000 * 4 * 15


def plain_digests(doc_id, text):
    w = (text or "").encode().split()
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(w), h // 10
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [x if i < a else w[a + (i - a) % p] for i, x in enumerate(w)]
    runs = plain_runs(w)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    s, m, q = min(runs, key=lambda r: (-r[1], r[0], r[2])) if runs else (None, None, None)
    sha = lambda x: hashlib.sha256(x).hexdigest()
    lines = "".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()
    return doc_id, len(runs), s, m, q, 1000 * m // q if runs else None, sha(lines), sha(b" ".join(x for i, x in enumerate(w) if i not in gone)), n


def test_run_digests(spark):
    rng = np.random.default_rng(4)
    texts = [None, "", " \n", "a", "ha " * 30, "x y " * 9 + "z " * 9, "é漢 é漢 x\x1cy " * 8, *(" ".join(map(str, rng.integers(0, 40, rng.integers(1, 90)))) for _ in range(120))]
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, "b " * 8), (3, "a"), (3, "a"), (-5, "c d " * 20)]
    df = spark.createDataFrame([(i, t, "s", "h", 3, {"k": [{"z": 1}]}) for i, t in rows], SCHEMA).repartition(3)
    got = sorted((tuple(r) for r in periodic_runs.run_digests(df).collect()), key=repr)
    assert got == sorted((plain_digests(*r) for r in rows), key=repr)
    assert periodic_runs.run_digests(df.limit(0)).collect() == []


def test_runs_of_a_very_long_text(spark):
    text = " ".join(str(i * 7919 % 10_007) for i in range(300_000)) + " end" * 100_000
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    got = periodic_runs.periodic_runs(df).first()
    assert [tuple(r) for r in got.runs] == [(0, 300_000, 10_007), (300_000, 100_000, 1)] and got.n_words == 400_000
    assert got.collapsed == " ".join(str(i * 7919 % 10_007) for i in range(10_007)) + " end"
