"""Exact and near copies, leaks and the graph: against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from chronoloom.llm import decontamination, exact_dedup, graph, near_texts, shingles, simhash
from chronoloom.llm.queries import OP2_SQL

SCHEMA = "doc_id long, text string, _row string, _run int, keep_id int, hash int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, "x", 1, 2, 3) for i, t in rows], SCHEMA)


def prose(rng, n):
    return " ".join("".join(rng.choices("abcdefgh", k=rng.randint(2, 7))) for _ in range(n))


def test_exact_dedup_against_sql(spark, sf):
    from oracle import check

    check(exact_dedup.exact_dedup(spark.read.parquet(f"{sf}/documents.parquet")), OP2_SQL, sf)


def test_exact_dedup_of_odd_rows(spark):
    rows = [(1, "Ab"), (2, "aB"), (3, "É"), (4, "é"), (5, None), (6, ""), (7, "x" * 100_000), (7, "x" * 100_000), (None, "ab"), (None, "alone"), (9, "ab ")]
    got = exact_dedup.exact_dedup(frame(spark, rows)).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r for r in got if r.doc_id is not None}
    assert (by[1].keep_id, by[1].group_size, by[1].kept, by[2].kept) == (2, 3, False, True)
    assert by[3].group_size == by[4].group_size == by[9].group_size == 1 and by[5].keep_id == 6
    assert sum(r.kept for r in got) == len({r.text_sha256 for r in got}) == 7
    kept = exact_dedup.drop_exact(frame(spark, rows))
    assert kept.columns == ["doc_id", "text", "_row", "_run", "keep_id", "hash"] and kept.count() == 7
    smallest = exact_dedup.exact_dedup(frame(spark, rows), largest=False)
    assert {r.keep_id for r in smallest.where("doc_id in (5, 6)").collect()} == {5}
    assert exact_dedup.exact_dedup(frame(spark, [])).count() == 0


def test_fingerprints(spark):
    for text in ["", "one", "a b c", "a b c d", "A b  c\td\x0be \x85f", "x y " * 3000]:
        found = [w for w in __import__("re").findall("[^\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text))]
        shingles = [" ".join(found[i : i + 4]) for i in range(max(1, len(found) - 3))] if found else []
        h = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
        bits = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
        assert simhash.fingerprint(simhash.hashes(text)) % (1 << 64) == bits


def roots(links):
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {x: find(x) for x in up}


@pytest.mark.parametrize("k", [1, 4, 7])
def test_linked_roots_against_all_pairs(spark, k):
    rng = random.Random(k)
    fps = {rng.getrandbits(64) for _ in range(60)} | {0}
    for x in list(fps):
        for _ in range(5):
            y = x
            for _ in range(rng.randint(1, 9)):
                y ^= 1 << rng.randrange(64)
            fps.add(y)
    dense = rng.getrandbits(64)  # one group of very many, and some just beyond it
    for n in [1] * 60 + [2] * 500 + [3] * 300 + [k + 1] * 200:
        fps.add(dense ^ sum(1 << b for b in rng.sample(range(64), n)))
    signed = np.array(sorted(x - (x >> 63 << 64) for x in fps), np.int64)
    got = {r.fp: r.root for r in simhash.link_roots(spark.createDataFrame([(int(x),) for x in signed], "fp long"), k).collect()}
    a, b = np.nonzero(np.bitwise_count(signed.view(np.uint64)[:, None] ^ signed.view(np.uint64)[None, :]) <= k)
    assert got == roots([(int(signed[x]), int(signed[y])) for x, y in zip(a, b)])


def test_components_against_union_find(spark):
    rng = random.Random(2)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000, 2000 + i) for i in range(1, 200)]
    links = [(a, b) for a, b in links if a != b]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == roots(links)
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("size", [7, 150, 400])
def test_components_of_many_blocks(spark, size):
    """Blocks leave links between them to the stars; or so few that one block is enough; or all fit in one."""
    rng = random.Random(size)
    links = [(rng.randrange(-300, 300), rng.randrange(-300, 300)) for _ in range(150)] + [(1000 + i, 1001 + i) for i in range(60)] + [(2000 + i, 2000 + j) for i in range(12) for j in range(i)]
    rng.shuffle(links)
    links = [(a, b) for a, b in links if a != b]
    got = graph.components(spark.createDataFrame(links, "a long, b long").repartition(3), size).collect()
    assert len(got) == len({r.node for r in got}) and {r.node: r.root for r in got} == roots(links)


def test_fingerprints_are_linked_by_few_jobs(spark):
    """What a round of jobs leaves in the driver adds up: whole rounds of stars for a few links took it over its memory."""
    rng = random.Random(6)
    fps = [rng.getrandbits(63) for _ in range(200)]
    fps += [x ^ 1 << rng.randrange(63) for x in fps]
    spark.sparkContext.setJobGroup("few jobs", "")
    try:
        got = simhash.link_roots(spark.createDataFrame([(x,) for x in sorted(set(fps))], "fp long"), 4).collect()
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len({r.root for r in got}) == 200
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup("few jobs"))
    assert jobs < 80, jobs


def test_near_duplicates_against_brute_force(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    docs = docs.union(spark.createDataFrame([(5001, ""), (5002, None), (5003, "One"), (5003, "One"), (None, "one")], docs.schema))
    rows = docs.collect()
    fps = [simhash.fingerprint(simhash.hashes(r.text or "")) % (1 << 64) for r in rows]
    u, inverse = np.unique(np.array(fps, np.uint64), return_inverse=True)
    a, b = np.nonzero(np.bitwise_count(u[:, None] ^ u[None, :]) <= 4)
    root = roots([(int(x), int(y)) for x, y in zip(a, b)])
    least: dict = {}
    for r, i in zip(rows, inverse):
        if r.doc_id is not None:
            least[root[int(i)]] = min(r.doc_id, least.get(root[int(i)], r.doc_id))
    expected = sorted(((r.doc_id or -1), f"{f:016x}", least.get(root[int(i)])) for r, f, i in zip(rows, fps, inverse))
    got = simhash.near_duplicates(docs)
    assert sorted(((r.doc_id or -1), r.fingerprint, r.component_id) for r in got.collect()) == expected
    assert simhash.near_duplicates(docs.limit(0)).count() == 0


def test_near_copies_go_and_others_stay(spark):
    rng = random.Random(8)
    rows, group = [], 0
    for i in range(25):
        words = prose(rng, 220).split()
        rows.append((3 * i, " ".join(words)))
        if i < 15:
            for j in (1, 2):
                other = list(words)
                for at in rng.sample(range(len(words)), 3):
                    other[at] = "changed"
                rows.append((3 * i + j, " ".join(other)))
                group += 1
    docs = frame(spark, rows)
    kept = [r.doc_id for r in near_texts.drop_near(docs).collect()]
    assert len(kept) <= 25 + group // 10 and len({i // 3 for i in kept}) == 25
    assert near_texts.drop_near(docs).columns == docs.columns
    assert near_texts.drop_near(docs.limit(0)).count() == 0


def naive_set(text):
    words = [w for w in __import__("re").split("[\x20\x09-\x0d]+", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)) if w]
    return {tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def test_shingle_sets_are_those_of_plain_code():
    rng = random.Random(2)
    texts = ["", " ", "one", "A b\tC d", "a b c d e", "a b c d e f A B c D E", "é\x85x \u3000y z w v", prose(rng, 3000), *(prose(rng, rng.randint(1, 90)) for _ in range(300)), "x " * 200_000, "w" * 700_000 + " b"]
    found = list(shingles.shingle_sets(texts))
    assert [len(x) for x in found] == [len(naive_set(t)) for t in texts]
    one, two = (next(iter(shingles.shingle_sets([t]))) for t in ("a b c d e f", "Z q A b  c d e\nf"))
    assert len(np.intersect1d(one, two)) == 2


def similarity(a, b):
    return len(a & b) / len(a | b) if a or b else 1.0


def test_groups_against_all_pairs(spark):
    """Random edits of few texts, a dense group of copies of one that are often less alike than 0.8 to one another, and texts just outside it."""
    rng = random.Random(11)
    texts = []
    for _ in range(12):
        words = prose(rng, rng.choice([40, 90])).split()
        texts += [" ".join(words)] + [" ".join(w if rng.random() > rate else "x" + w for w in words) for rate in (0.01, 0.02, 0.03, 0.05)]
    base = prose(rng, 150).split()
    texts += [" ".join(w if rng.random() > rate else f"y{rng.randrange(10**9)}" for w in base) for rate in [0.0] + [0.015] * 120 + [0.06] * 60]
    texts += ["", None, "  ", "one two", "One two"]
    sets = [naive_set(t or "") for t in texts]
    links = [(i, j) for i in range(len(texts)) for j in range(i) if similarity(sets[i], sets[j]) >= 0.8]
    by = roots(links + [(i, i) for i in range(len(texts))])
    got = near_texts.near_groups(frame(spark, list(enumerate(texts)))).collect()
    assert len(got) == len(texts)
    seen: dict = {}
    for r in got:
        seen.setdefault(r.root, set()).add(by[r.doc_id])
    assert all(len(x) == 1 for x in seen.values()) and len(seen) == len(set(by.values()))


def test_recall_of_the_near_stage(spark):
    """Of all pairs of texts of sf0.1 whose similarity is 0.8 or more all are in one group (0.9 at least is wanted)."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    rows = docs.collect()
    sets = list(shingles.shingle_sets([r.text or "" for r in rows]))
    held: dict = {}
    for i, x in enumerate(sets):
        # two sets of similarity 0.8 share one of the first fifth of either, in any order that both have
        for h in x[: len(x) - int(np.ceil(0.8 * len(x))) + 1].tolist():
            held.setdefault(h, []).append(i)
    pairs = {(i, j) for x in held.values() for i in x for j in x if i < j}
    near = [(i, j) for i, j in pairs if min(len(sets[i]), len(sets[j])) >= 0.8 * max(len(sets[i]), len(sets[j])) and (c := len(np.intersect1d(sets[i], sets[j], True))) >= 0.8 * (len(sets[i]) + len(sets[j]) - c)]
    of = {r.doc_id: r.root for r in near_texts.near_groups(docs).collect()}
    found = sum(of[rows[i].doc_id] == of[rows[j].doc_id] for i, j in near)
    assert len(near) > 300 and found >= 0.99 * len(near)


def test_what_stays_does_not_depend_on_how_files_are_split(spark, sf, tmp_path):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    docs.union(docs.limit(200)).repartition(12).write.parquet(f"{tmp_path}/d")
    own = spark.read.parquet(f"{tmp_path}/d")
    kept = []
    for drop in (exact_dedup.drop_exact, near_texts.drop_near):
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "12")
        left = drop(own)
        spark.conf.set("spark.sql.leafNodeDefaultParallelism", "2")
        got = left.collect()
        spark.conf.unset("spark.sql.leafNodeDefaultParallelism")
        kept.append(got)
    texts = {(r.text or "").lower() for r in docs.select("text").collect()}
    assert len(kept[0]) == len({r.text.lower() for r in kept[0]}) == len(texts)
    assert {r.doc_id for r in kept[1]} <= {r.doc_id for r in docs.select("doc_id").collect()} and len(kept[1]) == len({r.doc_id for r in kept[1]})


def test_rows_that_repeat_and_clashing_columns(spark):
    rows = [(1, "same text", "a", 1, 2), (1, "same text", "a", 1, 2), (1, "same text", "b", 1, 2), (None, "same text", "a", 1, 2), (2, None, None, None, None), (3, "", None, None, None), (3, "", None, None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _k1 string, _row int, root int")
    for drop in (exact_dedup.drop_exact, near_texts.drop_near):
        got = drop(docs).collect()
        assert drop(docs).columns == docs.columns and sorted((r.doc_id, r.text) for r in got) == [(1, "same text"), (3, "")]
        assert drop(docs.limit(0)).count() == 0


def test_runs_merge_in_binomial_rounds(spark):
    rng = random.Random(3)
    rows = [(i, f"k{rng.randrange(30)}", i, 0, rng.randrange(8)) for i in range(400)]
    digests = spark.createDataFrame(rows, "doc_id long, _sha string, _check long, _bytes int, _run int").withColumn("_check", F.lit(0).cast("long")).withColumn("_row", F.col("doc_id"))
    for largest, pick in ((True, max), (False, min)):
        first, last = exact_dedup.merge_runs(digests, 8, largest)
        got = {r["_sha"]: (r["_stays"]["doc_id"], r["_size"]) for r in last.collect()}
        by: dict = {}
        for i, k, *_ in rows:
            by.setdefault(k, []).append(i)
        assert got == {k: (pick(v), len(v)) for k, v in by.items()} and first.count() == len({(k, r) for _, k, _, _, r in rows})
    assert [exact_dedup.runs_for(n) for n in (0, 1 << 26, 1 << 27, 1 << 60)] == [64, 64, 128, 4096]


ITEM = "A farm near the river has 12 goats and Anna sells 3 of them to her cousin Bob for a fair price at noon"


def test_leaks_against_search(spark, sf):
    docs, items = (spark.read.parquet(f"{sf}/{n}.parquet") for n in ("documents", "benchmark"))
    got = {(r.doc_id, r.item_id) for r in decontamination.leaks(docs, items).where("exact").collect()}
    every = items.collect()
    assert got == {(d.doc_id, i.item_id) for d in docs.collect() for i in every if i.text in (d.text or "")}


def test_other_numbers_and_names_leak(spark):
    rng = random.Random(4)
    other = ITEM.replace("12", "950").replace("3", "41").replace("Anna", "Carla").replace("Bob", "Tim")
    mixed = ITEM.replace("Bob", "Anna")  # two people of the item became one
    docs = [(1, f"{prose(rng, 50)} {ITEM} {prose(rng, 50)}"), (2, f"Then. {other}"), (3, mixed), (4, prose(rng, 300)), (5, None), (6, ""), (7, ITEM.lower()), (None, ITEM), (8, f"{prose(rng, 40_000)}. {ITEM}"), (8, f"{prose(rng, 9)}. {ITEM}")]
    docs.append((9, other.replace("41", "950").replace("Tim", "Carla")))  # two numbers and two people of the item became one
    items = spark.createDataFrame([(1, ITEM, 0), (2, "too short", 0), (3, None, 0), (4, "7 8 9 10 11 12 13 14 15 16", 0)], "item_id long, text string, _row int")
    found = decontamination.leaks(frame(spark, docs), items).collect()
    assert sorted((r.doc_id or -1, r.item_id) for r in found) == [(-1, 1), (1, 1), (2, 1), (3, 1), (7, 1), (8, 1), (8, 1)]  # 3 has ten of seventeen windows word by word
    assert {r.doc_id: r.exact for r in found}[2] is False and {r.doc_id: r.exact for r in found}[1] is True
    left = decontamination.drop_leaks(frame(spark, docs), items)
    assert sorted(r.doc_id for r in left.collect()) == [4, 5, 6, 9] and left.columns == frame(spark, docs).columns
    assert decontamination.leaks(frame(spark, docs), items.limit(0)).count() == 0
    assert decontamination.leaks(frame(spark, []), items).count() == 0


def leaked(spark, docs, items):
    got = decontamination.leaks(frame(spark, docs), spark.createDataFrame(items, "item_id long, text string"))
    return sorted((r.doc_id, r.item_id) for r in got.collect())


def test_short_and_literal_poor_items(spark):
    rng = random.Random(5)
    items = [(1, "Why is it cold?"), (2, "What did the old man say?"), (3, "1 2 3 4 5 6 7 8 9 10 11 12"), (4, "ALL CAPITALS HERE MAKE NAMES OF EVERY WORD"), (5, "?!"), (6, "Yes")]
    docs = [(1, "why is it  cold"), (2, f"{prose(rng, 20)} why is it cold? {prose(rng, 9)}"), (3, f"{prose(rng, 30)} what did the OLD man say {prose(rng, 30)}"), (4, f"{prose(rng, 9)} 1 2 3 4 5 6 7 8 9 10 11 12 {prose(rng, 9)}")]
    docs += [(5, f"{prose(rng, 9)} all capitals here make names of every word"), (6, "what did the old woman say"), (7, "yes!"), (8, "yes and no"), (9, "")]
    assert leaked(spark, docs, items) == [(1, 1), (3, 2), (4, 3), (5, 4), (7, 6)]


def test_slots_of_more_words_and_long_quotes(spark):
    rng = random.Random(7)
    longer = ITEM.replace("12", "one hundred").replace("Anna", "Mary Ann")
    mixed = ITEM.replace("3", "12")  # two numbers of the item became one: the windows with both don't count
    long = prose(rng, 59)
    quote = " ".join(long.split()[14:44])
    other = long.split()
    other[28:28] = ["and"]  # a word more in the middle
    docs = [(1, longer), (2, f"{prose(rng, 12)} {quote} {prose(rng, 12)}"), (3, " ".join(other)), (4, " ".join(long.split()[:12])), (5, ITEM.upper()), (6, mixed.replace("Anna", "Bob"))]
    assert leaked(spark, docs, [(1, ITEM), (2, long)]) == [(1, 1), (2, 2), (3, 2), (5, 1)]


def test_many_items_of_a_template_and_a_hot_window(spark):
    """200 items of one template are one class; a window that they share with 300 other items meets no document that doesn't have an item's own windows."""
    rng = random.Random(9)
    template = [(i, f"A farm near the river has {i + 3} goats and sells {i + 500} of them to a cousin for a fair price at noon") for i in range(200)]
    opening = "which of the following answers is the best one here"
    others = [(1000 + i, f"{opening} {prose(rng, 25)}") for i in range(300)]
    docs = [(1, "Then a farm near the river has 7 goats and sells 77 of them to a cousin for a fair price at noon"), (2, f"{prose(rng, 5)} {others[4][1]} {prose(rng, 5)}")]
    docs += [(10 + i, f"{opening} {prose(rng, 40)}") for i in range(400)]
    got = decontamination.leaks(frame(spark, docs), spark.createDataFrame(template + others, "item_id long, text string")).collect()
    assert sorted((r.doc_id, r.item_id, r.items) for r in got) == [(1, 0, 200), (2, 1004, 1)]


def test_blocks_change_nothing(monkeypatch):
    rng = random.Random(1)
    texts = ["x y z w v u t s", " ".join(rng.choices(["aa", "Bb", "cc.", "12", "km", "dd", "-", "Ee"], k=1500)), "", "a b c"]

    def found():
        words = [(w, least) for b in decontamination.blocks(texts) for w, least in ((b.template, 4), (b.plain, 0))]
        return sorted((int(w.doc[i]), int(w.at[i]), int(h[i])) for w, least in words for h in [w.hashes(8)] for i in w.starts(8, least).tolist())

    whole = found()
    for words, group in ((50, 100), (20, 1), (400, 10)):
        monkeypatch.setattr(decontamination, "WORDS", words)
        monkeypatch.setattr(decontamination, "GROUP", group)
        assert found() == whole


def test_lookup_has_all_rows(spark):
    from chronoloom.llm.common import lookup

    rows = spark.range(2000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.col("id").cast("string")).alias("k"))
    got = lookup(rows, spark.createDataFrame([("hot", 1), ("3", 2)], "k string, v int"), ["k"], F.col("id"))
    assert (got.count(), got.where("v = 1").count(), got.where("v = 2").count()) == (2000, rows.where("k = 'hot'").count(), 1)


def test_added_and_cut_passages_are_near(spark):
    rng = random.Random(6)
    rows, copies = [], set()
    for i in range(60):
        words = prose(rng, rng.choice([60, 150, 400])).split()
        more = prose(rng, int(0.23 * (len(words) - 4))).split()
        at = rng.choice([0, len(words) // 2, len(words)])
        # in the middle an added block also breaks four shingles
        other = words[: int(0.85 * len(words))] if i % 3 == 0 else words[:at] + more[: len(more) - 8 * (at == len(words) // 2)] + words[at:]
        a, b = (set(simhash.hashes(" ".join(w), 5).tolist()) for w in (words, other))
        assert i % 3 or 0.8 <= len(a & b) / len(a | b) < 0.9
        rows += [(2 * i, " ".join(words)), (2 * i + 1, " ".join(other))]
        if len(a & b) >= 0.8 * len(a | b):
            copies.add(2 * i + 1)
    kept = {r.doc_id for r in near_texts.drop_near(frame(spark, rows)).collect()}
    assert len(copies) >= 50 and kept == set(range(120)) - {i - 1 for i in copies}


def test_only_similar_shingles_are_near(spark):
    rng = random.Random(9)
    rows, expected = [], set()
    for i in range(30):
        words = prose(rng, 200).split()
        shuffled = rng.sample(words, len(words))  # the same words, so the same fingerprint of words
        almost = words + prose(rng, 65).split()  # similarity 196 / 261 = 0.75
        close = words + prose(rng, 48).split()  # 196 / 244 = 0.803
        rows += [(4 * i + j, " ".join(w)) for j, w in enumerate((words, shuffled, almost if i % 2 else close))]
        expected |= {4 * i + 1, 4 * i + 2} | ({4 * i} if i % 2 else set())
    kept = {r.doc_id for r in near_texts.drop_near(frame(spark, rows)).collect()}
    assert kept == expected


def test_near_fingerprints_bring_texts_together(spark):
    """Without a band in common, texts are still found by fingerprints, and told apart by their sets."""
    rng = random.Random(4)
    words = prose(rng, 400).split()
    docs = frame(spark, [(1, " ".join(words)), (2, " ".join([*words, "more"])), (3, prose(rng, 400)), (4, None)])
    one, two = (simhash.fingerprint(simhash.hashes(" ".join(x))) % (1 << 64) for x in (words, [*words, "more"]))
    assert 0 < (one ^ two).bit_count() <= simhash.BITS
    rows = near_texts.rows_of(docs).withColumn("keys", F.when(F.size("keys") > 0, F.array("node")).otherwise(F.col("keys")))
    got = near_texts.groups(rows, docs).collect()
    assert len(got) == 2 and len({r.root for r in got}) == 1


def test_shuffle_files_go_with_their_query(spark):
    from chronoloom.llm import common

    before = spark.conf.get(common.CLEANUP, None)
    with common.scratch(spark):
        assert spark.conf.get(common.CLEANUP) == "true"
        held = common.cut(spark.range(100).groupBy((F.col("id") % 7).alias("k")).count())
        assert held.count() == 7
    assert spark.conf.get(common.CLEANUP, None) == before


def test_items_with_null_and_repeated_ids_leak(spark):
    rng = random.Random(3)
    short, long, nameless = (prose(rng, n) for n in (38, 59, 30))
    items = spark.createDataFrame([(1, short), (1, long), (None, nameless), (None, short)], "item_id long, text string")
    docs = [(1, f"{prose(rng, 20)} {short}"), (2, nameless), (3, prose(rng, 60))]
    found = [(r.doc_id, r.item_id, r.items, r.share) for r in decontamination.leaks(frame(spark, docs), items).collect()]
    assert sorted(found, key=str) == [(1, 1, 2, 1.0), (2, None, 1, 1.0)]  # equal texts are one item, with the least id
    assert [r.doc_id for r in decontamination.drop_leaks(frame(spark, docs), items).collect()] == [3]
