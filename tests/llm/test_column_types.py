"""Columns of any type beside the text: nested maps, variants and structs of them, through the operators and all stages."""

import pytest
from pyspark.sql import functions as F

from chronoloom.llm import common, decontamination, exact_dedup, near_texts

ROWS = [
    (1, "the quick brown fox jumps over the lazy dog and runs far away from here", '{"a": {"x": 1, "y": 2}, "b": null}', 3),
    (2, "the quick brown fox jumps over the lazy dog and runs far away from here", '{"b": null, "a": {"y": 2, "x": 1}}', 3),
    (2, "The quick brown fox jumps over the lazy dog and runs far away from here", '{"b": null, "a": {"y": 2, "x": 1}}', 3),
    (3, "another text of its own with more than a few words in it to look at", None, None),
    (3, "another text of its own with more than a few words in it to look at", None, None),
    (None, None, "{}", 0),
]


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(ROWS, "doc_id long, text string, j string, n int")
    nested = F.from_json("j", "map<string,map<string,int>>")
    return rows.select(
        "doc_id", "text", nested.alias("_k1"), F.array(nested, F.lit(None).cast("map<string,map<string,int>>")).alias("root"), F.try_parse_json("j").alias("hash"),
        F.array(F.struct(F.try_parse_json("j").alias("v"), F.create_map(F.lit("k"), F.array(nested)).alias("m"))).alias("_row"), F.when(F.col("n") > 0, F.struct(nested.alias("deep"))).alias("kind"),
    )


def test_keys_go_by_content(docs):
    rows = docs.select("doc_id", "text", *(k.alias(n) for k, n in zip(common.row_key(docs), ("a", "b"), strict=True))).collect()
    by = {}
    for r in rows:
        by.setdefault((r.doc_id, r.text), set()).add((r.a, r.b))
    assert all(len(x) == 1 for x in by.values()) and len({next(iter(x)) for x in by.values()}) == len(by) == 5
    changed = docs.where("doc_id = 1").withColumn("_k1", F.from_json(F.lit('{"a": {"x": 1, "y": 3}}'), "map<string,map<string,int>>"))
    assert changed.select(*common.row_key(changed)).first() != docs.where("doc_id = 1").select(*common.row_key(docs)).first()


def test_order_of_entries_does_not_matter(spark):
    rows = spark.createDataFrame([('{"a": {"x": 1, "y": 2}, "b": {}}',), ('{"b": {}, "a": {"y": 2, "x": 1}}',)], "j string")
    typed = rows.select(F.from_json("j", "map<string,map<string,int>>").alias("m"), F.array(F.from_json("j", "map<string,map<string,int>>")).alias("a"))
    assert typed.select(*common.row_key(typed)).distinct().count() == 1


def test_operators_take_them(spark, docs):
    assert exact_dedup.exact_dedup(docs).count() == len(ROWS)
    left = exact_dedup.drop_exact(docs).collect()
    assert sorted((r.doc_id or 0) for r in left) == [0, 2, 3] and exact_dedup.drop_exact(docs).columns == docs.columns
    near = near_texts.drop_near(docs).collect()
    assert sorted((r.doc_id or 0) for r in near) == [0, 2, 3]
    items = spark.createDataFrame([(7, "another text of its own with more than a few words in it to look at")], "item_id long, text string")
    assert {r.doc_id for r in decontamination.leaks(docs, items).collect()} == {3}
    assert {r.doc_id for r in decontamination.drop_leaks(docs, items).collect()} == {1, 2, None}


def test_the_pipeline_takes_them(spark, docs, tmp_path):
    import corpus_pipeline as p

    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "nothing of that sort is found in these documents at all")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert {r.doc_id for r in p.run(spark, str(tmp_path)).collect()} == {2, 3, None}


def test_the_scan_of_exact_dedup_reads_two_columns(spark, sf):
    plan = exact_dedup.text_digests(spark.read.parquet(f"{sf}/documents.parquet"))._jdf.queryExecution().executedPlan().toString()
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan
