"""Schema-driven cleaning: items of many kinds against a catalog of their parameters.

The catalog has a row for each kind and parameter. One join brings an item's values and its kind's rules together; what comes out is
the cleaned items and, apart from them, what was wrong with them. Nothing raises.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.maths import finite
from ..sources.adapters import table

CATALOG = "kind string, param string, type string, low double, high double, step double, default double"
#: A catalog is broadcast up to so many rows; a larger one is joined by shuffling.
SMALL = 10_000


def event_catalog(spark: SparkSession) -> DataFrame:
    """What the parameters of the events' kinds may be; signup is no known kind."""
    rows = [("click", "k", "num", 10.0, 50.0, None, 10.0), ("view", "k", "num", 0.0, 80.0, 5.0, 0.0), ("error", "k", "num", None, None, None, 0.0), ("purchase", "k", "num", None, None, None, 0.0)]
    rows += [(k, "level", "num", 1.0, 200.0, None, 20.0) for k in ("click", "view", "error", "purchase")]
    return spark.createDataFrame(rows, CATALOG)


def event_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """event_id, kind, k and level, some of them no numbers."""
    level = F.when(F.col("event_id") % 11 == 0, "x").otherwise(F.col("value").cast("string"))
    return table(spark, sf_dir, "events").select("event_id", F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").alias("k"), level.alias("level"))


def coerced(value: Column, rule: Column) -> Column:
    """A value as its rule wants it: a finite number, inside low..high, on a step; the default where it is no number."""
    x = finite(value)
    x = F.when(rule["low"].isNull(), x).otherwise(F.greatest(x, rule["low"]))
    x = F.when(rule["high"].isNull(), x).otherwise(F.least(x, rule["high"]))
    x = F.when(finite(value).isNull(), None).otherwise(x)
    x = F.when(rule["step"].isNull(), x).otherwise(F.floor(x / rule["step"] + 0.5) * rule["step"])
    return F.coalesce(x, rule["default"])


def problem(value: Column, rule: Column) -> Column:
    x = finite(value)
    return F.when(value.isNotNull() & x.isNull(), "type").when((x < rule["low"]) | (x > rule["high"]), "range")


def normalised(items: DataFrame, catalog: DataFrame, params: list[str]) -> tuple[DataFrame, DataFrame]:
    """The items of known kinds with their params coerced, and the violations: the item's columns with param and problem."""
    by_kind = catalog.groupBy("kind").agg(F.map_from_entries(F.collect_list(F.struct("param", F.struct("low", "high", "step", "default")))).alias("_rules"))
    few = by_kind.limit(SMALL + 1).count() <= SMALL
    rows = items.join(F.broadcast(by_kind) if few else by_kind, "kind", "left")
    rule = {p: F.try_element_at("_rules", F.lit(p)) for p in params}
    known = rows.where("_rules is not null")
    clean = known.withColumns({p: coerced(F.col(p), rule[p]) for p in params}).drop("_rules")
    bad = F.filter(F.array(*(F.struct(F.lit(p).alias("param"), problem(F.col(p), rule[p]).alias("problem")) for p in params)), lambda x: x["problem"].isNotNull())
    unknown = F.array(F.struct(F.lit("kind").alias("param"), F.lit("unknown").alias("problem")))
    found = rows.withColumn("_v", F.explode(F.when(F.col("_rules").isNull(), unknown).otherwise(bad))).select("*", "_v.param", "_v.problem").drop("_v", "_rules")
    return clean, found
