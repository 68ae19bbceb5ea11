"""Names, links and items resolved against each other by cascades of equi joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def resolved(wanted: DataFrame, names: DataFrame, aliases: DataFrame) -> DataFrame:
    """wanted (name) with found: the name itself, else without a numeric suffix, else by alias, else the longest known prefix of it.

    names has name, aliases alias and name. Each tier is an equi join; prefixes are joined by the prefix, not by comparing all pairs.
    """
    bare = F.regexp_replace("name", r"[_-]?[0-9]+$", "")
    prefixes = F.transform(F.sequence(F.lit(1), F.greatest(F.length("name"), F.lit(1))), lambda n: F.substring("name", F.lit(1), n))
    tries = wanted.select("name", F.lit(0).alias("tier"), F.lit(0).alias("size"), F.col("name").alias("try")).union(wanted.select("name", F.lit(1), F.lit(0), bare))
    tries = tries.union(wanted.select("name", F.explode(prefixes).alias("p")).select("name", F.lit(3), -F.length("p"), "p"))
    hits = tries.join(names.select(F.col("name").alias("try")).distinct(), "try").select("name", "tier", "size", F.col("try").alias("found"))
    by_alias = wanted.join(aliases.select(F.col("alias").alias("name"), F.col("name").alias("found")), "name").select("name", F.lit(2).alias("tier"), F.lit(0).alias("size"), "found")
    best = hits.union(by_alias).groupBy("name").agg(F.min_by("found", F.struct("tier", "size", "found")).alias("found"))
    return wanted.join(best, "name", "left")


def merged_links(links: DataFrame, by: list[str]) -> DataFrame:
    """Links (key, pos, primary, photo) once for each key: the first place, primary if any is, the first picture there is."""
    return links.groupBy(*by, "key").agg(F.min("pos").alias("pos"), F.bool_or("primary").alias("primary"), F.min_by("photo", F.when(F.col("photo").isNotNull(), F.col("pos"))).alias("photo"))


def unambiguous(links: DataFrame, by: list[str]) -> DataFrame:
    """links (handle, ambiguous) without the ambiguous ones whose handle a confirmed one has."""
    sure = links.where("not ambiguous").select(*by, F.lower("handle").alias("_h")).distinct()
    rows = links.withColumn("_h", F.lower("handle"))
    return rows.where("not ambiguous").union(rows.where("ambiguous").join(sure, [*by, "_h"], "left_anti").select(*rows.columns)).drop("_h")


def without_copies(items: DataFrame, locked: DataFrame, by: list[str], signature: str, share: float = 0.5) -> DataFrame:
    """items without those that have a locked item's content and overlap it by more than the share of the shorter one."""
    other = locked.select(*by, F.col(signature).alias("_s"), F.col("start").alias("_a"), F.col("end").alias("_b"))
    common = F.least(F.col("end"), F.col("_b")) - F.greatest(F.col("start"), F.col("_a"))
    shorter = F.least(F.col("end") - F.col("start"), F.col("_b") - F.col("_a"))
    same = items.withColumn("_s", F.col(signature)).join(other, [*by, "_s"]).where(common > share * shorter)
    return items.join(same.select(*by, "id").distinct(), [*by, "id"], "left_anti")


def renumbered(items: DataFrame, by: list[str], prefix: str) -> DataFrame:
    """items (ord, id) with ids that are missing or repeated replaced by prefix and numbers after the largest one in use."""
    w = Window.partitionBy(*by)
    rows = items.withColumn("_dup", F.row_number().over(Window.partitionBy(*by, "id").orderBy("ord")))
    bad = F.col("id").isNull() | (F.col("_dup") > 1)
    largest = F.coalesce(F.max(F.regexp_extract(F.col("id"), rf"^{prefix}_([0-9]+)$", 1).try_cast("int")).over(w), F.lit(0))
    rows = rows.withColumn("_bad", bad.cast("int")).withColumn("_max", largest).withColumn("_n", F.sum("_bad").over(w.orderBy("ord").rowsBetween(Window.unboundedPreceding, 0)))
    return rows.withColumn("id", F.when(F.col("_bad") == 1, F.concat(F.lit(f"{prefix}_"), (F.col("_max") + F.col("_n")).cast("string"))).otherwise(F.col("id"))).drop("_dup", "_bad", "_max", "_n")


def state_of_translation(items: DataFrame, done: DataFrame, by: list[str]) -> DataFrame:
    """items (text) with state: fresh without a translation, translated if made from this text, edited if from another."""
    rows = items.join(done.select(*by, F.col("source").alias("_from")), by, "left")
    return rows.withColumn("state", F.when(F.col("_from").isNull(), "fresh").when(F.col("_from").eqNullSafe(F.col("text")), "translated").otherwise("edited")).drop("_from")
