"""URL filters: rules, and gradient-boosted trees on lexical features for what no rule fits. All of it is DataFrame and SQL functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, lookup

#: verdict, host, path
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
#: The trees learn from about so many URLs of either verdict.
SAMPLE = 5_000
TREES, DEPTH, SEED = 8, 3, 42
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789-."


def parts(pages: DataFrame) -> DataFrame:
    """pages with host and path: both empty where url is null or has no ://."""
    at = F.instr("url", "://")
    rest = F.when(at > 0, F.expr("substring(url, instr(url, '://') + 3)")).otherwise("")
    rest = F.coalesce(rest, F.lit(""))
    return pages.withColumn("host", ascii_lower(F.regexp_extract(rest, r"^[^/?#]*", 0))).withColumn("path", F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1))


def rule_of(rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits host and path, and its verdict; nulls if none does."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for said, host, path in sorted(rules, key=lambda r: len(r[1] + r[2])):
        fits = ((F.col("host") == host) | F.col("host").endswith(f".{host}")) & F.col("path").startswith(path)
        name, verdict = F.when(fits, F.lit(host + path)).otherwise(name), F.when(fits, F.lit(said)).otherwise(verdict)
    return name, verdict


def count_of(text: Column, symbol: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(symbol), F.lit("")))


def entropy(text: Column) -> Column:
    """Bits a character, over SYMBOLS."""
    n = F.greatest(F.length(text), F.lit(1))
    terms = [F.when((c := count_of(text, x)) > 0, -(c / n) * F.log2(c / n)).otherwise(0.0) for x in SYMBOLS]
    out = terms[0]
    for x in terms[1:]:
        out = out + x
    return out


def suffix() -> Column:
    """The host's last two labels."""
    return F.substring_index("host", ".", -2)


FEATURES = {
    "url_length": lambda: F.length(F.coalesce("url", F.lit(""))),
    "host_length": lambda: F.length("host"),
    "path_length": lambda: F.length("path"),
    "labels": lambda: count_of(F.col("host"), "."),
    "depth": lambda: count_of(F.col("path"), "/"),
    "hyphens": lambda: count_of(F.col("host"), "-"),
    "digit_ratio": lambda: F.length(F.regexp_replace(F.coalesce("url", F.lit("")), "[^0-9]", "")) / F.greatest(F.length(F.coalesce("url", F.lit(""))), F.lit(1)),
    "host_entropy": lambda: entropy(F.col("host")),
    "path_entropy": lambda: entropy(F.lower("path")),
    "parameters": lambda: F.when(F.coalesce("url", F.lit("")).contains("?"), count_of(F.col("url"), "&") + 1).otherwise(0),
    "fragment": lambda: F.coalesce("url", F.lit("")).contains("#").cast("int"),
    "secure": lambda: F.coalesce("url", F.lit("")).startswith("https:").cast("int"),
    "suffix_urls": lambda: F.log1p(F.coalesce("_urls", F.lit(0))),
    "suffix_labels": lambda: F.coalesce("_labels", F.lit(0.0)),
}


def with_features(rows: DataFrame) -> DataFrame:
    """rows with a column for each feature. Suffix statistics are over all rows."""
    by = rows.groupBy(suffix().alias("_suffix")).agg(F.count("*").alias("_urls"), F.avg(count_of(F.col("host"), ".")).alias("_labels"))
    found = lookup(rows.withColumn("_suffix", suffix()), by, ["_suffix"], F.col("_row"))
    return found.select("*", *(f().cast("double").alias(f"_f_{name}") for name, f in FEATURES.items()))


def fitted(rows: DataFrame):
    """Trees that tell rows that a rule blocks from those that one allows, or None if either is missing."""
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.feature import VectorAssembler

    labelled = rows.where("_said is not null")
    n = {r[0]: r[1] for r in labelled.groupBy("_said").count().collect()}
    if len(n) < 2:
        return None
    share = F.when(F.col("_said") == "block", SAMPLE / n["block"]).otherwise(SAMPLE / n["allow"])
    chance = F.pmod(F.xxhash64("url", "page_id"), F.lit(1 << 30)) / (1 << 30)
    vectors = VectorAssembler(inputCols=[f"_f_{x}" for x in FEATURES], outputCol="_features")
    sample = vectors.transform(labelled.where(chance < share)).select("_features", (F.col("_said") == "block").cast("double").alias("_blocked"))
    trees = GBTClassifier(featuresCol="_features", labelCol="_blocked", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
    for name in ("prediction", "probability", "rawPrediction"):
        trees = trees._set(**{f"{name}Col": f"_{name}"})
    model = trees.fit(cut(sample.repartition(4)))  # about 2 * SAMPLE rows
    return lambda x: model.transform(vectors.transform(x))


def judged(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule and verdict (allow or block) for each row of pages.

    The longest rule that fits gives the verdict, else the trees do, which learn from a bounded sample of the URLs that rules decide; with rules of one kind
    alone among the URLs, the rest is allowed. A null url, or one without ://, has an empty host and path, and the trees judge it. Rows that
    repeat give repeated results, of which all or none are in the sample; an empty table gives no rows; URLs of any length count whole; other columns don't matter.
    """
    rows = parts(pages.select("page_id", "url")).withColumn("_row", F.monotonically_increasing_id())
    name, said = rule_of(rules)
    rows = cut(with_features(cut(rows.select("*", name.alias("rule"), said.alias("_said")))))
    model = fitted(rows)
    by_trees = F.when(F.col("_prediction") == 1.0, "block").otherwise("allow") if model else F.lit("allow")
    return (model(rows) if model else rows).select("page_id", "host", "path", "rule", F.coalesce("_said", by_trees).alias("verdict"))
