"""Readers of the formats that plans and catalogs come in, and of the head of a web page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

TRANSCRIPT = "transcription array<struct<text:string,offsets:struct<`from`:bigint,`to`:bigint>>>"


def transcript_words(raw: DataFrame, by: list[str], json: str = "json") -> DataFrame:
    """by, word_i, text, start and end (seconds) from the JSON of a speech recogniser, whose offsets are milliseconds; blank words go."""
    rows = raw.select(*by, F.posexplode(F.from_json(json, TRANSCRIPT)["transcription"]).alias("word_i", "w"))
    text = F.trim(F.col("w.text"))
    return rows.where(text != "").select(*by, "word_i", text.alias("text"), (F.col("w.offsets.from") / 1000).alias("start"), (F.col("w.offsets.to") / 1000).alias("end"))


def read_transcripts(spark: SparkSession, path: str) -> DataFrame:
    """The words of all transcripts in a folder, with file, one document a file."""
    raw = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("file"), F.col("value").alias("json"))
    return transcript_words(raw, ["file"])


def phrase_words(plans: DataFrame, by: list[str], phrases: str = "phrases") -> DataFrame:
    """by, phrase_i, word_i, text, start, end and kw out of nested arrays of words."""
    rows = plans.select(*by, F.posexplode(phrases).alias("phrase_i", "_p")).select(*by, "phrase_i", F.posexplode("_p").alias("word_i", "_w"))
    return rows.select(*by, "phrase_i", "word_i", "_w.text", "_w.start", "_w.end", F.coalesce("_w.kw", F.lit(False)).alias("kw"))


def catalog(raw: DataFrame, value: str, json: str = "json") -> DataFrame:
    """name and the fields of a JSON object that maps names to objects; value is their DDL."""
    return raw.select(F.explode(F.from_json(json, f"map<string,struct<{value}>>")).alias("name", "_v")).select("name", "_v.*")


def tolerant_params(jobs: DataFrame, json: str = "params") -> DataFrame:
    """jobs with the JSON as a variant, an empty object where it is missing or broken."""
    return jobs.withColumn(json, F.coalesce(F.try_parse_json(json), F.parse_json(F.lit("{}"))))


def library(files: DataFrame, known: DataFrame) -> DataFrame:
    """files (id) with what is known of them; a title that is missing is the id with a first capital."""
    rows = files.join(known, "id", "left")
    return rows.withColumn("title", F.coalesce("title", F.concat(F.upper(F.substring("id", 1, 1)), F.substring("id", 2, 1 << 30))))


def attribute(tag: Column, name: str) -> Column:
    """The value of an attribute in a tag's text, or null."""
    value = F.regexp_extract(tag, rf"""(?i)\b{name}\s*=\s*(?:"([^"]*)"|'([^']*)'|([^\s>"']+))""", 0)
    inner = F.regexp_replace(F.regexp_replace(value, r"(?i)^[a-z:-]+\s*=\s*", ""), r"^[\"']|[\"']$", "")
    return F.when(value != "", inner)


def head_tags(pages: DataFrame, by: list[str], html: str = "html") -> DataFrame:
    """by, i, tag, key and value of each meta (property, name or itemprop, and its content) and link (rel and href) before the body, in order."""
    head = F.regexp_extract(F.coalesce(html, F.lit("")), r"(?is)^(.*?)(?:<body|$)", 1)
    tags = F.regexp_extract_all(head, F.lit(r"(?is)(<(?:meta|link)\b[^>]*>)"), F.lit(1))
    rows = pages.select(*by, F.posexplode(tags).alias("i", "_t"))
    t = F.col("_t")
    kind = F.lower(F.regexp_extract(t, r"^<([A-Za-z]+)", 1))
    key = F.when(kind == "meta", F.coalesce(attribute(t, "property"), attribute(t, "name"), attribute(t, "itemprop"))).otherwise(attribute(t, "rel"))
    return rows.select(*by, "i", kind.alias("tag"), F.lower(key).alias("key"), F.when(kind == "meta", attribute(t, "content")).otherwise(attribute(t, "href")).alias("value"), attribute(t, "sizes").alias("sizes")).where("key is not null")


#: Fixed order of preference for a page's picture and its logo.
PICTURES = ["og:image", "og:image:url", "twitter:image", "image"]


def page_media(pages: DataFrame, by: list[str]) -> DataFrame:
    """by, kind (photo or logo), url and rank: pictures in the order of PICTURES; icons scalable first, then by size, those under 32 pixels left out."""
    tags = head_tags(pages, by)
    size = F.try_element_at(F.regexp_extract_all(F.coalesce("sizes", F.lit("")), F.lit(r"(\d+)"), F.lit(1)), F.lit(1)).try_cast("int")
    icon = (F.col("tag") == "link") & F.col("key").rlike("icon")
    photo = (F.col("tag") == "meta") & F.col("key").isin(PICTURES)
    scalable = F.lower("value").rlike(r"\.svg(?:[?#]|$)")
    weight = F.when(photo, -F.array_position(F.array(*map(F.lit, PICTURES)), F.col("key")).cast("int")).when(scalable, 1 << 20).otherwise(F.coalesce(size, F.when(F.col("key").rlike("apple"), 180).otherwise(32)))
    rows = tags.where(F.col("value").isNotNull() & (photo | icon & (scalable | size.isNull() | (size >= 32)))).select(*by, F.when(photo, "photo").otherwise("logo").alias("kind"), F.col("value").alias("url"), weight.alias("_w"), "i")
    from ..operators.sequences import first_of

    return first_of(rows, [*by, "kind"], [F.desc("_w"), "i"], 1 << 30).drop("_w", "i")
