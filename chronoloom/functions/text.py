"""Text functions as column expressions; letters beyond ASCII are folded by a fixed table, all else stays in generated code."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters of Latin-1 and their plain forms, place by place.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "aaaaaaceeeeiiiinooooouuuuyy"
#: Fixed word lists: which words only one language uses.
STOP = {"en": ["the", "and", "with", "for"], "es": ["que", "los", "las", "para"], "fr": ["les", "des", "dans", "avec"], "de": ["und", "der", "die", "nicht"]}


def folded(text: Column) -> Column:
    return F.translate(F.lower(text), ACCENTED, PLAIN)


def key_alnum(text: Column) -> Column:
    """Only a-z and 0-9, folded."""
    return F.regexp_replace(folded(text), "[^a-z0-9]", "")


def key_letters(text: Column) -> Column:
    """Only a-z and the apostrophe, folded."""
    return F.regexp_replace(folded(text), "[^a-z']", "")


def key_words(text: Column) -> Column:
    """Runs of a-z and 0-9 with one space between, folded."""
    return F.trim(F.regexp_replace(folded(text), "[^a-z0-9]+", " "))


def key_unicode(text: Column) -> Column:
    """Letters and digits of any script, lower-cased, not folded."""
    return F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]", "")


def key_dashed(text: Column) -> Column:
    """Folded a-z, 0-9, spaces and dashes."""
    return F.trim(F.regexp_replace(folded(text), "[^a-z0-9 -]+", ""))


def slug(text: Column, most: int = 40) -> Column:
    return F.regexp_replace(F.substring(F.regexp_replace(folded(text), "[^a-z0-9]+", "-"), 1, most), "^-+|-+$", "")


def words(text: Column) -> Column:
    """The runs of letters."""
    return F.regexp_extract_all(text, F.lit(r"(\p{L}+)"), F.lit(1))


def titled(text: Column) -> Column:
    """The first letter of each word in upper case, the others as they are."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def one_line(text: Column, most: int) -> Column:
    """White space as single spaces, control characters gone, at most so many characters."""
    return F.substring(F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x08\x0e-\x1f\x7f]", ""), r"\s+", " ")), 1, most)


def without_ellipsis(text: Column, source: Column) -> Column:
    """text without dots or an ellipsis at its end, unless source ends in them too."""
    end = r"(\.\.\.|…)\s*$"
    return F.when(source.rlike(end), text).otherwise(F.regexp_replace(text, end, ""))


def leaks(text: Column, lang: str) -> Column:
    """Whether a word of another language's list stands in text."""
    others = sorted(w for k, v in STOP.items() if k != lang for w in v)
    return F.coalesce(F.arrays_overlap(words(F.lower(text)), F.array(*map(F.lit, others))), F.lit(False))


def neutral(text: Column) -> Column:
    """Whether fewer than three letters are in text."""
    return F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}]", "")) < 3


def clock(seconds: Column) -> Column:
    """m:ss"""
    s = F.floor(seconds).cast("long")
    return F.format_string("%d:%02d", F.floor(s / 60).cast("long"), s % 60)


def subtitle_clock(seconds: Column) -> Column:
    """h:mm:ss.cc, to the nearest hundredth."""
    c = F.floor(seconds * 100 + 0.5).cast("long")
    return F.format_string("%d:%02d:%02d.%02d", F.floor(c / 360000).cast("long"), F.floor(c / 6000).cast("long") % 60, F.floor(c / 100).cast("long") % 60, c % 100)


def number(text: Column) -> Column:
    """A number out of text with separators and units, or null; never NaN or infinite."""
    x = F.regexp_replace(text, "[^0-9.eE+-]", "").try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def separated(x: Column) -> Column:
    """A whole number with dots between its thousands."""
    return F.translate(F.format_number(x.cast("long"), 0), ",", ".")


def keywords(text: Column, stop: list[str], n: int = 2) -> Column:
    """Words with a digit first, then the longest others that are no stop words; n in all, the earlier of equals first."""
    parts = F.transform(F.regexp_extract_all(text, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)), lambda w, i: F.struct(w.rlike("[0-9]").cast("int").alias("digit"), F.length(w).alias("size"), (-i).alias("at"), w.alias("word")))
    kept = F.filter(parts, lambda x: ~F.lower(x["word"]).isin(stop))
    return F.transform(F.slice(F.sort_array(kept, asc=False), 1, n), lambda x: x["word"])


def cased_like(text: Column, source: Column) -> Column:
    """text in upper case if source is, with a first capital if source has one, else in lower case."""
    first = F.substring(source, 1, 1)
    return F.when((source == F.upper(source)) & (source != F.lower(source)), F.upper(text)).when(first != F.lower(first), F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, 2, 1 << 30)))).otherwise(F.lower(text))
