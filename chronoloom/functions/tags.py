"""Tags, keys, genres and messages out of short texts, by fixed tables; and small rules of plans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .text import folded, key_words

#: Fixed tables: roots of words and their emoji, genres and what names them, notes and their pitch.
EMOJI = [("money", "💰"), ("dinero", "💰"), ("idea", "💡"), ("food", "🍽"), ("comida", "🍽"), ("time", "⏰"), ("tiempo", "⏰"), ("love", "❤"), ("amor", "❤"), ("ring", "💍")]
GENRES = [("house", "house|deep"), ("techno", "techno|rave"), ("ambient", "ambient|calm|chill"), ("rock", "rock|guitar"), ("pop", "pop|happy")]
NOTES = {"c": 0, "d": 2, "e": 4, "f": 5, "g": 7, "a": 9, "b": 11}


def emoji(word: Column) -> Column:
    """That of the first root in the table that the folded word contains, or null."""
    out = F.lit(None).cast("string")
    for root, mark in reversed(EMOJI):
        out = F.when(folded(word).contains(root), mark).otherwise(out)
    return out


def genre(text: Column) -> Column:
    """The genre whose name or sign stands earliest in the text, or null."""
    low = folded(text)
    at = F.array(*(F.struct(F.regexp_instr(low, F.lit(p)).alias("at"), F.lit(i).alias("i"), F.lit(g).alias("genre")) for i, (g, p) in enumerate(GENRES)))
    return F.try_element_at(F.array_sort(F.filter(at, lambda x: x["at"] > 0)), F.lit(1))["genre"]


def pitch_class(key: Column) -> Column:
    """0 to 11 for a key such as C, f#, Bb minor; null for anything else."""
    low = F.lower(F.trim(key))
    sign = F.regexp_extract(low, "^[a-g](#|b)?(?: ?(?:major|minor|maj|min|m))?$", 1)
    note = F.create_map(*(F.lit(x) for kv in NOTES.items() for x in kv))[F.substring(low, 1, 1)]
    valid = low.rlike("^[a-g](?:#|b)?(?: ?(?:major|minor|maj|min|m))?$")
    return F.when(valid, F.pmod(note + F.when(sign == "#", 1).when(sign == "b", -1).otherwise(0), F.lit(12)))


def same_words(a: Column, b: Column) -> Column:
    """Whether two texts have the same words in the same order, but for accents, case and punctuation."""
    return key_words(a) == key_words(b)


def word_match(a: Column, b: Column, prefix: int = 3) -> Column:
    """Whether two words are equal or one begins with the other, which has at least prefix letters."""
    return (a == b) | ((F.length(b) >= prefix) & a.startswith(b)) | ((F.length(a) >= prefix) & b.startswith(a))


def repaired(text: Column, fixes: dict[str, str]) -> Column:
    """text with the words of a small dictionary put right, a first capital kept."""
    table = F.create_map(*(F.lit(x) for kv in fixes.items() for x in kv))

    def one(w: Column) -> Column:
        good = table[F.lower(w)]
        return F.when(good.isNull(), w).when(F.substring(w, 1, 1) != F.lower(F.substring(w, 1, 1)), F.concat(F.upper(F.substring(good, 1, 1)), F.substring(good, 2, 1 << 30))).otherwise(good)

    return F.array_join(F.transform(F.split(text, " "), one), " ")


def message(code: Column, messages: dict[str, str]) -> Column:
    """A message for a code a:b:c, by its first part, with b put in for {}; the code itself if the part is unknown."""
    parts = F.split(code, ":")
    said = F.create_map(*(F.lit(x) for kv in messages.items() for x in kv))[parts[0]]
    return F.coalesce(F.replace(said, F.lit("{}"), F.coalesce(F.get(parts, F.lit(1)), F.lit(""))), code)


def envelope(t: Column, start: Column, end: Column, fade_in: float, fade_out: float) -> Column:
    """0..1: rises after start, falls before end, 0 outside."""
    inside = F.least((t - start) / fade_in, (end - t) / fade_out, F.lit(1.0))
    return F.when((t >= start) & (t <= end), F.greatest(F.lit(0.0), inside)).otherwise(0.0)


def unit_random(*key: Column) -> Column:
    """A number in [0, 1) that depends on the key alone."""
    return F.crc32(F.concat_ws(":", *key).cast("binary")) / float(1 << 32)


def first_present(wanted: list[str], there: Column) -> Column:
    """The first of the wanted values that the array has, or null."""
    return F.try_element_at(F.filter(F.array(*map(F.lit, wanted)), lambda x: F.array_contains(there, x)), F.lit(1))


def keyword_target(count: Column, ratio: float) -> Column:
    """How many keywords so many words should have: one at least, halves to the even number."""
    return F.greatest(F.lit(1), F.bround(count / ratio).cast("int"))


def merged_defaults(given: Column, defaults: Column) -> Column:
    """A map with the defaults for the keys that given lacks."""
    return F.map_concat(F.map_filter(defaults, lambda k, _: ~F.map_contains_key(given, k)), given)


def ordered_bounds(start: Column, end: Column, shortest: float) -> Column:
    """start and end in order, at least so far apart, not below 0."""
    low = F.greatest(F.lit(0.0), F.least(start, end))
    return F.struct(low.alias("start"), F.greatest(F.greatest(start, end), low + shortest).alias("end"))


def eta(elapsed: Column, pct: Column) -> Column:
    """Seconds left, or null before 1 %."""
    return F.when(pct >= 1, F.floor(elapsed * (100 - pct) / pct + 0.5).cast("long"))
