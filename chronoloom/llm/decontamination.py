"""Benchmark decontamination by templates.

Numbers, units after numbers and names (capitalised words inside a sentence) become typed placeholders, neighbours of one kind one placeholder; the other words are lower-cased
without punctuation around them. Windows of such templates are joined by hash; a document leaks an item if enough of the item's windows match about where they should
and fill its slots consistently: one value of the document for each value of the item, and the reverse, by the most frequent pairs. So questions with
other numbers or names are found too. Windows of the plain lower-cased words are joined beside them: they find copies in other capitals and items with too few literal words for a template.

Items of one template whose slots repeat in the same way are one class, found once. A class meets the documents that have one of its rarest
windows only: so many that whoever has enough windows has one of those. The documents' windows first pass a bitmap of the items' hashes, sized by their number; what passes is shuffled.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import arrow_schema, cut, drop_rows, lookup, row_key
from .shingles import powers

#: Words of a window, the least literal ones in that of a template, the share of an item's windows that must match, and so many plain ones that are enough whatever the share.
WINDOW, LITERAL, SHARE, ENOUGH = 8, 4, 0.5, 18
#: An item shorter than a window is one window. One of fewer than SHORTEST words leaks only as the whole text of a document.
SHORTEST = 5
#: Template windows count together if their places in document and item differ by about the same, up to so many words.
BAND = 16
#: What a window is of: template words, plain words, or a whole short text.
TEMPLATE, PLAIN, WHOLE = range(3)
#: Words that are numbers, and units (also with the usual prefixes and plurals).
NUMBERS = "one two three four five six seven eight nine ten eleven twelve twenty thirty forty fifty hundred thousand million".split()
SYMBOLS = [p + u for p in ("", "m", "c", "k", "d") for u in ("m", "g", "l", "s", "w", "v", "hz", "j", "pa")]
LONG = [p + u for p in ("", "kilo", "centi", "milli") for u in ("meter", "metre", "gram", "liter", "litre", "second", "watt")]
UNITS = SYMBOLS + [x + e for x in [*LONG, "mile", "yard", "pound", "ounce", "ton", "minute", "hour", "day", "week", "month", "year", "dollar", "euro", "cent", "degree"] for e in ("", "s")] + ["mph", "km/h", "feet", "foot", "inch", "inches", "ft", "lb", "lbs", "oz", "percent", "min", "h"]
#: Within a word a number with a unit attached.
BOTH = re.compile(r"[+-]?[0-9][0-9.,]*([a-z/]+)")
#: Hashes of the placeholders, what word and window hashes multiply by, and its inverse.
NUM, UNT, NAME, BASE = (np.uint64(x) for x in (0x6E756D0000000001, 0x756E740000000003, 0x6E616D0000000005, 0x9E3779B97F4A7C15))
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
STEP, UNSTEP = np.uint64(0xD1342543DE82EF95), np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))
#: Bits of the bitmap for each hash, as a power of two, and its least and largest size, likewise.
SPARSE, LEAST_BITMAP, LARGEST_BITMAP = 5, 20, 30
#: So many words after a block's own are looked at with it.
AHEAD = 4 * WINDOW
#: Bytes of texts that are looked at together, and words of a long text.
GROUP, WORDS = 1 << 18, 1 << 15


def marked(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[np.frombuffer(chars, np.uint8)] = True
    return out


SPACE, STRIP, ENDS = marked(b" \t\n\r\x0b\x0c"), marked(b".,;:!?\"'()[]{}<>|*_-"), marked(b".!?:")
DIGIT, NUMERIC = marked(b"0123456789"), marked(b"0123456789.,:/%+-$")
CAPITAL = marked(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ")
LOWER = (np.arange(256) + 32 * CAPITAL).astype(np.uint8)


def before(mask: np.ndarray) -> np.ndarray:
    """How many are set before each place, and at last in all."""
    out = np.zeros(len(mask) + 1, np.int64)
    np.cumsum(mask, out=out[1:])
    return out


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


@dataclass
class Words:
    """A sequence of words or template words: where each begins and ends in raw, its hash, whether it fills a slot, the number of its text, its place there, and whether windows that begin here belong to this block."""

    raw: bytes
    first: np.ndarray
    last: np.ndarray
    hash: np.ndarray
    slot: np.ndarray
    doc: np.ndarray
    at: np.ndarray
    own: np.ndarray

    def starts(self, n: int, literal: int) -> np.ndarray:
        """The windows of n words inside one text with so many literal words, by their first word."""
        if len(self.doc) < n:
            return np.empty(0, np.int64)
        plain = before(~self.slot)
        return np.flatnonzero(self.own[: len(self.doc) - n + 1] & (self.doc[: len(self.doc) - n + 1] == self.doc[n - 1 :]) & (plain[n:] - plain[:-n] >= literal))

    def hashes(self, n: int) -> np.ndarray:
        """A hash of each n words in a row, the same wherever they stand."""
        sums = np.zeros(len(self.hash) + 1, np.uint64)
        np.cumsum(self.hash * powers(int(STEP), len(self.hash)), out=sums[1:])
        m = max(0, len(self.hash) - n + 1)
        return mixed((sums[n : n + m] - sums[:m]) * powers(int(UNSTEP), m) + np.uint64(n))

    def values(self, i: int, n: int) -> list[str]:
        """What fills the slots of a window."""
        return [lowered(self.raw[self.first[j] : self.last[j]]).decode(errors="replace") for j in range(i, i + n) if self.slot[j]]


@dataclass
class Block:
    """Words of some texts, those without a core left out, and the template words they make."""

    plain: Words
    template: Words


def lowered(raw: bytes) -> bytes:
    """ASCII and Latin-1 capitals in lower case."""
    return low_bytes(np.frombuffer(raw, np.uint8)).tobytes()


def low_bytes(raw: np.ndarray) -> np.ndarray:
    low = LOWER[raw]
    latin = (raw[:-1] == 0xC3) & (raw[1:] >= 0x80) & (raw[1:] <= 0x9E) & (raw[1:] != 0x97)
    low[1:][latin] += 0x20
    return low


def words_hashes(raw: np.ndarray, first: np.ndarray, last: np.ndarray) -> np.ndarray:
    """A hash of raw[first:last] for each word, the same wherever the word stands."""
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * powers(int(BASE), len(raw)), out=sums[1:])
    return mixed((sums[last] - sums[first]) * powers(int(INVERSE), len(raw) + 1)[first])


def listed(words: list[str]) -> np.ndarray:
    raw = " ".join(words).encode()
    ends = np.cumsum([len(x) + 1 for x in words]) - 1
    return np.sort(words_hashes(np.frombuffer(raw, np.uint8), np.concatenate(([0], ends[:-1] + 1)), ends))


NUMBER_HASHES, UNIT_HASHES = listed(NUMBERS), listed(UNITS)


def among(hashes: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Whether each is one of a short sorted list: a table of upper bits first, then the search."""
    table = np.zeros(1 << 16, bool)
    table[known >> np.uint64(48)] = True
    out = table[hashes >> np.uint64(48)]
    some = np.flatnonzero(out)
    at = np.minimum(np.searchsorted(known, hashes[some]), len(known) - 1)
    out[some] = known[at] == hashes[some]
    return out


def block(raw: bytes, starts: np.ndarray, ends: np.ndarray, until: np.ndarray, doc: np.ndarray, at: np.ndarray, own: np.ndarray) -> Block:
    """raw's words, given by starts and ends, as they are and as templates; until is where the next one starts, doc whose each is, at its place there."""
    data = np.frombuffer(raw, np.uint8)
    inner = ~(SPACE | STRIP)[data]
    core, places, sentence = before(inner), np.flatnonzero(inner), before(ENDS[data])
    first, last = places[core[starts]], places[core[ends] - 1] + 1
    ended = sentence[until] > sentence[last]
    opens = np.concatenate(([True], ended[:-1] | (doc[1:] != doc[:-1])))
    hashed = words_hashes(low_bytes(data), first, last)
    digits, numeric = before(DIGIT[data]), before(NUMERIC[data])
    number = (digits[last] > digits[first]) & (numeric[last] - numeric[first] == last - first) | among(hashed, NUMBER_HASHES)
    for i in np.flatnonzero(DIGIT[data[first]] & ~number).tolist():
        m = BOTH.fullmatch(lowered(raw[first[i] : last[i]]).decode(errors="replace"))
        number[i] = bool(m) and m[1] in UNITS
    after = np.concatenate(([False], number[:-1] & (doc[1:] == doc[:-1])))
    unit = after & ~number & among(hashed, UNIT_HASHES)
    second = data[np.minimum(first + 1, len(data) - 1)]
    capital = CAPITAL[data[first]] | (data[first] == 0xC3) & (second >= 0x80) & (second <= 0x9E) & (second != 0x97)
    name = capital & ~opens & ~number & ~unit
    template, slot = np.where(number, NUM, np.where(unit, UNT, np.where(name, NAME, hashed))), number | unit | name
    begins = np.ones(len(doc), bool)
    begins[1:] = ~slot[1:] | (template[1:] != template[:-1]) | (doc[1:] != doc[:-1])
    some = np.flatnonzero(begins)
    until_last = last[np.append(some[1:], len(doc)) - 1]
    plain = Words(raw, first, last, hashed, np.zeros(len(doc), bool), doc, at, own)
    return Block(plain, Words(raw, first[some], until_last, template[some], slot[some], doc[some], at[some], own[some]))


def blocks(texts: list[str]) -> Iterator[Block]:
    """The words of texts in blocks of bounded size; doc is the index of the text. A block of a long text has the words around its own as context."""
    raw = [x.encode() for x in texts]
    i = 0
    while i < len(raw):
        j, size = i + 1, len(raw[i])
        while j < len(raw) and size + len(raw[j]) <= GROUP:
            size += len(raw[j])
            j += 1
        joined = b" ".join(raw[i:j])
        data = np.frombuffer(joined, np.uint8)
        space = np.concatenate(([True], SPACE[data], [True]))
        starts, ends = np.flatnonzero(space[:-1] & ~space[1:]), np.flatnonzero(~space[:-1] & space[1:])
        if len(starts):
            full = np.add.reduceat(~(SPACE | STRIP)[data], starts, dtype=np.int32) > 0
            starts, ends = starts[full], ends[full]
        edges = np.cumsum([len(x) + 1 for x in raw[i:j]])
        doc = np.searchsorted(edges, starts, "right") + i
        until = np.append(starts[1:], len(joined))
        place = np.arange(len(starts)) - np.searchsorted(doc, doc)
        for k in range(0, len(starts), WORDS):
            low, high, to = max(0, k - 2), min(len(starts), k + WORDS), min(len(starts), k + WORDS + AHEAD)
            a = starts[low]
            mine = np.zeros(to - low, bool)
            mine[k - low : high - low] = True
            yield block(joined[a : until[to - 1]], starts[low:to] - a, ends[low:to] - a, until[low:to] - a, doc[low:to], place[low:to], mine)
        i = j


def whole(words: np.ndarray) -> int:
    """A hash of a whole short text's words."""
    return Words(b"", words, words, words, words > 0, words, words, words > 0).hashes(len(words))[0].view(np.int64)


def numbered(values: list[str]) -> list[int]:
    """Each value as the number of its first occurrence among the values."""
    seen: dict[str, int] = {}
    return [seen.setdefault(x, len(seen)) for x in values]


def windows_of_item(text: str) -> tuple[int | None, list[tuple[int, int, int, int, list[int]]]]:
    """The number of an item's class, and (kind, words, place, hash, values of the slots as numbers) for each window; None for a text without words."""
    parts = list(blocks([text]))
    if not parts:
        return None, []
    merge = lambda xs: Words(b"", *(np.concatenate([getattr(x, f)[x.own] for x in xs]) for f in ("first", "last", "hash", "slot", "doc", "at", "own")))
    plain, template = merge([x.plain for x in parts]), merge([x.template for x in parts])
    values = [v for x in parts for i in np.flatnonzero(x.template.own & x.template.slot).tolist() for v in x.template.values(i, 1)]
    numbers, filled = numbered(values), before(template.slot)
    n = min(WINDOW, len(plain.doc))
    if n < SHORTEST:
        return int(whole(plain.hash)), [(WHOLE, n, 0, int(whole(plain.hash)), [])]
    rows = []
    for kind, words, literal in ((PLAIN, plain, 0), (TEMPLATE, template, LITERAL)):
        m = min(WINDOW, len(words.doc))
        found = words.hashes(m).view(np.int64)
        rows += [(kind, m, int(words.at[i]), int(found[i]), numbers[filled[i] : filled[i + m]] if kind == TEMPLATE else []) for i in words.starts(m, literal).tolist()]
    own = template if any(x[0] == TEMPLATE for x in rows) else plain
    return xxhash.xxh64_intdigest(own.hash.tobytes() + str(numbers if own is template else "").encode()) - (1 << 63), rows


def item_windows(items: DataFrame) -> DataFrame:
    """item_id, class, size (plain words), kind, n, at, hash and slots for each window of the items."""
    schema = "item_id long, class long, size int, kind int, n int, at long, hash long, slots array<int>"
    types = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                number, found = windows_of_item(text or "")
                size = sum(x[0] != TEMPLATE for x in found)
                rows += [(item_id, number, size, *x) for x in found]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x.type) for k, x in enumerate(types)], schema=types)

    return items.select(F.col("item_id").cast("long").alias("item_id"), "text").mapInArrow(run, schema)


def bitmap(own: DataFrame) -> tuple[int, np.ndarray]:
    """The bitmap's size as a power of two, and the places that the items' hashes take in it. At most 2 ** LARGEST_BITMAP places of four bytes reach the driver."""
    n = max(1, own.select("hash").distinct().count())
    bits = min(LARGEST_BITMAP, max(LEAST_BITMAP, n.bit_length() + SPARSE))
    return bits, own.select(F.shiftrightunsigned("hash", 64 - bits).cast("int").alias("place")).distinct().toArrow().column(0).to_numpy()


def document_windows(docs: DataFrame, kinds: list[tuple[int, int]], bits: int, places: np.ndarray) -> DataFrame:
    """doc_id, _k1, _k2, _row, kind, n, at, hash and slots for each window of the documents, of those kinds and lengths, whose place in the bitmap is taken."""
    schema = "doc_id long, _k1 long, _k2 long, _row long, kind int, at long, hash long, slots array<string>"
    types = arrow_schema(schema)
    table = np.zeros(1 << (bits - 3), np.uint8)
    np.bitwise_or.at(table, places >> 3, np.left_shift(1, places & 7).astype(np.uint8))
    shared = docs.sparkSession.sparkContext.broadcast(table)  # of a size that depends on the benchmark alone

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        taken = shared.value

        def known(hashed: np.ndarray) -> np.ndarray:
            place = hashed >> np.uint64(64 - bits)
            return (taken[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1).astype(bool)

        for batch in (whole_batch.slice(at, 512) for whole_batch in batches for at in range(0, len(whole_batch), 512)):
            own, rows = [batch.column(i).to_pylist() for i in range(4)], []
            for b in blocks([x or "" for x in batch.column(4).to_pylist()]):
                for kind, n in kinds:
                    if kind == WHOLE:
                        continue
                    words = b.plain if kind == PLAIN else b.template
                    hashed, at = words.hashes(n), words.starts(n, LITERAL if kind == TEMPLATE else 0)
                    for i in at[known(hashed[at])].tolist():
                        rows.append((*(x[words.doc[i]] for x in own), kind, int(words.at[i]), int(hashed[i].view(np.int64)), words.values(i, n) if kind == TEMPLATE else []))
                if (WHOLE, SHORTEST - 1) in kinds:
                    edges = np.flatnonzero(np.concatenate(([True], b.plain.doc[1:] != b.plain.doc[:-1])))
                    for i, j in zip(edges.tolist(), np.append(edges[1:], len(b.plain.doc)).tolist(), strict=True):
                        if j - i < SHORTEST and b.plain.at[i] == 0 and known(np.array([whole(b.plain.hash[i:j])]).view(np.uint64))[0]:
                            rows.append((*(x[b.plain.doc[i]] for x in own), WHOLE, 0, int(whole(b.plain.hash[i:j])), []))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], x.type) for k, x in enumerate(types)], schema=types)

    one, two = row_key(docs)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), one.alias("_k1"), two.alias("_k2"), F.monotonically_increasing_id().alias("_row"), "text")
    return rows.mapInArrow(run, schema)


def consistent(found: list) -> int:
    """found: (place in the item, place in the document, the item's values, the document's values) of template windows. The most places of the item that match in a band of shifts, with slots filled alike."""
    bands: dict = {}
    for x in found:
        shift = x["at"] - x["item_at"]
        for band in ((0, shift // BAND), (1, (shift + BAND // 2) // BAND)):
            bands.setdefault(band, []).append(x)
    most = 0
    for rows in bands.values():
        pairs = Counter(p for x in rows for p in set(zip(x["b"], x["d"], strict=True)))
        ahead: dict = {}
        back: dict = {}
        for (b, d), _ in sorted(pairs.items(), key=lambda p: (-p[1], p[0])):
            if b not in ahead and d not in back:
                ahead[b], back[d] = d, b
        most = max(most, len({x["item_at"] for x in rows if all(ahead.get(b) == d for b, d in zip(x["b"], x["d"], strict=True))}))
    return most


def leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """A row for each row of docs and class of items that it leaks: doc_id, item_id (the least of the class), items (how many it has), windows (matched), item_windows, share, exact (enough plain words match), _k1 and _k2 (the row's key).

    Null texts and ids: a null text has no words, and leaks nothing; a null doc_id or item_id stays null. Items of fewer than SHORTEST words leak as a document's whole text only, items with
    fewer than LITERAL literal words in every window by their plain words only, items without words never. Rows of docs that repeat give repeated results. Items with equal words, or with equal templates whose
    slots repeat alike, are one class, whatever their ids. Empty tables give no rows; other columns don't matter. Whole texts are searched, however long, and each passage that many documents share in each of them.
    """
    every = cut(item_windows(items.select("item_id", "text").distinct()))
    sizes = every.where(F.col("kind") != TEMPLATE).groupBy("class").agg(F.min("item_id").alias("item_id"), F.count_distinct(F.struct("item_id")).alias("items"), F.min("size").alias("least"))
    own = cut(every.select("class", "kind", "n", "at", "hash", "slots").dropDuplicates(["class", "kind", "at", "hash"]))
    counted = own.groupBy("class", "kind").agg(F.count_distinct("at").alias("of")).join(sizes.select("class", "least"), "class")
    total = F.when(F.col("kind") == TEMPLATE, F.col("of")).otherwise(F.col("least"))
    needed = F.ceil(total * SHARE)
    needed = F.when(F.col("kind") == PLAIN, F.least(needed, F.lit(ENOUGH))).otherwise(needed)
    needs = cut(counted.select("class", "kind", total.alias("total"), needed.alias("needed"), (F.col("of") - needed + 1).alias("rarest")))
    common = own.groupBy("hash").agg(F.count_distinct("class").alias("classes"))
    places = own.join(common, "hash").groupBy("class", "kind", "at").agg(F.max("classes").alias("classes"))  # of items of one class a place may have several words
    ranked = places.withColumn("rank", F.row_number().over(Window.partitionBy("class", "kind").orderBy("classes", "at"))).join(needs, ["class", "kind"]).where("rank <= rarest")
    rare = own.join(ranked.select("class", "kind", "at"), ["class", "kind", "at"]).groupBy("hash").agg(F.collect_set(F.struct("class", "kind")).alias("of"))

    kinds = sorted({(r[0], SHORTEST - 1 if r[0] == WHOLE else r[1]) for r in own.select("kind", "n").distinct().collect()})  # at most 2 * WINDOW
    found = cut(document_windows(docs, kinds, *bitmap(own)))
    met = lookup(found.select("_row", "kind", "hash").distinct(), rare, ["hash"], F.col("_row")).select("_row", "kind", F.explode("of").alias("x")).where("kind = x.kind").select("_row", "kind", "x.class")
    candidates = cut(met.distinct())
    windows = own.groupBy("class", "kind").agg(F.collect_list(F.struct(F.col("at").alias("item_at"), "hash", F.col("slots").alias("b"))).alias("w"))  # those of an item, or of a template's items
    wanted = lookup(candidates.withColumn("key", F.struct("class", "kind")), windows.select(F.struct("class", "kind").alias("key"), "w"), ["key"], F.col("_row"))
    wanted = wanted.select("_row", "class", "kind", F.explode("w").alias("w")).select("_row", "class", "kind", "w.*")
    matched = wanted.join(found.select("_row", "kind", "hash", "at", F.col("slots").alias("d")), ["_row", "kind", "hash"])
    alike = F.udf(consistent, "int")
    several = F.collect_set(F.when(F.col("kind") == TEMPLATE, F.struct("item_at", "at", "b", "d")))
    by = matched.groupBy("_row", "class", "kind").agg(F.count_distinct("item_at").alias("places"), several.alias("several"))
    sized = lookup(by.withColumn("key", F.struct("class", "kind")), needs.select(F.struct("class", "kind").alias("key"), "total", "needed"), ["key"], F.col("_row")).where("places >= needed")
    sized = sized.withColumn("windows", F.when(F.col("kind") == TEMPLATE, alike("several")).otherwise(F.col("places"))).where("windows >= needed")
    one = F.struct((F.col("kind") != TEMPLATE).alias("exact"), (F.col("windows") / F.col("total")).alias("share"), "windows", "total")
    best = sized.groupBy("_row", "class").agg(F.max(one).alias("x"))
    named = lookup(best, sizes.select("class", "item_id", "items"), ["class"], F.col("_row"))
    rows = found.select("_row", "doc_id", "_k1", "_k2").distinct()
    return named.join(rows, "_row").select(
        "doc_id", "item_id", "items", F.col("x.windows").cast("long").alias("windows"), F.col("x.total").cast("long").alias("item_windows"), F.least("x.share", F.lit(1.0)).alias("share"), "x.exact", "_k1", "_k2"
    )


def drop_leaks(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the rows that leak an item; all columns stay as they are.

    A null or empty text leaks nothing and stays; rows that repeat stay or go together. Empty tables are fine; columns of any other name may be there. Whole texts are searched, however long.
    """
    return drop_rows(docs, cut(leaks(docs, items).select("_k1", "_k2").distinct()))
