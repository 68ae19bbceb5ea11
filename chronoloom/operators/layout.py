"""Where things go: cards placed clear of a face and of other boxes, and words dealt into balanced lines."""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .intervals import overlapping

#: The part of the frame that may be used, as left, top, right and bottom, and the margin to it.
SAFE, MARGIN = (0.12, 0.12, 0.88, 0.88), 0.015
#: Sizes that are tried in turn, and by how much a face's zone is larger than the face: at the sides, above, below.
SCALES, ZONE = (1.0, 0.85, 0.72, 0.6, 0.5, 0.4), (0.03, 0.05, 0.03)
NEXT_TO_NOTHING = 1e-9
#: What a line that ends with a word of no weight of its own costs, in shares of an average line, and what the upper lines' widths cost.
WEAK_END, UPPER = 0.45, 1e-4


def _area(x0: Column, y0: Column, x1: Column, y1: Column, box: Column) -> Column:
    wide = F.greatest(F.lit(0.0), F.least(x1, box["x1"]) - F.greatest(x0, box["x0"]))
    return wide * F.greatest(F.lit(0.0), F.least(y1, box["y1"]) - F.greatest(y0, box["y0"]))


def _held_in(value: Column, low: Column, high: Column, otherwise: Column) -> Column:
    return F.when(low > high, otherwise).otherwise(F.least(F.greatest(value, low), high))


def candidates(items: DataFrame, by: list[str]) -> DataFrame:
    """items, once for each place that is tried: rank, x, y, scale, the card's box and face_area, what it covers of the face's zone.

    A card is in the middle, right below the face's zone or right above it, or without a face at the top or at the bottom, moved inside the safe part above the captions (top, may be null).
    """
    left, top, right, low = (F.lit(v) for v in SAFE)
    bottom = F.when(F.col("top") > 0, F.least(low, F.col("top"))).otherwise(low)
    face = F.col("face")
    zone = F.when(
        face.isNotNull(),
        F.struct((face["x"] - face["w"] / 2 - ZONE[0]).alias("x0"), (face["y"] - face["h"] / 2 - ZONE[1]).alias("y0"), (face["x"] + face["w"] / 2 + ZONE[0]).alias("x1"), (face["y"] + face["h"] / 2 + ZONE[2]).alias("y1")),
    )
    tries = F.array(*(F.struct(F.lit(2 * i + j).alias("rank"), F.lit(s).alias("scale"), F.lit(j).alias("side")) for i, s in enumerate(SCALES) for j in range(2)))
    rows = items.withColumn("_zone", zone).withColumn("_bottom", bottom).withColumn("_t", F.explode(tries))
    wide, high = F.col("w") * F.col("_t.scale"), F.col("h") * F.col("_t.scale")
    first = F.col("_t.side") == 0
    at = F.when(F.col("_zone").isNull(), F.when(first, 0.0).otherwise(1.0)).when(first, F.col("_zone.y1") + MARGIN + high / 2).otherwise(F.col("_zone.y0") - MARGIN - high / 2)
    middle = F.lit((SAFE[0] + SAFE[2]) / 2)
    x = _held_in(middle, left + wide / 2 + MARGIN, right - wide / 2 - MARGIN, middle)
    y = _held_in(at, top + high / 2 + MARGIN, F.col("_bottom") - high / 2 - MARGIN, (top + F.col("_bottom")) / 2)
    placed = rows.select("*", wide.alias("_w"), high.alias("_h"), x.alias("x"), y.alias("y"))
    box = F.struct((F.col("x") - F.col("_w") / 2).alias("x0"), (F.col("y") - F.col("_h") / 2).alias("y0"), (F.col("x") + F.col("_w") / 2).alias("x1"), (F.col("y") + F.col("_h") / 2).alias("y1"))
    boxed = placed.withColumn("box", box)
    b = F.col("box")
    covered = F.when(F.col("_zone").isNull(), 0.0).otherwise(_area(b["x0"], b["y0"], b["x1"], b["y1"], F.col("_zone")))
    return boxed.select(*by, "id", "start", "end", F.col("_t.rank").alias("rank"), "x", "y", F.col("_t.scale").alias("scale"), "box", covered.alias("face_area"))


def placed(items: DataFrame, boxes: DataFrame, by: list[str], width: float) -> DataFrame:
    """by, id, x, y and scale for each of items (by, id, start, end, w, h, face, top): the first place that covers neither the face's zone nor any of boxes (by, start, end, x0, y0, x1, y1) shown at the same time;
    else of those clear of the face the one that covers least of the boxes, else the one that covers least of the face.

    Items meet boxes in an equi join on buckets of width seconds; areas are added up by item and place before the places of an item, twelve, are compared.
    """
    tried = candidates(items, by)
    shown = overlapping(items.select(*by, "id", "start", "end"), boxes, by, width).select(*by, "id", F.struct(*(F.col(f"r_{c}").alias(c) for c in ("x0", "y0", "x1", "y1"))).alias("_other"))
    b = F.col("box")
    covered = tried.join(shown, [*by, "id"]).groupBy(*by, "id", "rank").agg(F.sum(_area(b["x0"], b["y0"], b["x1"], b["y1"], F.col("_other"))).alias("_covered"))
    scored = tried.join(covered, [*by, "id", "rank"], "left").select(*by, "id", F.struct("rank", "x", "y", "scale", "face_area", F.coalesce("_covered", F.lit(0.0)).alias("covered")).alias("_p"))
    kind = "struct<rank:int,x:double,y:double,scale:double,face_area:double,covered:double>"
    state = F.struct(F.lit(None).cast(kind).alias("clear"), F.lit(None).cast(kind).alias("free"), F.lit(None).cast(kind).alias("least"))

    def step(acc: Column, p: Column) -> Column:
        off = p["face_area"] <= NEXT_TO_NOTHING
        clear = F.when(acc["clear"].isNull() & off & (p["covered"] <= NEXT_TO_NOTHING), p).otherwise(acc["clear"])
        free = F.when(off & (acc["free"].isNull() | (p["covered"] < acc["free"]["covered"] - NEXT_TO_NOTHING)), p).otherwise(acc["free"])
        least = F.when(acc["least"].isNull() | (p["face_area"] < acc["least"]["face_area"] - NEXT_TO_NOTHING), p).otherwise(acc["least"])
        return F.struct(clear.alias("clear"), free.alias("free"), least.alias("least"))

    every = scored.groupBy(*by, "id").agg(F.sort_array(F.collect_list("_p")).alias("_all"))
    pick = every.select(*by, "id", F.aggregate(F.col("_all").cast(f"array<{kind}>"), state, step, lambda x: F.coalesce(x["clear"], x["free"], x["least"])).alias("_x"))
    return pick.select(*by, "id", F.col("_x.x").alias("x"), F.col("_x.y").alias("y"), F.col("_x.scale").alias("scale"))


def best_lines(widths: list[int], space: int, n: int, weak: list[bool]) -> list[int]:
    """The places at which lines begin, of the cheapest way to deal words into n lines (of equally cheap ones the first): the widest line, plus UPPER of every other line from the first on,
    plus WEAK_END of the average line for each line but the last that ends in a weak word. In whole numbers, so that ties are ties.

    Line by line, for each place where a line may end, ways are kept that no other beats in all of: widest line, further cost, places. What even lines cost is a bound: ways that cost more, or leave more than can go
    into the lines that are left, are given up at once.
    """
    words = len(widths)
    if not words:
        return []
    n = max(1, min(n, words))
    ends = [0]
    for x in widths:
        ends.append(ends[-1] + x + space)
    upper, total = round(UPPER * 20_000) * n, ends[-1] - space
    each = 20_000 * n  # all costs times that
    penalty = round(WEAK_END * 20_000) * total

    def line_cost(line: int, begin: int, end: int) -> tuple[int, int]:
        width = ends[end] - ends[begin] - space
        return each * width, (upper * width if line % 2 == 0 else 0) + (penalty if end < words and weak[end - 1] else 0)

    even = [0]
    for line in range(1, n):
        even.append(min(max(even[-1] + 1, bisect_left(ends, line * ends[-1] / n)), words - (n - line)))
    costs = [line_cost(i, a, b) for i, (a, b) in enumerate(zip(even, [*even[1:], words], strict=True))]
    bound = max(m for m, _ in costs) + sum(c for _, c in costs)
    ways: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {0: [(0, 0, ())]}
    for line in range(n):
        left = n - line - 1
        further: dict[int, list[tuple[int, int, tuple[int, ...]]]] = {}
        for begin, some in ways.items():
            for end in range(begin + 1, words - left + 1) if left else (words,):
                widest, more = line_cost(line, begin, end)
                if widest > bound:
                    break
                if left and each * (ends[words] - ends[end] - space * left) > bound * left:
                    continue
                fit = [(max(m, widest), c + more, (*cuts, begin)) for m, c, cuts in some if max(m, widest) + c + more <= bound]
                if fit:
                    further.setdefault(end, []).extend(fit)
        ways = {}
        for end, some in further.items():
            kept: list[tuple[int, int, tuple[int, ...]]] = []
            for way in sorted(some):
                if not any(c <= way[1] and cuts <= way[2] for _, c, cuts in kept):
                    kept.append(way)
            ways[end] = kept
    return list(min((m + c, cuts) for m, c, cuts in ways[words])[1])


def balanced(lines: DataFrame, key: list[str], n: int, weak: tuple[str, ...] = (), space: int = 1) -> DataFrame:
    """key and parts, the words (an array) of a text dealt into n lines of near equal length, for each row of lines; a text of fewer words has a line for each. Widths are characters. A null array has null parts."""
    names = [f.name for f in lines.select(*key).schema.fields]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in lines.select(*key).schema.fields) + ", parts array<string>"
    known = frozenset(weak)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            for words in batch.column(len(names)).to_pylist():
                if words is None:
                    parts.append(None)
                    continue
                at = best_lines([len(w) for w in words], space, n, [w.lower() in known for w in words])
                parts.append([" ".join(words[a:b]) for a, b in zip(at, [*at[1:], len(words)], strict=False)])
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(parts, pa.list_(pa.string()))], names=[*names, "parts"])

    return lines.select(*key, "words").mapInArrow(run, schema)
