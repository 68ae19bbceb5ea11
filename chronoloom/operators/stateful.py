"""Operators whose next step depends on the last one's outcome. Each series is folded on its own, in a pandas function that Spark deals out by key.

A task holds one series at a time (a plan's words or samples); the work per row is small and constant.
"""

from __future__ import annotations

import heapq
import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def _schema(df: DataFrame, more: str) -> str:
    return f"{', '.join(f'`{c}` {t}' for c, t in df.dtypes)}, {more}"


def sentences(words: DataFrame, by: list[str], longest: float, ends: tuple[str, ...] = (".", "!", "?")) -> DataFrame:
    """words with sentence: a new one after a word that ends one, and once longest seconds have passed since its start."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "word_i"], kind="stable")
        out, n, begin = [], -1, None
        for text, start, end in zip(rows["text"], rows["start"], rows["end"], strict=True):
            if begin is None:
                n, begin = n + 1, start
            out.append(n)
            if str(text).endswith(ends) or end - begin >= longest:
                begin = None
        return rows.assign(sentence=out)

    return words.groupBy(*by).applyInPandas(fold, _schema(words, "sentence long"))


def attack_release(series: DataFrame, by: list[str], attack: float, release: float) -> DataFrame:
    """series with level: it nears value by the share attack when rising and release when falling."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        y, out = None, []
        for x in rows["value"]:
            y = x if y is None else y + (attack if x > y else release) * (x - y)
            out.append(y)
        return rows.assign(level=out)

    return series.groupBy(*by).applyInPandas(fold, _schema(series, "level double"))


def followed(series: DataFrame, by: list[str], dead: float, frequency: float, step: float = 1.0) -> DataFrame:
    """series with followed: a critically damped spring towards the last value that left the dead zone around the target."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        x = v = target = None
        out = []
        decay = np.exp(-frequency * step)
        for value in rows["value"]:
            if target is None:
                x, v, target = value, 0.0, value
            elif abs(value - target) > dead:
                target = value
            offset = x - target
            slope = (v + frequency * offset) * step
            x, v = target + (offset + slope) * decay, (v - frequency * slope) * decay
            out.append(x)
        return rows.assign(followed=out)

    return series.groupBy(*by).applyInPandas(fold, _schema(series, "followed double"))


def packed_rows(intervals: DataFrame, by: list[str]) -> DataFrame:
    """intervals with row: the first of the rows that is free when it starts."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "end"], kind="stable")
        busy: list[tuple[float, int]] = []
        free: list[int] = []
        used, out = 0, []
        for start, end in zip(rows["start"], rows["end"], strict=True):
            while busy and busy[0][0] <= start:
                heapq.heappush(free, heapq.heappop(busy)[1])
            if free:
                at = heapq.heappop(free)
            else:
                at, used = used, used + 1
            heapq.heappush(busy, (end, at))
            out.append(at)
        return rows.assign(row=out)

    return intervals.groupBy(*by).applyInPandas(fold, _schema(intervals, "row long"))


def spaced(rows: DataFrame, by: list[str], order: list[str], least: int, index: str = "idx") -> DataFrame:
    """The rows, in order of preference, that are at least so far from all taken before them."""

    def fold(part: pd.DataFrame) -> pd.DataFrame:
        import bisect

        part = part.sort_values(order, kind="stable")
        taken: list[int] = []
        keep = []
        for x in part[index]:
            at = bisect.bisect_left(taken, x)
            ok = (at == 0 or x - taken[at - 1] >= least) and (at == len(taken) or taken[at] - x >= least)
            if ok:
                taken.insert(at, x)
            keep.append(ok)
        return part[keep]

    return rows.groupBy(*by).applyInPandas(fold, ", ".join(f"`{c}` {t}" for c, t in rows.dtypes))


def segmented(words: DataFrame, by: list[str], most: int, width: int, ideal: int, function_words: tuple[str, ...] = ()) -> DataFrame:
    """words with segment: the cuts of least cost. A segment has at most most words; it costs its distance from ideal characters, more beyond width,

    a function word at its end, and less a pause after it. A dynamic program over each group.
    """

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["start", "word_i"], kind="stable")
        texts = [str(x) for x in rows["text"]]
        start, end = rows["start"].to_numpy(), rows["end"].to_numpy()
        n = len(texts)
        cost, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
        for i in range(1, n + 1):
            size = -1
            pause = max(0.0, start[i] - end[i - 1]) if i < n else 1.0
            tail = 15.0 * (texts[i - 1].lower() in function_words) - 5.0 * min(pause, 1.0) - 8.0 * texts[i - 1].endswith((",", ";", ":"))
            for j in range(i - 1, max(-1, i - 1 - most), -1):
                size += len(texts[j]) + 1
                c = cost[j] + abs(size - ideal) + 10.0 * max(0, size - width) + tail
                if c < cost[i] - 1e-12:
                    cost[i], back[i] = c, j
        cuts, i = [], n
        while i:
            cuts.append((back[i], i))
            i = back[i]
        segment = np.zeros(n, np.int64)
        for k, (a, b) in enumerate(reversed(cuts)):
            segment[a:b] = k
        return rows.assign(segment=segment)

    return words.groupBy(*by).applyInPandas(fold, _schema(words, "segment long"))


def quantile(values: np.ndarray, share: float) -> float:
    """What quantile_cont gives, to the last bit: a value on the edge of two levels falls on the same side. np.percentile weighs its two neighbours in another order."""
    at = (len(values) - 1) * share
    i = int(at)
    low, high = (float(x) for x in np.partition(values, [i, min(i + 1, len(values) - 1)])[[i, min(i + 1, len(values) - 1)]])
    return low if at == i else math.fma(low, 1.0 - (at - i), high * (at - i))


def sections(bars: DataFrame, by: list[str], levels: int = 3) -> DataFrame:
    """bars with label: levels are runs of the quantised value, single bars join the run before; intro, outro, drop after build, verse or break."""

    def fold(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx", kind="stable")
        v = rows["value"].to_numpy(float)
        low, high = quantile(v, 0.1), quantile(v, 0.9)
        q = np.clip(((v - low) / max(high - low, 1e-9) * levels).astype(int), 0, levels - 1)
        for i in range(1, len(q) - 1):
            if q[i] != q[i - 1] and q[i] != q[i + 1]:
                q[i] = q[i - 1]
        edges = [0, *(np.flatnonzero(np.diff(q)) + 1), len(q)]
        runs = [(a, b, q[a]) for a, b in zip(edges[:-1], edges[1:], strict=True)]
        labels: list[str] = []
        for k, (_, _, level) in enumerate(runs):
            after = runs[k + 1][2] if k + 1 < len(runs) else None
            if k == 0 and level < levels - 1:
                labels.append("intro")
            elif k == len(runs) - 1 and level < levels - 1:
                labels.append("outro")
            elif level == levels - 1:
                labels.append("drop")
            elif after == levels - 1:
                labels.append("build")
            else:
                labels.append("verse" if level else "break")
        out = [x for (a, b, _), x in zip(runs, labels, strict=True) for _ in range(b - a)]
        return rows.assign(label=out)

    return bars.groupBy(*by).applyInPandas(fold, _schema(bars, "label string"))


def matched_words(title: DataFrame, spoken: DataFrame, by: list[str], ahead: int = 6) -> DataFrame:
    """title words with start: that of the next spoken word, at most ahead words on, that is equal or shares a prefix of 3; else interpolated.

    title has word_i and text, spoken word_i, text and start; starts never fall.
    """

    def fold(key: tuple, a: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        a, b = a.sort_values("word_i", kind="stable"), b.sort_values("word_i", kind="stable")
        heard, times, at, found = [str(x).lower() for x in b["text"]], b["start"].tolist(), 0, []
        for w in (str(x).lower() for x in a["text"]):
            hit = next((j for j in range(at, min(at + ahead, len(heard))) if heard[j] == w or len(w) >= 3 and len(heard[j]) >= 3 and heard[j][:3] == w[:3]), None)
            found.append(times[hit] if hit is not None else None)
            at = hit + 1 if hit is not None else at
        start = pd.Series(found, dtype="float64").interpolate(limit_direction="both").cummax() if len(found) else pd.Series([], dtype="float64")
        out = a[[*by, "word_i", "text"]].copy()
        out["start"] = start.to_numpy()
        return out

    types = dict(title.dtypes)
    return title.groupBy(*by).cogroup(spoken.groupBy(*by)).applyInPandas(fold, f"{', '.join(f'`{c}` {types[c]}' for c in [*by, 'word_i', 'text'])}, start double")
