"""Numbers, easings, colors and rectangles as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def clamp(x: Column, low: float, high: float) -> Column:
    return F.greatest(F.lit(low), F.least(F.lit(high), x))


def lerp(a: Column, b: Column, t: Column) -> Column:
    return a + (b - a) * t


def remap(x: Column, a: float, b: float, c: float, d: float) -> Column:
    """x from a..b to c..d, held inside; d if a = b."""
    if a == b:
        return F.lit(d)
    return c + clamp((x - a) / (b - a), 0.0, 1.0) * (d - c)


def easing(name: str, t: Column) -> Column:
    """t in 0..1 eased; a name that is unknown means out_cubic."""
    t = clamp(t, 0.0, 1.0)
    u = 1 - t
    powers = {"quad": 2, "cubic": 3, "quart": 4, "quint": 5}
    way, _, kind = name.partition("_")
    if name == "linear":
        return t
    if kind in powers and way in ("in", "out", "inout"):
        n = powers[kind]
        if way == "in":
            return F.pow(t, n)
        if way == "out":
            return 1 - F.pow(u, n)
        return F.when(t < 0.5, F.pow(t * 2, n) / 2).otherwise(1 - F.pow(u * 2, n) / 2)
    if name == "in_sine":
        return 1 - F.cos(t * math.pi / 2)
    if name == "out_sine":
        return F.sin(t * math.pi / 2)
    if name == "inout_sine":
        return (1 - F.cos(t * math.pi)) / 2
    if name == "out_expo":
        return F.when(t >= 1, 1.0).otherwise(1 - F.pow(F.lit(2.0), t * -10))
    if name == "out_back":
        return 1 + 2.70158 * F.pow(t - 1, 3) + 1.70158 * F.pow(t - 1, 2)
    return 1 - F.pow(u, 3)


def spring(t: Column, frequency: float, damping: float) -> Column:
    """The step response of a damped spring (damping under 1)."""
    w = 2 * math.pi * frequency
    wd = w * math.sqrt(1 - damping * damping)
    return 1 - F.exp(t * (-damping * w)) * (F.cos(t * wd) + damping * w / wd * F.sin(t * wd))


def to_db(x: Column) -> Column:
    return 20 * F.log10(F.greatest(x, F.lit(1e-10)))


def from_db(x: Column) -> Column:
    return F.pow(F.lit(10.0), x / 20)


def midi_hz(note: Column) -> Column:
    return 440 * F.pow(F.lit(2.0), (note - 69) / 12)


def channel(color: Column, i: int) -> Column:
    """The i-th of red, green and blue in #RRGGBB, 0..1."""
    return F.conv(F.substring(color, 2 + 2 * i, 2), 16, 10).cast("double") / 255


def luminance(color: Column) -> Column:
    """Relative luminance of #RRGGBB."""
    lin = [F.when(c <= 0.04045, c / 12.92).otherwise(F.pow((c + 0.055) / 1.055, 2.4)) for c in (channel(color, i) for i in range(3))]
    return 0.2126 * lin[0] + 0.7152 * lin[1] + 0.0722 * lin[2]


def contrast(a: Column, b: Column) -> Column:
    x, y = luminance(a), luminance(b)
    return (F.greatest(x, y) + 0.05) / (F.least(x, y) + 0.05)


def ink(background: Column) -> Column:
    """Black or white, whichever stands out more."""
    return F.when(contrast(background, F.lit("#FFFFFF")) >= contrast(background, F.lit("#000000")), "#FFFFFF").otherwise("#000000")


def normal_color(text: Column) -> Column:
    """#RGB, #RRGGBB and #RRGGBBAA in upper case and full length; null for anything else."""
    short = F.regexp_replace(F.upper(text), "^#([0-9A-F])([0-9A-F])([0-9A-F])$", "#$1$1$2$2$3$3")
    return F.when(short.rlike("^#(?:[0-9A-F]{6}|[0-9A-F]{8})$"), short)


def overlap_area(a: list[Column], b: list[Column]) -> Column:
    """Of two rectangles, each x, y, width, height."""
    width = F.least(a[0] + a[2], b[0] + b[2]) - F.greatest(a[0], b[0])
    height = F.least(a[1] + a[3], b[1] + b[3]) - F.greatest(a[1], b[1])
    return F.greatest(F.lit(0.0), width) * F.greatest(F.lit(0.0), height)


def even(x: Column) -> Column:
    """The nearest even whole number, the larger of two."""
    return F.floor(x / 2 + 0.5).cast("long") * 2


def finite(x: Column, default: float | None = None) -> Column:
    """x as a double, or the default where it is missing, no number, NaN or infinite."""
    y = x.try_cast("double")
    return F.when(y.isNotNull() & ~F.isnan(y) & (F.abs(y) < float("inf")), y).otherwise(F.lit(default).cast("double"))
