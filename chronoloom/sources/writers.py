"""Lines of subtitles and of per-frame commands, and tables whose columns grow."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import subtitle_clock


def subtitle_lines(captions: DataFrame, by: list[str], style: str = "Default") -> DataFrame:
    """by, start and line: a dialogue line for each caption (start, end, text); line breaks become \\N and braces go."""
    text = F.regexp_replace(F.regexp_replace("text", "[{}]", ""), r"\r?\n", r"\\N")
    line = F.concat(F.lit("Dialogue: 0,"), subtitle_clock(F.col("start")), F.lit(","), subtitle_clock(F.col("end")), F.lit(f",{style},,0,0,0,,"), text)
    return captions.select(*by, "start", line.alias("line"))


def command_lines(track: DataFrame, by: list[str], fps: float) -> DataFrame:
    """by, frame and line: the time of each frame and the x its crop begins at."""
    return track.select(*by, "frame", F.format_string("%.4f crop x %d;", F.col("frame") / fps, F.floor(F.col("x") + 0.5).cast("long")).alias("line"))


def write_grouped(lines: DataFrame, by: list[str], order: str, path: str) -> None:
    """Text files, a folder for each group, the lines of each in order."""
    lines.repartition(*by).sortWithinPartitions(*by, order).select(*by, "line").write.partitionBy(*by).mode("overwrite").text(path)


def appended(old: DataFrame, new: DataFrame) -> DataFrame:
    """Both, with the columns of either; what one lacks is null there."""
    return old.unionByName(new, allowMissingColumns=True)
