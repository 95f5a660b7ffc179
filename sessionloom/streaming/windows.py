"""Sliding-window scores over streams."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.selection import best_by_mean
from ..operators.state import KEYS
from ..operators.windows import panes_per_window


def stream_window_scores(
    df: DataFrame, length: int, slide: int, delay: str = "10 seconds", keys: Sequence[str] = KEYS
) -> DataFrame:
    """Sum and count per key and window, for append mode: a window comes out once it is closed."""
    scores = _closed_windows(df, length, slide, delay, keys)
    return scores.select(*keys, F.col("span.end").alias("w_end"), "s", "n")


def stream_best(df: DataFrame, length: int, slide: int, delay: str = "10 seconds", digits: int | None = None) -> DataFrame:
    """The decision with the best mean per group and closed window, and the sorted others, for append mode.

    A third aggregation on top of the two of the windows. ``digits`` rounds a window's sum
    first, where the order of additions must not show.
    """
    scores = _closed_windows(df, length, slide, delay, KEYS)
    if digits is not None:
        scores = scores.withColumn("s", F.round("s", digits))
    best = best_by_mean(scores, ("group_id", "span"))
    return best.select("group_id", F.col("span.end").alias("w_end"), "best", "others")


def _closed_windows(df: DataFrame, length: int, slide: int, delay: str, keys: Sequence[str]) -> DataFrame:
    """Two chained aggregations: raw rows to panes of one slide, closed panes to the windows that hold them."""
    panes_per_window(length, slide)
    panes = _closed_panes(df, slide, delay, keys)
    windows = F.window(F.window_time("pane"), f"{length} seconds", f"{slide} seconds").alias("span")
    return panes.groupBy(windows, *keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def _closed_panes(df: DataFrame, slide: int, delay: str, keys: Sequence[str]) -> DataFrame:
    return (
        df.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{slide} seconds").alias("pane"), *keys)
        .agg(F.sum("reward").cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    )


def stream_panes(df: DataFrame, slide: int, delay: str = "10 seconds", keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum and count per key and pane of one slide, for append mode; ``end`` is the end of the pane in epoch seconds.

    A pane comes out once, in the batch whose watermark passes its end.
    """
    panes = _closed_panes(df, slide, delay, keys)
    return panes.select(*keys, F.unix_seconds("pane.end").alias("end"), "s", "n")


def window_ends(panes: DataFrame, length: int, slide: int, after: int | None, through: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Sum and count per key over the windows of these panes that end ``after`` one time and not beyond ``through`` (epoch seconds).

    The panes are dealt by group, of which each has a row per decision and tick at most; what follows per group needs no other shuffle.
    """
    count = panes_per_window(length, slide)
    whole = [F.lit(n).cast("bigint") for n in (slide, (count - 1) * slide, through)]
    first = F.col("end") if after is None else F.greatest(F.col("end"), F.lit(after + slide).cast("bigint"))
    last = F.least(F.col("end") + whole[1], whole[2])
    parts = int(panes.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = panes.repartition(parts, keys[0]).withColumns({"_first": first, "_last": last}).filter("_first <= _last")
    ends = dealt.withColumn("w_end", F.explode(F.sequence("_first", "_last", whole[0])))
    return ends.groupBy(*keys, "w_end").agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
