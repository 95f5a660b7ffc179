"""Sliding-window scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .state import KEYS, bucket_sums


def panes_per_window(length: int, slide: int) -> int:
    if length % slide:
        raise ValueError("the window length has to be a multiple of the slide")
    return length // slide


def window_scores(
    df: DataFrame, length: int, slide: int, keys: Sequence[str] = KEYS, reward: str = "reward"
) -> DataFrame:
    """Sum and count per key over windows of ``length`` seconds ending every ``slide`` seconds.

    Rewards are first summed to panes of one slide; each pane sum is then copied to
    the windows that hold it, so raw rows are never multiplied. A key with no
    record in a window has no row for it.
    """
    count = panes_per_window(length, slide)
    panes = bucket_sums(df, slide, keys, reward)
    ends = F.sequence(F.col("b") + 1, F.col("b") + count)
    return (
        panes.withColumn("_end", F.explode(ends))
        .groupBy(*keys, F.timestamp_seconds(F.col("_end") * slide).alias("w_end"))
        .agg(F.sum("s").alias("s"), F.sum("n").alias("n"))
    )
