"""Series: moving and block means, pairing and side-by-side comparison."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import materialize
from .ordinal import numbered_rows, placed_rows, with_ordinal


def _means(rows: DataFrame, keys: list[str], value: str, n: int) -> DataFrame:
    """Mean per key of groups that hold exactly ``n`` rows."""
    return (
        rows.groupBy(*keys)
        .agg(F.sum(value).cast("double").alias("_sum"), F.count(F.lit(1)).alias("_n"))
        .filter(F.col("_n") == n)
        .select(*keys, (F.col("_sum") / n).alias("mean"))
    )


def moving_avg(
    df: DataFrame,
    value: str = "value",
    order_by: Sequence[str] = ("idx",),
    within: Sequence[str] = (),
    n: int = 60,
    every: int = 60,
) -> DataFrame:
    """Mean of the last ``n`` values of a series at its rows ``every``, ``2 * every``, ..

    Each row adds to the points that hold it in their window; points with fewer
    than ``n`` rows before them, and the tail, give nothing. No window function, so
    a long series is averaged by many tasks.
    """
    placed = with_ordinal(df.select(*within, *order_by, value), order_by, within, "i")
    first = F.ceil(F.col("i") / every) * every
    points = F.sequence(first, F.col("i") + (n - 1), F.lit(every).cast("bigint"))
    held = placed.filter(first <= F.col("i") + (n - 1)).withColumn("at", F.explode(points))
    means = _means(held, [*within, "at"], value, n)
    return means.withColumnRenamed("at", "i")


def block_means(
    df: DataFrame,
    value: str = "cost",
    order_by: Sequence[str] = ("line_no",),
    within: Sequence[str] = ("part",),
    n: int = 100,
) -> DataFrame:
    """Mean of each block of ``n`` consecutive rows of a series; a short last block is dropped."""
    placed = with_ordinal(df.select(*within, *order_by, value), order_by, within, "i")
    block = F.floor((F.col("i") - 1) / n).cast("bigint")
    return _means(placed.withColumn("block", block), [*within, "block"], value, n)


def failover_blocks(
    df: DataFrame, frontends: int = 2, value: str = "cost", order_by: Sequence[str] = ("line_no",), n: int = 100
) -> DataFrame:
    """Block means of the sessions of front end 0 and of all others, sessions dealt to front ends in turn.

    The sessions are priced once, then stored in order; their numbers in the trace and in their part both come from that copy.
    """
    placed = placed_rows(materialize(df.select(*order_by, value), "sessions"), order_by)
    dealt = numbered_rows(placed, "ordinal", dense=True).withColumn("frontend", (F.col("ordinal") - 1) % frontends)
    parts = numbered_rows(dealt.withColumn("part", frontend_part()), "i", ["part"])
    block = F.floor((F.col("i") - 1) / n).cast("bigint")
    return _means(parts.withColumn("block", block), ["part", "block"], value, n)


def paired_blocks(means: DataFrame) -> DataFrame:
    """The two series of :func:`failover_blocks` side by side by block, with the gap between their lengths, in one pass over them."""
    both = means.groupBy("block").agg(
        F.max(F.when(F.col("part") == 0, F.col("mean"))).alias("first"), F.max(F.when(F.col("part") == 1, F.col("mean"))).alias("second")
    )
    # Blocks come without holes, so those of one series only are the gap.
    single = F.col("first").isNull() | F.col("second").isNull()
    stored = materialize(both, "pairs")
    gap = stored.select(F.count_if(single)).scalar()
    return stored.filter(~single).withColumn("gap", gap)


def frontend_part(frontend: str = "frontend"):
    """Front end 0 is one series, all others together are the second."""
    return F.when(F.col(frontend) == 0, 0).otherwise(1)


def zip_series(a: DataFrame, b: DataFrame, index: str = "block", value: str = "mean") -> DataFrame:
    """Two series side by side by index, cut to the shorter one."""
    left = a.select(index, F.col(value).alias("first"))
    right = b.select(index, F.col(value).alias("second"))
    return left.join(right, index, "inner")


def length_gap(a: DataFrame, b: DataFrame) -> DataFrame:
    """How many more points one series has than the other."""
    counted = a.select(F.lit(1).alias("_sign")).unionByName(b.select(F.lit(-1).alias("_sign")))
    return counted.agg(F.abs(F.coalesce(F.sum("_sign"), F.lit(0))).alias("gap"))


def compare(
    df: DataFrame, series: str, names: Sequence[str], keys: Sequence[str] = ("group_id", "i"), value: str = "mean"
) -> DataFrame:
    """One column per named series, side by side on ``keys``."""
    return df.groupBy(*keys).pivot(series, list(names)).agg(F.first(value, ignorenulls=True))
