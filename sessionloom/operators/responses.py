"""Response logs and message streams of load tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ticks import number_line
from ..session import materialize
from .ordinal import previous_value, with_ordinal

QUANTILE_ACCURACY = 10_000


def response_summary(headers: DataFrame, rows: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Sent, succeeded, failed, mean seconds, mean response time and real rate, per run or overall.

    Logs hold successes only. The real rate is requests sent over the mean sending
    time of the workers. Headers and rows are totalled in one aggregation.
    """
    headed = headers.select(*by, "sent", "seconds", F.lit(1).alias("_worker"))
    logged = rows.select(*by, "rt", F.lit(1).alias("_row"))
    totals = (
        headed.unionByName(logged, allowMissingColumns=True)
        .groupBy(*by)
        .agg(
            F.sum("sent").cast("bigint").alias("sent"),
            F.sum("seconds").cast("double").alias("_seconds"),
            F.count("_worker").alias("_workers"),
            F.count("_row").alias("succeeded"),
            F.sum("rt").cast("double").alias("_rt"),
        )
        .filter(F.col("_workers") > 0)
    )
    mean_seconds = F.col("_seconds") / F.col("_workers")
    return totals.select(
        *by,
        "sent",
        "succeeded",
        (F.col("sent") - F.col("succeeded")).alias("failed"),
        mean_seconds.alias("mean_seconds"),
        (F.col("_rt") / F.nullif(F.col("succeeded"), F.lit(0))).alias("mean_rt"),
        (F.col("sent") / F.nullif(mean_seconds, F.lit(0.0))).alias("rate"),
    )


def mean_of_runs(summary: DataFrame) -> DataFrame:
    """Mean rate and mean response time over repeated runs."""
    return summary.agg(
        F.count(F.lit(1)).alias("runs"), F.avg("rate").alias("mean_rate"), F.avg("mean_rt").alias("mean_rt")
    )


def response_by(rows: DataFrame, time: str = "sent", start: Column | None = None, millis: bool = True) -> DataFrame:
    """Mean response time (rounded to thousandths of a second) and successes per second of ``time``.

    Seconds count from the first sent request; seconds without a success are
    rows too, with zeros, up to the one after the last success.
    """
    begin = rows.select(F.min("sent")).scalar() if start is None else start
    staged = rows.withColumn("_at", F.col(time) - begin)
    second = F.greatest(F.ceil("_at") - 1, F.lit(0)).cast("bigint")
    seen = staged.groupBy(second.alias("second")).agg(
        F.count(F.lit(1)).alias("succeeded"),
        F.round(F.sum("rt") / F.count(F.lit(1)), 3).alias("mean_rt"),
        F.max("_at").alias("_last"),
    )
    # One row a second, read for its span and for its values.
    seen = materialize(seen, "seconds")
    span = seen.agg(F.lit(0).cast("bigint").alias("_lo"), F.ceil(F.max("_last")).cast("bigint").alias("_hi"))
    spine = number_line(span, "_lo", "_hi", "second")
    unit = 1000 if millis else 1
    return spine.join(seen, "second", "left").select(
        "second",
        (F.coalesce(F.col("mean_rt"), F.lit(0)) * unit).cast("double").alias("mean_rt"),
        F.coalesce("succeeded", F.lit(0)).alias("succeeded"),
    )


def response_cdf(rows: DataFrame, key: Sequence[str] = ("worker", "id"), unit: int = 1000) -> DataFrame:
    """Every response time in order (milliseconds) with the share of requests before it."""
    total = rows.select(F.count(F.lit(1))).scalar()
    placed = with_ordinal(rows.select("rt", *key), ["rt", *key], name="i")
    return placed.select(
        "i", (F.col("rt") * unit).cast("double").alias("rt"), ((F.col("i") - 1) / total).alias("share")
    )


def response_quantile(
    rows: DataFrame,
    q: float = 0.9,
    key: Sequence[str] = ("worker", "id"),
    accuracy: int = QUANTILE_ACCURACY,
    unit: int = 1000,
) -> DataFrame:
    """Element ``int(q * n)`` (from 0) of the sorted response times, exactly.

    Approximate quantiles around ``q`` bracket the value; only rows inside the
    bracket are numbered, the ones below are counted. Should the bracket miss,
    every row is numbered.
    """
    times = rows.filter(F.col("rt").isNotNull())
    margin = 2.0 / accuracy
    bounds = times.agg(
        F.count(F.lit(1)).alias("n"),
        F.percentile_approx("rt", [max(q - margin, 0.0), min(q + margin, 1.0)], accuracy).alias("cut"),
    ).first()
    if not bounds["n"]:
        return rows.select((F.col("rt") * unit).cast("double").alias("rt")).limit(0)
    rank = min(int(q * bounds["n"]), bounds["n"] - 1)
    low, high = (F.lit(cut).cast(rows.schema["rt"].dataType) for cut in bounds["cut"])
    inside = (F.col("rt") >= low) & (F.col("rt") <= high)
    counts = times.agg(
        F.count_if(F.col("rt") < low).alias("below"), F.count_if(inside).alias("inside")
    ).first()
    if counts["below"] <= rank < counts["below"] + counts["inside"]:
        times, rank = times.filter(inside), rank - counts["below"]
    placed = with_ordinal(times.select("rt", *key), ["rt", *key], name="i")
    return placed.filter(F.col("i") == rank + 1).select((F.col("rt") * unit).cast("double").alias("rt"))


def message_gaps(df: DataFrame, order_by: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Seconds since the previous message; NULL for the first one."""
    placed = with_ordinal(df, order_by, name="i")
    gaps = previous_value(placed, "ts", "_before", "i")
    micros = F.unix_micros("ts") - F.unix_micros("_before")
    return gaps.withColumn("gap", micros / 1_000_000).drop("_before")


def interarrival(df: DataFrame, n: int = 10, order_by: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Mean gap of each run of ``n`` gaps; a short last run is dropped.

    Gaps in a run add up to the time between its end messages, so only every
    ``n``-th message is shuffled.
    """
    placed = with_ordinal(df.select("ts", *[c for c in order_by if c != "ts"]), order_by, name="i")
    marks = placed.filter((F.col("i") - 1) % n == 0).withColumn("_k", F.floor((F.col("i") - 1) / n))
    ends = marks.withColumn("block", F.explode(F.array(F.col("_k"), F.col("_k") - 1)))
    return (
        ends.groupBy("block")
        .agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.count(F.lit(1)).alias("_ends"))
        .filter((F.col("_ends") == 2) & (F.col("block") >= 0))
        .select(
            F.col("block").cast("bigint").alias("block"),
            ((F.unix_micros("_to") - F.unix_micros("_from")) / (1_000_000 * n)).alias("mean_gap"),
        )
    )


def throughput_blocks(df: DataFrame, n: int, order_by: Sequence[str] = ("ts", "event_id")) -> DataFrame:
    """Seconds taken by each block of ``n`` acknowledged messages, with the running total.

    The first block is measured from the first message on.
    """
    placed = with_ordinal(df.select("ts", *[c for c in order_by if c != "ts"]), order_by, name="i")
    ending = F.array(F.floor(F.col("i") / n), F.floor(F.col("i") / n) + 1)
    starting = F.array(F.lit(1).cast("bigint"))
    homes = (
        F.when((F.col("i") % n == 0) & (F.col("i") == 1), F.concat(starting, ending))
        .when(F.col("i") % n == 0, ending)
        .otherwise(starting)
    )
    marks = placed.filter((F.col("i") % n == 0) | (F.col("i") == 1)).withColumn("block", F.explode(homes))
    return (
        marks.groupBy("block")
        .agg(F.min("ts").alias("_from"), F.max("ts").alias("_to"), F.count(F.lit(1)).alias("_ends"))
        .filter(F.col("_ends") >= 2)
        .select(
            F.col("block").cast("bigint").alias("block"),
            (F.col("block") * n).cast("bigint").alias("total"),
            ((F.unix_micros("_to") - F.unix_micros("_from")) / 1_000_000).alias("seconds"),
        )
    )
