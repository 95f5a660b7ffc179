"""Event-time ticks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def utc(ts: Column | str) -> Column:
    """A time without zone read as UTC, whatever zone the session has.

    A session zone with summer time still cannot hold the hour it skips; the
    library's own sessions use UTC.
    """
    return F.timestamp_micros(F.timestamp_diff("MICROSECOND", F.expr("TIMESTAMP_NTZ'1970-01-01'"), ts))


def tick_of(ts: Column | str, seconds: int) -> Column:
    """Index of the tick of ``seconds`` length that holds ``ts``."""
    column = F.col(ts) if isinstance(ts, str) else ts
    return F.floor(F.unix_seconds(column.cast("timestamp")) / F.lit(seconds)).cast("bigint")


RUN = 1 << 16


def number_line(span: DataFrame, low: str, high: str, name: str) -> DataFrame:
    """One row for each whole number from ``low`` to ``high``, in ``name``.

    Runs of numbers are dealt out to the tasks, which write them out: no array is longer than a run, and a long line is made by many tasks.
    """
    runs = span.filter(F.col(low) <= F.col(high)).withColumn(
        "_run", F.explode(F.sequence(F.floor(F.col(low) / RUN), F.floor(F.col(high) / RUN)))
    )
    dealt = runs.repartition(int(span.sparkSession.conf.get("spark.sql.shuffle.partitions")), "_run")
    first, last = F.greatest(F.col(low), F.col("_run") * RUN), F.least(F.col(high), F.col("_run") * RUN + RUN - 1)
    return dealt.select(F.explode(F.sequence(first, last)).alias(name))


def tick_start(tick: Column | str, seconds: int) -> Column:
    column = F.col(tick) if isinstance(tick, str) else tick
    return F.timestamp_seconds(column * F.lit(seconds))
