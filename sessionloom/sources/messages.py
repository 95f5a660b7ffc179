"""Message sources, live and recorded."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.ticks import utc
from ..schemas import MESSAGE
from ..session import fresh_path

BLOCK = 10_000


def read_messages(
    spark: SparkSession,
    format: str = "kafka",
    path: str | None = None,
    options: dict[str, str] | None = None,
    streaming: bool = True,
    schema: str = MESSAGE,
) -> DataFrame:
    """Messages as ``value string, ts timestamp`` plus their place in the source.

    ``kafka`` adds ``topic, partition, offset``; it needs the connector package on
    the class path. ``text`` takes a file's modification time as ``ts``. Other
    formats are read with ``schema``.
    """
    reader = spark.readStream if streaming else spark.read
    reader = reader.format(format).options(**(options or {}))
    if format == "kafka":
        return reader.load().select(
            F.col("value").cast("string").alias("value"),
            F.col("timestamp").alias("ts"),
            "topic",
            "partition",
            "offset",
        )
    if format == "text":
        return reader.load(path).select("value", F.col("_metadata.file_modification_time").alias("ts"))
    df = reader.schema(schema).load(path)
    # A time without zone is no event time to a watermark.
    unzoned = "ts" in df.columns and isinstance(df.schema["ts"].dataType, T.TimestampNTZType)
    return df.withColumn("ts", utc("ts")) if unzoned else df


def union_streams(*dfs: DataFrame) -> DataFrame:
    """All rows of the given tables or streams, columns matched by name."""
    return reduce(lambda a, b: a.unionByName(b), dfs)


def _copies(seed: DataFrame, copies: int, at: Column) -> DataFrame:
    blocks = -(-copies // BLOCK)
    within = F.sequence(F.lit(0), F.lit(min(BLOCK, max(copies, 1)) - 1))
    return (
        seed.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(max(blocks, 1) - 1))))
        .withColumn("_copy", F.explode(within))
        .filter(F.col("_block") * BLOCK + F.col("_copy") < copies)
        .drop("_block", "_copy")
        .withColumn("ts", at)
    )


def preload(df: DataFrame, seed: DataFrame, copies: int, at: Column) -> DataFrame:
    """``df`` preceded by ``copies`` copies of each seed record, all at time ``at``."""
    return union_streams(df, _copies(seed, copies, at).select(*df.columns))


def preload_stream(df: DataFrame, seed: DataFrame, copies: int, at: Column) -> DataFrame:
    """The same for a stream: the copies are written once and join as a second stream."""
    history = _copies(seed, copies, at).select(*df.columns)
    path = fresh_path(seed.sparkSession, "preload")
    history.write.parquet(path)
    return union_streams(df, seed.sparkSession.readStream.schema(history.schema).parquet(path))
