"""Message, table and series sinks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from .store import LatestStore


def write_messages(
    df: DataFrame,
    format: str = "kafka",
    path: str | None = None,
    options: Mapping[str, str] | None = None,
    checkpoint: str | None = None,
    topic: str = "topic",
    value: str = "value",
    trigger: Mapping | None = None,
) -> StreamingQuery | None:
    """Publish one message per row to the topic its ``topic`` column names.

    ``kafka`` takes brokers from ``options``; file formats write one folder per
    topic. A stream needs ``checkpoint`` and returns its query.
    """
    messages = df.select(F.col(topic).alias("topic"), F.col(value).cast("string").alias("value"))
    if not df.isStreaming:
        writer = messages.write.format(format).options(**(options or {}))
        if format == "kafka":
            writer.save()
        else:
            writer.mode("append").partitionBy("topic").save(path)
        return None
    if not checkpoint:
        raise ValueError("a message stream needs a checkpoint location")
    writer = (
        messages.writeStream.format(format)
        .options(**(options or {}))
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(**(trigger or {"processingTime": "2 seconds"}))
    )
    if format != "kafka":
        writer = writer.partitionBy("topic")
    return writer.start(path) if path else writer.start()


def write_by_cluster(
    df: DataFrame,
    clusters: Mapping[str, Mapping[str, str]],
    format: str = "kafka",
    batch: int | None = None,
    unlisted: Mapping[str, str] | None = None,
) -> None:
    """Publish each row to the brokers of its ``cluster_id``; call it on a batch or in ``foreachBatch``.

    ``clusters`` is the configuration: per cluster the writer's options (for files, ``path``). Rows of other clusters go where
    ``unlisted`` says, with their ``cluster_id``; without it they are an error, raised before anything is sent. The rows are kept while one
    filtered write per cluster goes over them. With the number of a ``batch`` files go to a folder of that batch in each topic, which a replay
    writes anew instead of appending to it. Brokers get a replayed batch twice.
    """
    rows = df.select("cluster_id", "topic", "value").persist()
    known = F.col("cluster_id").isin(list(clusters))

    def send(part: DataFrame, options: Mapping[str, str]) -> None:
        if format == "kafka":
            part.write.format(format).options(**options).save()
        elif batch is None:
            part.write.format(format).options(**options).mode("append").partitionBy("topic").save()
        else:
            writer = part.withColumn("batch", F.lit(batch)).write.format(format).options(**options)
            writer.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy("topic", "batch").save()

    try:
        others = rows.filter(~F.coalesce(known, F.lit(False)))
        if unlisted is None and (stray := others.select("cluster_id").first()) is not None:
            raise ValueError(f"no brokers for cluster {stray['cluster_id']!r}; name an output for unlisted clusters")
        for cluster, options in clusters.items():
            send(rows.filter(F.col("cluster_id") == cluster).select("topic", "value"), options)
        if unlisted is not None:
            named = F.to_json(F.struct("cluster_id", "value"))
            send(others.select("topic", named.alias("value")), unlisted)
    finally:
        rows.unpersist()


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """The row with the greatest ``order`` of each key."""
    others = [c for c in df.columns if c not in keys]
    newest = F.max_by(F.struct(*others), F.struct(*order)).alias("_row")
    return df.groupBy(*keys).agg(newest).select(*keys, "_row.*").select(*df.columns)


def upsert_latest(df: DataFrame, path: str, keys: Sequence[str], order: Sequence[str], version: int) -> None:
    """Merge the latest row per key into the table at ``path``; ``version`` is the batch id of a stream."""
    LatestStore(df.sparkSession, path, keys).merge(latest_per_key(df, keys, order), version, order=order)


def write_series(df: DataFrame, path: str) -> None:
    """Tab-separated text of all columns."""
    df.write.option("sep", "\t").csv(path)
