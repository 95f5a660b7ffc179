"""Subscriptions, pushed decisions and the whole exchange between clusters, over streams."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions.ticks import tick_of
from ..operators.exchange import feature_counts, forward_subscriptions, parse_subscriptions, push_decisions, subscriptions
from ..schemas import TOPIC_ALIVE, TOPIC_INTERNAL, TOPIC_SAMPLE, TOPIC_UPLOAD, UPDATE_JSON
from ..sources.folders import checkpoint_owner
from ..sources.messages import union_streams
from ..sources.outputs import BatchOutputs, Publisher
from ..sources.store import LatestStore
from .run import each_batch

PAIR = ("group_id", "cluster_id")
BACKEND = "backend"
KINDS = ("upload", "decision", "subscribe", "forward")


def subscription_store(spark: SparkSession, path: str, owner: str | None = None) -> LatestStore:
    return LatestStore(spark, path, PAIR, owner=owner)


def stream_subscriptions(df: DataFrame) -> DataFrame:
    """Subscribed pairs with their first tick, for update mode; state is one row per pair."""
    return subscriptions(df)


def push_batch(
    store: LatestStore, self_cluster: str, write: Callable[[DataFrame, int], None]
) -> Callable[[DataFrame, int], None]:
    """A batch writer that pushes decisions to the subscribers known when the batch starts."""

    def push(batch: DataFrame, batch_id: int) -> None:
        pairs = store.read()
        if pairs is not None:
            write(push_decisions(batch, pairs, self_cluster), batch_id)

    return push


def exchange_input(**streams: DataFrame) -> DataFrame:
    """The streams ``upload``, ``decision``, ``subscribe`` and ``forward`` (``key, ts, value`` each) as one, with their ``kind``."""
    unknown = set(streams) - set(KINDS)
    if unknown:
        raise ValueError(f"unknown kinds of messages: {sorted(unknown)}")
    named = [df.select(F.lit(kind).alias("kind"), "key", "ts", F.col("value").cast("string").alias("value")) for kind, df in streams.items()]
    return union_streams(*named)


def with_addresses(rows: DataFrame) -> DataFrame:
    """The messages with the ``group_id`` and ``cluster_id`` of forwarded updates, read once for all outputs."""
    message = F.when(F.col("kind") == "forward", F.from_json("value", UPDATE_JSON))
    once = rows.withColumn("_m", F.explode(F.array(message)))
    return once.select(*rows.columns, F.col("_m.group_id").alias("group_id"), F.col("_m.cluster_id").alias("cluster_id"))


def exchange_outputs(rows: DataFrame, pairs: DataFrame, self_cluster: str, clusters: Sequence[str], seconds: int, fraction: float) -> dict[str, DataFrame]:
    """What a batch of the exchange sends, from its messages ``with_addresses``: ``cluster_id, topic, value`` by the name of the output.

    To the backend: ``upload`` copies of the records, ``sample`` counts of their feature values, ``alive`` from this cluster, with or without records.
    To other clusters: ``push`` decisions for their subscriptions of earlier ticks, ``forward`` updates of their groups, and ``subscribe`` to
    the first cluster of each forwarded group and tick. Messages to clusters that are not in ``clusters`` go to ``unlisted``.
    """
    spark = rows.sparkSession
    uploads = rows.filter(F.col("kind") == "upload")
    counts = feature_counts(uploads, fraction, key="key")
    alive = spark.range(1).select(F.lit(BACKEND).alias("cluster_id"), F.lit(TOPIC_ALIVE).alias("topic"), F.lit(self_cluster).alias("value"))

    decisions = rows.filter(F.col("kind") == "decision").select(
        F.substring_index("value", ";", 1).alias("group_id"), tick_of("ts", seconds).alias("b"), "value"
    )
    pushed = push_decisions(decisions, pairs, self_cluster).select("cluster_id", "topic", "value")

    owned = rows.filter(F.col("kind") == "forward")
    known = owned.select("cluster_id", "group_id", tick_of("ts", seconds).alias("b"), "key", "value").filter(
        F.col("cluster_id").isNotNull() & F.col("group_id").isNotNull()
    )
    forwarded = known.select("cluster_id", F.lit(TOPIC_INTERNAL).alias("topic"), "value")
    subscribed = forward_subscriptions(known, self_cluster, ("key",)).select("cluster_id", "topic", "value")

    listed = F.col("cluster_id").isin(list(clusters))
    between = {"push": pushed, "forward": forwarded, "subscribe": subscribed}
    strays = union_streams(*[df.filter(~listed) for df in between.values()])
    return {
        "upload": uploads.select(F.lit(BACKEND).alias("cluster_id"), F.lit(TOPIC_UPLOAD).alias("topic"), "value"),
        "sample": counts.select(F.lit(BACKEND).alias("cluster_id"), F.lit(TOPIC_SAMPLE).alias("topic"), "value"),
        "alive": alive,
        **{name: df.filter(listed) for name, df in between.items()},
        "unlisted": strays,
    }


def exchange_stream(
    messages: DataFrame,
    out_path: str,
    state_path: str,
    checkpoint: str,
    self_cluster: str,
    clusters: Sequence[str],
    seconds: int = 1,
    fraction: float = 0.01,
    publishers: Mapping[str, Publisher] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Run the exchange over ``messages`` (see ``exchange_input``).

    A batch first adds its subscriptions to those stored under ``state_path``, then publishes its outputs under ``out_path`` (see
    ``BatchOutputs``). Both are numbered by the batch, so after a loss of the driver at any point the batch goes on where it stopped: no output is
    written twice and none is left out. A decision goes to those who subscribed in an earlier tick than its own, whatever the batches are.
    """
    spark = messages.sparkSession
    kept: list[tuple[LatestStore, BatchOutputs]] = []

    def serve(batch: DataFrame, batch_id: int) -> None:
        if not kept:
            owner = checkpoint_owner(spark, checkpoint)
            kept.append((subscription_store(spark, state_path, owner), BatchOutputs(spark, out_path, owner, publishers)))
        store, outputs = kept[0]
        rows = with_addresses(batch).persist()
        try:
            heard = rows.filter(F.col("kind") == "subscribe").select(tick_of("ts", seconds).alias("b"), "value")
            new = subscriptions(parse_subscriptions(heard))
            # The earliest tick of a pair stays.
            store.merge(new.withColumn("early", -F.col("first_bucket")), batch_id, order=["early"])
            pairs = store.read(before=batch_id + 1)
            pairs = new if pairs is None else pairs.drop("early")
            outputs.publish(batch_id, exchange_outputs(rows, pairs, self_cluster, clusters, seconds, fraction))
        finally:
            rows.unpersist()

    return each_batch(messages, serve, checkpoint, "append", trigger)
