"""Between clusters: subscriptions, pushed decisions, forwarded updates, uploads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import keyed_draw
from ..functions.ticks import number_line, tick_of
from ..functions.wire import fields
from ..schemas import MANAGEMENT_LABELS, TOPIC_ALIVE, TOPIC_DECISION, TOPIC_INTERNAL, TOPIC_SUBSCRIBE, TOPIC_UPLOAD
from ..session import materialize
from .lookup import lookup_join

SAMPLE_GRAIN = 1 << 32  # all values of a draw


def parse_subscriptions(df: DataFrame, value: str = "value") -> DataFrame:
    """``group;cluster`` messages as columns."""
    parts = F.split(F.col(value), ";", -1)
    others = [c for c in df.columns if c != value]
    return df.select(
        *others, F.get(parts, F.lit(0)).alias("group_id"), F.get(parts, F.lit(1)).alias("cluster_id")
    )


def subscriptions(df: DataFrame) -> DataFrame:
    """Every subscribed (group, cluster) pair with the tick of its first message."""
    return (
        df.filter(F.col("group_id").isNotNull() & F.col("cluster_id").isNotNull())
        .groupBy("group_id", "cluster_id")
        .agg(F.min("b").alias("first_bucket"))
    )


def subscriber_sets(pairs: DataFrame) -> DataFrame:
    """Sorted clusters of each group."""
    return pairs.groupBy("group_id").agg(F.array_sort(F.collect_set("cluster_id")).alias("clusters"))


def push_decisions(decisions: DataFrame, pairs: DataFrame, self_cluster: str) -> DataFrame:
    """Each decision once per other cluster that subscribed to its group in an earlier tick."""
    targets = pairs.filter(F.col("cluster_id") != self_cluster)
    return (
        lookup_join(decisions, targets, ["group_id"], "inner")
        .filter(F.col("first_bucket") < F.col("b"))
        .drop("first_bucket")
        .withColumn("topic", F.lit(TOPIC_DECISION))
    )


def forward_updates(df: DataFrame, clusters: DataFrame) -> DataFrame:
    """External updates addressed to the update topic of the cluster that owns the group.

    ``clusters`` is the configured list ``cluster_id, brokers``.
    """
    return lookup_join(df, clusters, ["cluster_id"], "inner").withColumn("topic", F.lit(TOPIC_INTERNAL))


def forward_subscriptions(df: DataFrame, self_cluster: str, order: Sequence[str] = ("ord",)) -> DataFrame:
    """One subscription per tick and forwarded group, to the cluster of the group's first record."""
    # A number as the order is folded by hash, record by record; the first of a handful of clusters is chosen after that. A missing one comes first.
    place = F.col(order[0]) if len(order) == 1 else F.struct(*order)
    firsts = df.groupBy("b", "group_id", "cluster_id").agg(F.min(place).alias("_place"), F.min(place.isNotNull()).alias("_placed"))
    target = F.min_by("cluster_id", F.struct("_placed", "_place", "cluster_id")).alias("cluster_id")
    message = F.concat(F.col("group_id"), F.lit(";" + self_cluster))
    return (
        firsts.groupBy("b", "group_id")
        .agg(target)
        .withColumn("topic", F.lit(TOPIC_SUBSCRIBE))
        .withColumn("value", message)
    )


def keyed_sample(df: DataFrame, fraction: float, key: str, seed: int = 42) -> DataFrame:
    """The rows whose draw falls under ``fraction``; the same rows on every run."""
    if fraction >= 1.0:
        return df
    return df.filter(keyed_draw(F.col(key), SAMPLE_GRAIN, "sample", seed) < fraction * SAMPLE_GRAIN)


def feature_counts(
    df: DataFrame,
    fraction: float = 0.01,
    skip_last: int = MANAGEMENT_LABELS,
    key: str = "event_id",
    seed: int = 42,
    value: str = "value",
) -> DataFrame:
    """How often each value occurs at each feature position of the sampled records."""
    parts = fields(F.col(value))
    features = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - skip_last, F.lit(0)))
    return (
        keyed_sample(df, fraction, key, seed)
        .select(F.posexplode(features).alias("pos", "feature"))
        .groupBy("pos", "feature")
        .agg(F.count(F.lit(1)).alias("n"))
        .withColumn("value", F.concat_ws(";", F.col("pos").cast("string"), "feature", F.col("n").cast("string")))
    )


def upload_copy(df: DataFrame, value: str = "value") -> DataFrame:
    """Every raw record, addressed to the upload topic."""
    return df.withColumn("topic", F.lit(TOPIC_UPLOAD)).withColumn("value", F.col(value))


def heartbeat(df: DataFrame, clusters: Sequence[str], seconds: int) -> DataFrame:
    """One row per configured cluster and tick, with the records seen; empty ticks are alive too."""
    seen = df.groupBy("cluster_id", tick_of("ts", seconds).alias("b")).agg(F.count(F.lit(1)).alias("n"))
    seen = materialize(seen, "seen")
    span = seen.agg(F.min("b").alias("lo"), F.max("b").alias("hi"))
    ticks = number_line(span, "lo", "hi", "b")
    spine = ticks.withColumn("cluster_id", F.explode(F.array(*[F.lit(c) for c in clusters])))
    return spine.join(seen, ["cluster_id", "b"], "left").select(
        "cluster_id",
        "b",
        F.coalesce("n", F.lit(0)).alias("n"),
        F.lit(TOPIC_ALIVE).alias("topic"),
        F.col("cluster_id").alias("value"),
    )
