"""Ingest: session records and update messages as typed columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wire import fields
from ..schemas import FIELD_SEPARATOR, UPDATE_JSON


def parse_updates(df: DataFrame, value: str = "value", cost_type: str = "double") -> DataFrame:
    """Update messages as ``group_id, cluster_id, decision, cost, reward, ok``.

    The reward is the negated cost. A message that is no JSON, lacks the group or
    has no numeric score keeps its row with ``ok`` false. With a decimal
    ``cost_type`` later sums are exact and do not depend on row order.
    """
    message = F.from_json(F.trim(value), UPDATE_JSON)
    cost = F.trim(F.get("_parts", F.lit(1))).try_cast(cost_type)
    # One-element explode: filters on parsed fields stay above it, so the JSON is read once a row.
    once = df.withColumn("_m", F.explode(F.array(message)))
    staged = once.withColumn("_parts", fields(F.col("_m.update")))
    parsed = staged.select(
        *[c for c in df.columns if c != value],
        F.col("_m.group_id").alias("group_id"),
        F.col("_m.cluster_id").alias("cluster_id"),
        F.get("_parts", F.lit(0)).alias("decision"),
        cost.alias("cost"),
    )
    complete = F.col("group_id").isNotNull() & F.col("decision").isNotNull() & F.col("cost").isNotNull()
    return parsed.withColumn("reward", -F.col("cost")).withColumn("ok", complete)


def valid_updates(df: DataFrame) -> DataFrame:
    return df.filter("ok").drop("ok")


def keep_labels(update: Column, labels: Sequence[str], kept: Sequence[str]) -> Column:
    """The record cut down to the ``kept`` labels, in their order; NULL if one is missing from it."""
    unknown = [label for label in kept if label not in labels]
    if unknown:
        raise ValueError(f"labels not in the record: {unknown}")
    places = [list(labels).index(label) for label in kept]
    parts = fields(update)
    picked = [F.get(parts, F.lit(place)) for place in places]
    return F.when(F.size(parts) > max(places), F.concat_ws(FIELD_SEPARATOR, *picked))


def project_labels(
    df: DataFrame, labels: Sequence[str], kept: Sequence[str], column: str = "update"
) -> DataFrame:
    return df.withColumn(column, keep_labels(F.col(column), labels, kept))


def build_update(df: DataFrame, keys: Sequence[str] = ("update", "group_id"), name: str = "value") -> DataFrame:
    """Wrap payload and group (and cluster, if asked for) as one JSON message."""
    return df.withColumn(name, F.to_json(F.struct(*keys)))


def feedback(df: DataFrame, delay: str = "2 seconds") -> DataFrame:
    """The report of a served session: its features, the decision and the cost, due after ``delay``."""
    record = F.concat_ws(
        FIELD_SEPARATOR, F.concat_ws(FIELD_SEPARATOR, "features"), "decision", F.col("cost").cast("string")
    )
    return df.withColumn("update", record).withColumn("due", F.col("ts") + F.expr(f"interval {delay}"))
