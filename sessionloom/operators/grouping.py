"""Sessions to groups, groups to clusters, records to topics."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import RulePath, flatten_rules
from ..schemas import (
    ASSIGNMENT_JSON,
    DEFAULT_GROUP_FIELD,
    RECORD_LABELS,
    REDUCED_LABELS,
    TOPIC_EXTERNAL,
    TOPIC_INTERNAL,
    TOPIC_UPLOAD,
    UNMATCHED_GROUP,
)
from .lookup import ROW_OVERHEAD, lookup_join
from .updates import keep_labels

EXPRESSION_PATHS = 64  # more paths than this are matched by joins


def _field(features: str, position: int) -> Column:
    return F.get(F.col(features), F.lit(position))


def _matched_by_expression(df: DataFrame, paths: Sequence[RulePath], features: str) -> DataFrame:
    branches = []
    for path in sorted(paths, key=lambda p: -p.rank):
        holds = F.lit(True)
        for position, wanted in path.conditions:
            holds = holds & (_field(features, position) == wanted)
        branches.append(F.when(holds, F.lit(path.group)))
    return df.withColumn("_matched", F.coalesce(*branches, F.lit(None).cast("string")))


def _matched_by_joins(df: DataFrame, paths: Sequence[RulePath], features: str) -> DataFrame:
    """One equi-join per set of tested positions; the highest rank of all joins decides.

    Each rule table is unique in its keys, so no join multiplies sessions.
    """
    shapes: dict[tuple[int, ...], dict[tuple[str, ...], RulePath]] = {}
    for path in paths:
        values = tuple(value for _, value in path.conditions)
        best = shapes.setdefault(path.positions, {})
        if values not in best or best[values].rank < path.rank:
            best[values] = path
    found = []
    for n, (positions, best) in enumerate(shapes.items()):
        hit = f"_hit{n}"
        found.append(hit)
        if not positions:
            (path,) = best.values()
            df = df.withColumn(hit, F.struct(F.lit(path.rank).alias("rank"), F.lit(path.group).alias("group")))
            continue
        keys = [f"_k{n}_{position}" for position in positions]
        rows = [(*values, path.rank, path.group) for values, path in best.items()]
        schema = ", ".join([*(f"{key} string" for key in keys), "_rank int", "_group string"])
        table = df.sparkSession.createDataFrame(rows, schema).select(
            *keys, F.struct(F.col("_rank").alias("rank"), F.col("_group").alias("group")).alias(hit)
        )
        for key, position in zip(keys, positions, strict=True):
            df = df.withColumn(key, _field(features, position))
        size = sum(ROW_OVERHEAD + sum(len(str(cell)) for cell in row) for row in rows)
        df = lookup_join(df, table, keys, "left", size=size).drop(*keys)
    ranked = F.array_max(F.array_compact(F.array(*found)))
    return df.withColumn("_matched", ranked["group"]).drop(*found)


def match_groups(
    df: DataFrame,
    rules: str | dict,
    default: str = "asn",
    features: str = "features",
    expression_paths: int = EXPRESSION_PATHS,
) -> DataFrame:
    """Add ``group_id`` from rules over feature values; the last rule that holds wins.

    ``default`` says what an unmatched session gets: ``asn`` the default feature,
    ``null`` the unmatched group. ``asn_only`` gives every session the default
    feature, whatever the rules say. A small rule set becomes one CASE expression,
    a large one joins.
    """
    return match_paths(df, flatten_rules(rules), default, features, expression_paths)


def match_paths(
    df: DataFrame,
    paths: Sequence[RulePath],
    default: str = "asn",
    features: str = "features",
    expression_paths: int = EXPRESSION_PATHS,
    tested: str | None = None,
) -> DataFrame:
    """``match_groups`` from flat paths, whose positions are those of the column ``tested`` (by default the features)."""
    asn = _field(features, DEFAULT_GROUP_FIELD)
    if default == "asn_only":
        return df.withColumn("group_id", asn)
    fallback = {"asn": asn, "null": F.lit(UNMATCHED_GROUP)}[default]
    match = _matched_by_expression if len(paths) <= expression_paths else _matched_by_joins
    matched = match(df, paths, tested or features)
    group = F.coalesce(F.nullif(F.col("_matched"), F.lit("")), fallback)
    return matched.withColumn("group_id", group).drop("_matched")


def latest_assignment(
    df: DataFrame, self_cluster: str, order: Sequence[str] = ("offset",), value: str = "value"
) -> DataFrame:
    """Latest cluster of each group from assignment messages.

    Later messages win, and later entries of one message. The unmatched group
    belongs to the own cluster until a message says otherwise.
    """
    entries = df.select(
        *order, F.posexplode(F.from_json(value, ASSIGNMENT_JSON)["GroupAssignment"]).alias("_pos", "_entry")
    ).select(
        *order, "_pos", F.lit(1).alias("_sent"), F.col("_entry.GroupName").alias("group_id"),
        F.col("_entry.Cluster").alias("cluster_id"),
    )
    seed = df.sparkSession.createDataFrame(
        [(UNMATCHED_GROUP, self_cluster, 0)], "group_id string, cluster_id string, _sent int"
    )
    return (
        entries.filter(F.col("group_id").isNotNull())
        .unionByName(seed, allowMissingColumns=True)
        .groupBy("group_id")
        .agg(F.max_by("cluster_id", F.struct("_sent", *order, "_pos")).alias("cluster_id"))
    )


def cluster_of(df: DataFrame, assignment: DataFrame, self_cluster: str) -> DataFrame:
    """Add the cluster of each row's group; a group without one belongs to the own cluster."""
    joined = lookup_join(df, assignment.select("group_id", "cluster_id"), ["group_id"], "left")
    return joined.withColumn("cluster_id", F.coalesce("cluster_id", F.lit(self_cluster)))


def route_updates(
    df: DataFrame,
    assignment: DataFrame,
    self_cluster: str,
    labels: Sequence[str] = tuple(RECORD_LABELS),
    kept: Sequence[str] = tuple(REDUCED_LABELS),
) -> DataFrame:
    """Two messages per record: the raw upload, and the reduced update for its group's cluster.

    Groups of the own cluster, and groups without one, go to the internal topic.
    """
    return routed_messages(cluster_of(df, assignment, self_cluster), self_cluster, labels, kept, list(df.columns))


def routed_messages(
    routed: DataFrame,
    self_cluster: str,
    labels: Sequence[str] = tuple(RECORD_LABELS),
    kept: Sequence[str] = tuple(REDUCED_LABELS),
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """The two messages of records that know their ``cluster_id``; ``columns`` are those of the records that stay."""
    topic = F.when(F.col("cluster_id") == self_cluster, TOPIC_INTERNAL).otherwise(TOPIC_EXTERNAL)
    reduced = F.to_json(
        F.struct(
            keep_labels(F.col("update"), labels, kept).alias("update"),
            F.col("group_id"),
            F.col("cluster_id"),
        )
    )
    messages = F.array(
        F.struct(F.lit(TOPIC_UPLOAD).alias("topic"), F.col("update").alias("value")),
        F.struct(topic.alias("topic"), reduced.alias("value")),
    )
    others = [c for c in columns or routed.columns if c not in ("update", "group_id")]
    return routed.select(*others, "group_id", F.inline(messages))
