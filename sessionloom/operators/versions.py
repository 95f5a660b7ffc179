"""Which version of a table was in force at a record's time: an as-of join on intervals cut into bins of time."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rules import RulePath, flatten_rules
from ..schemas import ASSIGNMENT_JSON
from .grouping import match_paths
from .lookup import BROADCAST_BYTES, fits_broadcast

LEAST_BINS, MOST_BINS = 64, 1 << 16


def intervals(versions: DataFrame, keys: Sequence[str], at: str, order: Sequence[str] = ()) -> DataFrame:
    """Versions with the time ``until`` which they hold, null for the last of a key.

    Of versions of one key and time the one with the greatest ``order`` holds, then the one with the greatest values. Rows without a
    time are left out.
    """
    others = [c for c in versions.columns if c not in (*keys, at)]
    newest = F.max_by(F.struct(*others), F.struct(*order, *others)).alias("_row")
    single = versions.filter(F.col(at).isNotNull()).groupBy(*keys, at).agg(newest).select(*keys, at, "_row.*")
    return single.withColumn("until", F.lead(at).over(Window.partitionBy(*keys).orderBy(at)))


def in_force(
    records: DataFrame,
    versions: DataFrame,
    keys: Sequence[str],
    at: str,
    time: str | Column = "ts",
    order: Sequence[str] = (),
    limit_bytes: int = BROADCAST_BYTES,
) -> DataFrame:
    """Records with the columns of the version of their keys that holds at their ``time``; null before the first one.

    ``at`` and ``time`` are timestamps. The span of the versions is cut into bins, as many as a key has versions on average and
    ``LEAST_BINS`` at least. A version stands in each bin that it reaches into, and records meet versions by an equi-join on keys and bin, with the bounds of the
    interval as a further condition: no record matches twice, a hot key is spread over its bins, and the table of versions grows to no more than
    about twice its rows and ``LEAST_BINS`` rows a key. It is broadcast if measured to be small. Keys that are null, and records without a
    time, match nothing.
    """
    held = intervals(versions, keys, at, order)
    facts = held.agg(
        F.min(F.unix_micros(at)).alias("lo"), F.max(F.unix_micros(at)).alias("hi"),
        F.count(F.lit(1)).alias("n"), F.approx_count_distinct(F.xxhash64(*keys)).alias("keys"),
    ).first()
    added = [c for c in versions.columns if c not in (*keys, at)]
    if facts["lo"] is None:
        return records.select("*", *[F.lit(None).cast(versions.schema[c].dataType).alias(c) for c in added])
    bins = max(LEAST_BINS, min(MOST_BINS, facts["n"] // max(facts["keys"], 1)))
    width = max(1, -(-(facts["hi"] - facts["lo"] + 1) // bins))

    def bin_of(column: str | Column) -> Column:
        # The last bin also takes all that comes later.
        place = F.floor((F.unix_micros(column) - F.lit(facts["lo"])) / F.lit(width))
        return F.least(F.lit(bins - 1), place).cast("bigint")

    last = F.when(F.col("until").isNull(), F.lit(bins - 1).cast("bigint")).otherwise(bin_of("until"))
    table = held.select(
        *[F.col(k).alias(f"_v_{k}") for k in keys], F.explode(F.sequence(bin_of(at), last)).alias("_v_bin"),
        F.col(at).alias("_v_at"), F.col("until").alias("_v_until"), *[F.col(c).alias(f"_v_{c}") for c in added],
    )
    rows = records.withColumn("_time", time if isinstance(time, Column) else F.col(time)).withColumn("_bin", bin_of("_time"))
    match = (F.col("_bin") == F.col("_v_bin")) & (F.col("_time") >= F.col("_v_at"))
    match = match & (F.col("_v_until").isNull() | (F.col("_time") < F.col("_v_until")))
    for key in keys:
        match = match & (F.col(key) == F.col(f"_v_{key}"))
    side = F.broadcast(table) if fits_broadcast(table, limit_bytes) else table
    return rows.join(side, match, "left").select(*records.columns, *[F.col(f"_v_{c}").alias(c) for c in added])


def assignment_versions(messages: DataFrame, at: str, order: Sequence[str] = ("offset",), value: str = "value") -> DataFrame:
    """Group-to-cluster messages as versions ``group_id, cluster_id`` from the time ``at`` on; later entries of a message win."""
    entries = messages.select(at, *order, F.posexplode(F.from_json(value, ASSIGNMENT_JSON)["GroupAssignment"]).alias("pos", "_entry"))
    named = entries.select(at, *order, "pos", F.col("_entry.GroupName").alias("group_id"), F.col("_entry.Cluster").alias("cluster_id"))
    return named.filter(F.col("group_id").isNotNull())


def cluster_at(
    records: DataFrame, assignments: DataFrame, self_cluster: str, at: str, time: str | Column = "ts", order: Sequence[str] = ("offset",), value: str = "value"
) -> DataFrame:
    """Add the cluster that a record's group was assigned to at its time; the own cluster before the first assignment."""
    found = in_force(records, assignment_versions(assignments, at, order, value), ["group_id"], at, time, [*order, "pos"])
    return found.drop(*order, "pos").withColumn("cluster_id", F.coalesce("cluster_id", F.lit(self_cluster)))


def rule_versions(messages: Sequence[tuple[int, str | dict]]) -> list[tuple[int, list[RulePath]]]:
    """Paths of every rule set with the second it holds from, in order of time; of equal times the later message holds."""
    held = {second: rules for second, rules in messages}
    return [(second, flatten_rules(held[second])) for second in sorted(held)]


def match_groups_at(
    df: DataFrame,
    versions: Sequence[tuple[int, str | dict]],
    time: str = "ts",
    default: str = "asn",
    features: str = "features",
    **options,
) -> DataFrame:
    """``match_groups`` with the rule set that was in force at each record's time; only the default before the first one.

    A rule set's number becomes one more tested feature, so all versions are one CASE expression, or one join for each set of tested
    positions however many versions there are.
    """
    staged = rule_versions(versions)
    starts = F.array(*[F.lit(second) for second, _ in staged]).cast("array<bigint>")
    number = F.size(F.filter(starts, lambda s: s <= F.unix_seconds(F.col(time)))).cast("string")
    paths, rank = [], 0
    for i, (_, own) in enumerate(staged, 1):
        for path in own:
            conditions = ((0, str(i)), *((position + 1, wanted) for position, wanted in path.conditions))
            paths.append(RulePath(rank, conditions, path.group))
            rank += 1
    versioned = df.withColumn("_versioned", F.concat(F.array(number), F.col(features)))
    return match_paths(versioned, paths, default, features, tested="_versioned", **options).drop("_versioned")

