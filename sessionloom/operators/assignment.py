"""Decisions for sessions, with repeatable draws."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.draws import keyed_draw
from .lookup import lookup_join
from .ordinal import with_ordinal

PERCENT_DRAWS = 101  # whole percents from 0 to 100, both ends included


def _drawn(items: str, key: str, name: str, seed: int) -> Column:
    """A uniform draw from an array; NULL if it is empty or missing."""
    size = F.size(F.coalesce(F.col(items), F.array().cast("array<string>")))
    return F.get(F.col(items), keyed_draw(F.col(key), size, name, seed).cast("int"))


def _candidate_or_drawn(decision: Column, key: str, seed: int) -> Column:
    usable = (decision != "") & F.array_contains("candidates", decision)
    return F.when(usable, decision).otherwise(_drawn("candidates", key, "fallback", seed))


def assign_uniform(sessions: DataFrame, picks: DataFrame, seed: int = 42, key: str = "event_id") -> DataFrame:
    """Draw each session's decision from its group's pick list.

    Without a list, or when the draw is no candidate of the session, draw from the
    candidates.
    """
    joined = lookup_join(sessions, picks.select("group_id", "picks"), ["group_id"], "left")
    decision = _candidate_or_drawn(_drawn("picks", key, "pick", seed), key, seed)
    return joined.withColumn("decision", decision).drop("picks")


def assign_epsilon(
    sessions: DataFrame, best: DataFrame, seed: int = 42, mode: str = "explore", key: str = "event_id"
) -> DataFrame:
    """Serve the best decision or draw one of the others.

    ``best`` has ``group_id, best, others, epsilon``. ``explore`` draws another
    decision when the percent draw is under epsilon and leaves NULL where the group
    has none; ``exploit`` does so when it is over epsilon, and falls back to the
    session's candidates.
    """
    joined = lookup_join(sessions, best.select("group_id", "best", "others", "epsilon"), ["group_id"], "left")
    percent = keyed_draw(F.col(key), PERCENT_DRAWS, "explore", seed)
    bar = F.col("epsilon") * 100
    tests = {"explore": percent < bar, "exploit": percent > bar}
    other = (F.size("others") > 0) & tests[mode]
    decision = F.when(other, _drawn("others", key, "pick", seed)).otherwise(F.col("best"))
    if mode == "exploit":
        decision = _candidate_or_drawn(decision, key, seed)
    return joined.withColumn("decision", decision).drop("best", "others", "epsilon")


def weight_steps(weights: DataFrame) -> DataFrame:
    """Per group the decisions in order with their running percent."""
    running = Window.partitionBy("group_id").orderBy("ord")
    percent = F.sum(F.col("p").cast("decimal(12,6)") * 100).over(running)
    return (
        weights.withColumn("upto", percent)
        .groupBy("group_id")
        .agg(F.array_sort(F.collect_list(F.struct("ord", "upto", "decision"))).alias("steps"))
    )


def assign_weighted(
    sessions: DataFrame,
    weights: DataFrame,
    seed: int = 42,
    key: str = "event_id",
    stored: DataFrame | None = None,
) -> DataFrame:
    """Draw by weights: the first decision whose running percent reaches the draw, or the last one.

    Sessions with ``matched`` false take their group's decision from ``stored``
    (``group_id, default_decision``) instead; without that table they get NULL.
    The candidates play no part here.
    """
    joined = lookup_join(sessions, weight_steps(weights), ["group_id"], "left")
    draw = keyed_draw(F.col(key), PERCENT_DRAWS, "weight", seed)
    reached = F.filter("steps", lambda x: x["upto"] >= draw)
    drawn = F.coalesce(F.get(reached, F.lit(0))["decision"], F.try_element_at("steps", F.lit(-1))["decision"])
    if stored is None:
        default = F.lit(None).cast("string")
    else:
        joined = lookup_join(joined, stored.select("group_id", "default_decision"), ["group_id"], "left")
        default = F.col("default_decision")
    matched = F.col("matched") if "matched" in sessions.columns else F.lit(True)
    result = joined.withColumn("decision", F.when(matched, drawn).otherwise(default))
    return result.drop("steps", "default_decision")


def round_robin(df: DataFrame, n: int, order_by: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Front end of each session: its place in the trace modulo the number of front ends."""
    placed = with_ordinal(df, order_by)
    return placed.withColumn("frontend", ((F.col("ordinal") - 1) % n).cast("int"))
