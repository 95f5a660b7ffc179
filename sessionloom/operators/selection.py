"""Which decisions a group serves next."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..schemas import BANDIT_SCALE, RESET_DECISION, RESET_EVERY


def ucb_picks(
    state: DataFrame,
    gamma: float,
    k: int,
    scale: float = BANDIT_SCALE,
    keys: Sequence[str] = ("group_id",),
) -> DataFrame:
    """The next ``k`` decisions per group by discounted upper confidence bounds.

    A round scores every arm by its mean plus ``scale * sqrt(2 ln N) / sqrt(n)``
    (no bonus while N is at most 1, score 0 for an arm without pulls), takes the
    best, the smaller name on a tie, counts the pull and decays all pull counts.
    N starts as the sum of the whole parts of n and is not decayed. A group's arms
    are its distinct decisions; the rounds run as one fold over them.
    """
    arms = state.groupBy(*keys).agg(
        F.array_sort(
            F.collect_list(
                F.struct(
                    F.col("decision").alias("d"),
                    F.when(F.col("n") > 0, F.col("s") / F.nullif(F.col("n"), F.lit(0.0))).otherwise(F.lit(0.0)).alias("m"),
                    F.col("n").cast("double").alias("n"),
                )
            )
        ).alias("_arms"),
        F.sum(F.floor("n")).cast("double").alias("_total"),
    )
    bonus = f"IF(acc.total > 1D, {float(scale)}D * sqrt(2D * ln(acc.total)), 0D)"
    score = f"IF(x.n > 0D, x.m + {bonus} / sqrt(x.n), 0D)"
    best = f"array_max(transform(acc.arms, (x, i) -> struct({score} AS score, -i AS place, x.d AS d))).d"
    step = f"""
        transform(array({best}), p -> named_struct(
            'arms', transform(acc.arms, x -> named_struct(
                'd', x.d, 'm', x.m, 'n', (x.n + IF(x.d = p, 1D, 0D)) * {float(gamma)!r}D)),
            'total', acc.total + 1D,
            'picks', array_append(acc.picks, p)))[0]
    """
    start = "named_struct('arms', _arms, 'total', _total, 'picks', cast(array() as array<string>))"
    fold = f"aggregate(sequence(1, {int(k)}), {start}, (acc, r) -> {step}, acc -> acc.picks)"
    return arms.select(*keys, F.expr(fold).alias("picks"))


def reset_picks(
    state: DataFrame, gamma: float, k: int, every: int = RESET_EVERY, scale: float = BANDIT_SCALE
) -> DataFrame:
    """Picks per group and tick of a resetting state; the word for a free draw on reset ticks."""
    picks = ucb_picks(state, gamma, k, scale, keys=("group_id", "b", "k"))
    free = F.array(F.lit(RESET_DECISION))
    return picks.withColumn("picks", F.when(F.col("k") % every == 0, free).otherwise(F.col("picks")))


def pick_shares(picks: DataFrame, keys: Sequence[str] = ("group_id",)) -> DataFrame:
    """Serving share of each decision: its part of the pick list."""
    size = F.size("picks")
    return (
        picks.select(*keys, size.alias("_size"), F.explode("picks").alias("decision"))
        .groupBy(*keys, "decision")
        .agg(F.count(F.lit(1)).alias("picked"), F.max("_size").alias("_size"))
        .select(*keys, "decision", "picked", (F.col("picked") / F.col("_size")).alias("share"))
    )


def best_by_mean(scores: DataFrame, keys: Sequence[str] = ("group_id", "w_end")) -> DataFrame:
    """The decision with the best mean per group and window, and the sorted others.

    On a tie the smaller name is best.
    """
    mean = F.col("s") / F.col("n")
    ranked = scores.groupBy(*keys).agg(
        F.min_by("decision", F.struct((-mean).alias("m"), "decision")).alias("best"),
        F.collect_set("decision").alias("_all"),
    )
    others = F.array_sort(F.array_except("_all", F.array("best")))
    return ranked.select(*keys, "best", others.alias("others"))


def carry_forward(
    decisions: DataFrame, first: Column, last: Column, slide: int, key: str = "group_id", at: str = "w_end", name: str = "tick"
) -> DataFrame:
    """Decisions with the ticks they are in force at: from their own until the group's next one, silent ticks included.

    ``at`` and the ticks are epoch seconds; ticks lie ``slide`` apart, from ``first`` to ``last``. A group has at most one decision at a
    tick, so the window over a group holds ticks, not reports.
    """
    following = F.lead(at).over(Window.partitionBy(key).orderBy(at))
    begin = F.greatest(F.col(at), first)
    until = F.least(F.coalesce(F.col("_next") - slide, last), last)
    spans = decisions.withColumn("_next", following).filter(begin <= until)
    return spans.withColumn(name, F.explode(F.sequence(begin, until, F.lit(slide).cast("bigint")))).drop("_next")
