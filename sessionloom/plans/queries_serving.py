"""Queries of decisions for sessions."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import assignment, selection
from ..session import materialize
from . import inputs as I
from . import oracle_parts as P
from .catalog import query
from .decision_loop import ucb_decisions

PERCENT = {name: P.draw("event_id", 101, name) for name in ("explore", "weight")}
# The three weighted decisions, in order; they sum to less than one.
WEIGHTS = [(1, "view", "0.5"), (2, "click", "0.3"), (3, "purchase", "0.1")]


def group_best(spark, sf) -> DataFrame:
    """Best decision of each group over all its reports, with epsilon; stored, as sessions look it up."""
    scores = I.updates(spark, sf).groupBy("group_id", "decision").agg(
        F.sum("reward").cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n")
    )
    best = selection.best_by_mean(scores, ("group_id",)).withColumn("epsilon", F.lit(I.EPSILON))
    return materialize(best, "best")


@query(
    "assign_uniform",
    f"""WITH RECURSIVE {P.PICKED}, {P.SESSIONS},
    drawn AS (SELECT event_id, group_id, cands, picks[1 + {P.draw('event_id', 'len(picks)', 'pick')}] AS d
              FROM sess LEFT JOIN picked USING (group_id))
    SELECT event_id, group_id, CASE WHEN list_contains(cands, d) THEN d ELSE {P.FALLBACK} END AS decision FROM drawn""",
)
def assign_uniform(spark, sf):
    picks = materialize(ucb_decisions(I.messages(spark, sf), I.GAMMA, I.PICKS, I.DAY, I.COST), "picks")
    return assignment.assign_uniform(I.sessions(spark, sf), picks).select("event_id", "group_id", "decision")


OTHER = f"others[1 + {P.draw('event_id', 'len(others)', 'pick')}]"
BAR = f"{I.EPSILON} * 100"


@query(
    "assign_epsilon",
    f"""WITH {P.BEST}, {P.SESSIONS}
    SELECT event_id, CASE WHEN len(others) > 0 AND {PERCENT['explore']} < {BAR} THEN {OTHER} ELSE best END AS decision
    FROM sess LEFT JOIN best USING (group_id)""",
)
def assign_epsilon(spark, sf):
    served = assignment.assign_epsilon(I.sessions(spark, sf), group_best(spark, sf), mode="explore")
    return served.select("event_id", "decision")


@query(
    "assign_epsilon_exploit",
    f"""WITH {P.BEST}, {P.SESSIONS},
    drawn AS (SELECT event_id, cands, CASE WHEN len(others) > 0 AND {PERCENT['explore']} > {BAR} THEN {OTHER}
                     ELSE best END AS d FROM sess LEFT JOIN best USING (group_id))
    SELECT event_id, CASE WHEN list_contains(cands, d) THEN d ELSE {P.FALLBACK} END AS decision FROM drawn""",
)
def assign_epsilon_exploit(spark, sf):
    served = assignment.assign_epsilon(I.sessions(spark, sf), group_best(spark, sf), mode="exploit")
    return served.select("event_id", "decision")


@query(
    "assign_weighted",
    f"""WITH {P.BEST}, {P.SESSIONS}
    SELECT event_id, CASE WHEN NOT matched THEN best WHEN best IS NULL THEN NULL
        WHEN {PERCENT['weight']} <= 50 THEN 'view' WHEN {PERCENT['weight']} <= 80 THEN 'click' ELSE 'purchase' END AS decision
    FROM sess LEFT JOIN best USING (group_id)""",
)
def assign_weighted(spark, sf):
    best = group_best(spark, sf)
    rows = F.array(*[F.struct(F.lit(o).alias("ord"), F.lit(d).alias("decision"), F.lit(p).alias("p")) for o, d, p in WEIGHTS])
    weights = best.select("group_id", F.inline(rows))
    stored = best.select("group_id", F.col("best").alias("default_decision"))
    return assignment.assign_weighted(I.sessions(spark, sf), weights, stored=stored).select("event_id", "decision")


@query(
    "round_robin_frontend",
    "SELECT event_id AS line_no, CAST((row_number() OVER (ORDER BY event_id) - 1) % 2 AS INTEGER) AS frontend FROM events",
)
def round_robin_frontend(spark, sf):
    return assignment.round_robin(I.trace_lines(spark, sf).select("line_no"), 2).select("line_no", "frontend")
