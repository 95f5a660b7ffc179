"""Queries of state, windows and selection."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import selection, state, windows
from ..functions.ticks import tick_of
from ..session import materialize
from . import inputs as I
from . import oracle_parts as P
from .catalog import query
from .decision_loop import reset_messages, ucb_decisions

DIGITS = 4
WINDOW, SLIDE = I.DAY, 2 * I.HOUR


def _rounded(df, *keys):
    return df.select(*keys, F.round("s", DIGITS).alias("s"), F.round("n", DIGITS).alias("n"))


@query(
    "bucket_sums",
    f"""WITH {P.UPDATES} SELECT group_id, decision, day AS b, CAST(sum(-cost) AS DOUBLE) AS s,
        CAST(count(*) AS DOUBLE) AS n FROM u GROUP BY ALL""",
)
def bucket_sums(spark, sf):
    return state.bucket_sums(I.updates(spark, sf), I.DAY)


@query(
    "bucket_sums_items",
    """SELECT CAST(l_suppkey AS VARCHAR) AS group_id, l_returnflag AS decision,
              epoch_us(l_shipdate) // 2592000000000 AS b, CAST(sum(-CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) AS s,
              CAST(count(*) AS DOUBLE) AS n FROM lineitem GROUP BY ALL""",
)
def bucket_sums_items(spark, sf):
    return state.bucket_sums(I.item_updates(spark, sf), 30 * I.DAY)


@query(
    "discounted_latest",
    f"WITH {P.LATEST} SELECT group_id, decision, b, round(s, {DIGITS}) AS s, round(n, {DIGITS}) AS n FROM st",
)
def discounted_latest(spark, sf):
    rows = I.updates(spark, sf).select(
        "group_id", "decision", tick_of("ts", I.DAY).alias("b"), F.col("reward").cast("double").alias("s"), F.lit(1.0).alias("n")
    )
    return _rounded(state.discounted_latest(rows, I.GAMMA), "group_id", "decision", "b")


@query(
    "discounted_history",
    f"""WITH {P.UPDATES},
    sums AS (SELECT group_id, decision, hour AS b, CAST(sum(-cost) AS DOUBLE) AS s, count(*) AS n FROM u GROUP BY ALL),
    starts AS (SELECT group_id, decision, min(b) AS lo FROM sums GROUP BY ALL),
    spine AS (SELECT group_id, decision, unnest(range(lo, (SELECT max(b) + 1 FROM sums))) AS b FROM starts)
    SELECT p.group_id, p.decision, p.b, round(sum(x.s * pow({P.G}, p.b - x.b)), {DIGITS}) AS s,
           round(sum(x.n * pow({P.G}, p.b - x.b)), {DIGITS}) AS n
    FROM spine p JOIN sums x ON x.group_id = p.group_id AND x.decision = p.decision AND x.b <= p.b GROUP BY ALL""",
)
def discounted_history(spark, sf):
    sums = state.bucket_sums(I.updates(spark, sf), I.HOUR)
    return _rounded(state.discounted_history(sums, I.GAMMA, chunk_cap=64), "group_id", "decision", "b")


RESET = f"""
{P.UPDATES},
o AS (SELECT min(day) AS lo, max(day) AS hi FROM u),
sums AS (SELECT group_id, decision, day AS b, (day - lo) // 15 AS epoch, CAST(sum(-cost) AS DOUBLE) AS s, count(*) AS n
         FROM u, o GROUP BY ALL),
starts AS (SELECT group_id, decision, epoch, min(b) AS first_b FROM sums GROUP BY ALL),
spine AS (SELECT group_id, decision, epoch, unnest(range(first_b, least(hi, lo + (epoch + 1) * 15 - 1) + 1)) AS b
          FROM starts, o),
st AS (SELECT p.group_id, p.decision, p.epoch, p.b - (SELECT lo FROM o) + 1 AS k, p.b,
              sum(x.s * pow({P.G}, p.b - x.b)) AS s, sum(x.n * pow({P.G}, p.b - x.b)) AS n
       FROM spine p JOIN sums x ON x.group_id = p.group_id AND x.decision = p.decision AND x.epoch = p.epoch
                                AND x.b <= p.b GROUP BY ALL)
"""


@query(
    "discounted_reset",
    f"""WITH {RESET} SELECT group_id, decision, epoch, k, b, round(s, {DIGITS}) AS s, round(n, {DIGITS}) AS n,
        k % 15 = 0 AS reset FROM st""",
)
def discounted_reset(spark, sf):
    sums = state.bucket_sums(I.updates(spark, sf), I.DAY)
    series = state.discounted_reset(sums, I.GAMMA)
    return series.select(
        "group_id", "decision", "epoch", "k", "b", F.round("s", DIGITS).alias("s"), F.round("n", DIGITS).alias("n"), "reset"
    )


@query(
    "reset_decisions",
    f"""WITH RECURSIVE {RESET}, {P.rounds('st', 'group_id, b, k', 4)}
    SELECT b, group_id || ';' || CASE WHEN k % 15 = 0 THEN 'random' ELSE array_to_string(picks, ':') || ':' END
           || ';From: edge' AS value FROM picked""",
)
def reset_decisions(spark, sf):
    """Messages of the resetting form: picks, and the word for a free draw on reset ticks."""
    sums = state.bucket_sums(I.updates(spark, sf), I.DAY)
    return reset_messages(state.discounted_reset(sums, I.GAMMA), I.GAMMA, 4, "edge")


WINDOWS = f"""
{P.UPDATES},
panes AS (SELECT group_id, decision, {P.tick(SLIDE)} AS p, sum(-cost) AS s, count(*) AS n FROM u GROUP BY ALL),
win AS (SELECT group_id, decision, (p + j) * {SLIDE} AS w_end, CAST(sum(s) AS DOUBLE) AS s, CAST(sum(n) AS DOUBLE) AS n
        FROM panes, range(1, {WINDOW // SLIDE} + 1) r(j) GROUP BY ALL)
"""


@query("window_scores", f"WITH {WINDOWS} SELECT group_id, decision, w_end, round(s, 2) AS s, n FROM win")
def window_scores(spark, sf):
    scores = windows.window_scores(I.updates(spark, sf), WINDOW, SLIDE)
    return scores.select("group_id", "decision", F.unix_seconds("w_end").alias("w_end"), F.round("s", 2).alias("s"), "n")


@query(
    "best_by_mean",
    f"""WITH {WINDOWS}, ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id, w_end
              ORDER BY round(s, 2) / n DESC, decision) AS place FROM win)
    SELECT group_id, w_end, max(CASE WHEN place = 1 THEN decision END) AS best,
           coalesce(string_agg(decision, ':' ORDER BY decision) FILTER (WHERE place > 1), '') AS others
    FROM ranked GROUP BY ALL""",
)
def best_by_mean(spark, sf):
    scores = windows.window_scores(I.updates(spark, sf), WINDOW, SLIDE).withColumn("s", F.round("s", 2))
    best = selection.best_by_mean(scores)
    return best.select("group_id", F.unix_seconds("w_end").alias("w_end"), "best", F.array_join("others", ":").alias("others"))


@query(
    "state_merge",
    f"WITH {P.LATEST} SELECT group_id, decision, round(s, {DIGITS}) AS s, round(n, {DIGITS}) AS n FROM st",
)
def state_merge(spark, sf):
    """The newest tick merged into the state of the tick before."""
    sums = materialize(state.bucket_sums(I.updates(spark, sf), I.DAY), "sums")
    last = sums.select(F.max("b")).scalar()
    old = state.discounted_latest(sums, I.GAMMA, last - 1)
    new = sums.filter(F.col("b") == last)
    return _rounded(state.merge_state(old, new, I.GAMMA), "group_id", "decision")


@query(
    "ucb_picks",
    f"WITH RECURSIVE {P.PICKED} SELECT group_id, array_to_string(picks, ':') AS picks FROM picked",
)
def ucb_picks(spark, sf):
    picks = ucb_decisions(I.messages(spark, sf), I.GAMMA, I.PICKS, I.DAY, I.COST)
    return picks.select("group_id", F.array_join("picks", ":").alias("picks"))


ITEM_STATE = f"""
v AS (SELECT CAST(l_suppkey AS VARCHAR) AS group_id, l_returnflag AS decision,
             epoch_us(l_shipdate) // 2592000000000 AS b, CAST(-l_extendedprice AS DOUBLE) AS s FROM lineitem),
st AS (SELECT group_id, decision, sum(s * pow({P.G}, t - b)) AS s, sum(pow({P.G}, t - b)) AS n
       FROM v, (SELECT max(b) AS t FROM v) GROUP BY ALL)
"""


@query(
    "ucb_picks_items",
    f"WITH RECURSIVE {ITEM_STATE}, {P.rounds('st', 'group_id', I.PICKS)} SELECT group_id, array_to_string(picks, ':') AS picks FROM picked",
)
def ucb_picks_items(spark, sf):
    rows = I.item_updates(spark, sf).select(
        "group_id", "decision", tick_of("ts", 30 * I.DAY).alias("b"), F.col("reward").cast("double").alias("s"), F.lit(1.0).alias("n")
    )
    picks = selection.ucb_picks(state.discounted_latest(rows, I.GAMMA), I.GAMMA, I.PICKS)
    return picks.select("group_id", F.array_join("picks", ":").alias("picks"))


@query(
    "ucb_pick_shares",
    f"""WITH RECURSIVE {P.PICKED} SELECT group_id, d AS decision, count(*) AS picked,
        count(*) / {float(I.PICKS)} AS share FROM (SELECT group_id, unnest(picks) AS d FROM picked) GROUP BY ALL""",
)
def ucb_pick_shares(spark, sf):
    return selection.pick_shares(ucb_decisions(I.messages(spark, sf), I.GAMMA, I.PICKS, I.DAY, I.COST))
