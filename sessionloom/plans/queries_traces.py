"""Queries of traces and series."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import series, traces
from ..session import materialize
from . import inputs as I
from . import oracle_parts as P
from .catalog import query

POINT = "DECIMAL(18,6)"


def points(per_second):
    """Series values as decimals, so their sums are exact."""
    return per_second.withColumn("mean_cost", F.col("mean_cost").cast(POINT.lower()))


def served(spark, sf):
    """Parsed sessions with the decision they were served, its cost, and whether it was a candidate."""
    df = traces.chosen_cost(I.trace(spark, sf))
    return df.withColumn("valid", traces.is_candidate())


COSTS = " || ' ' || ".join(f"'{t}=' || CAST({P.trace_cost(i)} AS VARCHAR)" for i, t in enumerate(I.TYPES))


@query(
    "trace_parse",
    f"""SELECT event_id AS line_no, {P.TRACE_MS} // 1000 AS sec, array_to_string({P.features(P.TRACE_MS)}, '|') AS features,
        {COSTS} AS costs, 2 AS steps, 0.5 AS thr, 2.0 AS factor, true AS ok FROM events""",
)
def trace_parse(spark, sf):
    parsed = I.trace(spark, sf)
    listed = F.array_join(
        F.transform("candidates", lambda c: F.concat_ws("=", c, F.try_element_at("costs", c).cast("string"))), " "
    )
    loads = F.try_element_at("loads", F.lit("view"))
    return parsed.select(
        "line_no", F.unix_seconds("ts").alias("sec"), F.array_join("features", "|").alias("features"), listed.alias("costs"),
        F.size(loads).alias("steps"), loads[1]["thr"].alias("thr"), loads[1]["factor"].alias("factor"), "ok",
    )


@query("valid_choice", f"WITH {P.TRACE} SELECT line_no, decision FROM tr WHERE valid")
def valid_choice(spark, sf):
    return traces.valid_choice(I.trace(spark, sf)).select("line_no", "decision")


@query(
    "trace_sort",
    f"""WITH k AS (SELECT event_id AS line_no, event_type || {P.COST_TEXT} AS first FROM events)
    SELECT line_no, first, row_number() OVER (ORDER BY first, line_no) AS place FROM k""",
)
def trace_sort(spark, sf):
    """Lines in text order of their first field, with their place in it."""
    first = F.concat("event_type", F.col("value").cast(I.COST).cast("string"))
    lines = I.events(spark, sf).select(F.col("event_id").alias("line_no"), F.concat_ws("\t", first, "props").alias("value"))
    placed = traces.sort_trace(lines, place="place")
    return placed.select("line_no", F.get(F.split("value", "\t"), F.lit(0)).alias("first"), "place")


@query("minute_totals", f"WITH {P.TRACE} SELECT minute, count(*) AS total_sessions FROM tr GROUP BY minute")
def minute_totals(spark, sf):
    return traces.minute_totals(materialize(I.trace(spark, sf).select("ts"), "times"))


PER_SECOND = f"""
{P.TRACE},
ps AS (SELECT sec, CAST(sum(cost) AS DOUBLE) / count(*) FILTER (WHERE valid) AS mean_cost, count(*) AS sent,
              count(*) FILTER (WHERE valid) AS succeeded FROM tr GROUP BY sec HAVING count(*) FILTER (WHERE valid) > 0)
"""


@query("cost_per_second", f"WITH {PER_SECOND} SELECT * FROM ps")
def cost_per_second(spark, sf):
    return traces.cost_per_second(served(spark, sf))


@query(
    "cost_with_fallback",
    f"""WITH {P.TRACE} SELECT line_no, CASE WHEN answered THEN 'online' ELSE 'local' END AS mode,
        CASE WHEN answered THEN cost ELSE {P.trace_cost(2)} END AS cost FROM tr WHERE valid OR NOT answered""",
)
def cost_with_fallback(spark, sf):
    return traces.cost_with_fallback(I.trace(spark, sf)).select("line_no", "mode", "cost")


SHARE = f"""
{P.TRACE},
sh AS (SELECT line_no, minute, decision, row_number() OVER (PARTITION BY minute, decision ORDER BY line_no) AS running
       FROM tr WHERE valid),
ld AS (SELECT sh.*, total_sessions, CAST(running AS DOUBLE) / total_sessions AS load FROM sh
       JOIN (SELECT minute, count(*) AS total_sessions FROM tr GROUP BY minute) USING (minute))
"""


@query("load_share", f"WITH {SHARE} SELECT line_no, minute, decision, running, total_sessions, load FROM ld")
def load_share(spark, sf):
    parsed = I.trace(spark, sf).select("line_no", "ts", "candidates", "decision")
    shares = traces.load_share(parsed)
    return shares.select("line_no", "minute", "decision", "running", "total_sessions", "load")


@query(
    "load_cost_factor",
    f"""WITH {SHARE} SELECT line_no, 1.0 AS plain,
        CASE WHEN load > 0.5 THEN 2.0 WHEN load > 0.2 THEN 1.5 ELSE 1.0 END AS factor FROM ld""",
)
def load_cost_factor(spark, sf):
    parsed = I.trace(spark, sf).select("line_no", "ts", "candidates", "loads", "decision")
    shares = traces.load_share(parsed)
    plain = traces.load_cost_factor(shares).withColumnRenamed("factor", "plain")
    return traces.load_cost_factor(plain, enabled=True).select(
        "line_no", F.col("plain").cast("decimal(2,1)").alias("plain"), F.col("factor").cast("decimal(2,1)").alias("factor")
    )


@query(
    "moving_avg_60",
    f"""WITH {PER_SECOND},
    o AS (SELECT CAST(mean_cost AS {POINT}) AS v, row_number() OVER (ORDER BY sec) AS i FROM ps),
    m AS (SELECT i, CAST(sum(v) OVER (ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS DOUBLE) / 60 AS mean FROM o)
    SELECT i, mean FROM m WHERE i % 60 = 0""",
)
def moving_avg_60(spark, sf):
    return series.moving_avg(points(cost_per_second(spark, sf)), "mean_cost", ["sec"]).select("i", "mean")


@query(
    "moving_avg_overlap",
    f"""WITH {PER_SECOND},
    o AS (SELECT CAST(mean_cost AS {POINT}) AS v, row_number() OVER (ORDER BY sec) AS i FROM ps),
    m AS (SELECT i, CAST(sum(v) OVER (ORDER BY i ROWS BETWEEN 59 PRECEDING AND CURRENT ROW) AS DOUBLE) / 60 AS mean FROM o)
    SELECT i, mean FROM m WHERE i % 7 = 0 AND i >= 60""",
)
def moving_avg_overlap(spark, sf):
    """The same mean at every seventh row, so windows overlap."""
    return series.moving_avg(points(cost_per_second(spark, sf)), "mean_cost", ["sec"], every=7).select("i", "mean")


def failover(spark, sf):
    """Block means of the session results of two front ends."""
    priced = traces.cost_with_fallback(I.trace(spark, sf)).select("line_no", "mode", "cost")
    return series.failover_blocks(priced)


BLOCKS = f"""
{P.TRACE},
fo AS (SELECT line_no, CASE WHEN answered THEN cost ELSE {P.trace_cost(2)} END AS cost,
              (row_number() OVER (ORDER BY line_no) - 1) % 2 AS part FROM tr WHERE valid OR NOT answered),
nb AS (SELECT *, (row_number() OVER (PARTITION BY part ORDER BY line_no) - 1) // 100 AS block FROM fo),
bm AS (SELECT CAST(part AS INTEGER) AS part, block, CAST(sum(cost) AS DOUBLE) / 100 AS mean FROM nb GROUP BY ALL HAVING count(*) = 100)
"""


@query("block_means", f"WITH {BLOCKS} SELECT part, block, mean FROM bm")
def block_means(spark, sf):
    return failover(spark, sf).select("part", "block", "mean")


@query(
    "zip_series",
    f"""WITH {BLOCKS} SELECT a.block, a.mean AS first, b.mean AS second,
        (SELECT abs(count(*) FILTER (WHERE part = 0) - count(*) FILTER (WHERE part = 1)) FROM bm) AS gap
        FROM bm a JOIN bm b ON a.block = b.block WHERE a.part = 0 AND b.part = 1""",
)
def zip_series(spark, sf):
    return series.paired_blocks(failover(spark, sf)).select("block", "first", "second", "gap")


NAME_LIST = "[" + ", ".join(f"'{a}'" for a in I.ALGORITHMS) + "]"
COMPARED = ", ".join(f"max(mean) FILTER (WHERE algorithm = '{a}') AS {a}" for a in I.ALGORITHMS)


@query(
    "compare_algorithms",
    f"""WITH {P.TRACE},
    ps AS (SELECT group_id, {NAME_LIST}[1 + event_id % 6] AS algorithm, sec,
                  CAST(CAST(sum(cost) AS DOUBLE) / count(*) AS {POINT}) AS v FROM tr WHERE valid GROUP BY ALL),
    o AS (SELECT *, (row_number() OVER (PARTITION BY group_id, algorithm ORDER BY sec) - 1) // 60 AS blk FROM ps),
    m AS (SELECT group_id, algorithm, (blk + 1) * 60 AS i, CAST(sum(v) AS DOUBLE) / 60 AS mean FROM o
          GROUP BY group_id, algorithm, blk HAVING count(*) = 60)
    SELECT group_id, i, {COMPARED} FROM m GROUP BY group_id, i""",
)
def compare_algorithms(spark, sf):
    """Six policies side by side: cost per second, moving mean, one column each."""
    names = F.array(*map(F.lit, I.ALGORITHMS))
    rows = served(spark, sf).select(
        "ts", "cost", "valid", F.get("features", F.lit(4)).alias("group_id"),
        F.get(names, (F.col("line_no") % len(I.ALGORITHMS)).cast("int")).alias("algorithm"),
    )
    per_second = traces.cost_per_second(rows, ("group_id", "algorithm"))
    means = series.moving_avg(points(per_second), "mean_cost", ["sec"], ["group_id", "algorithm"])
    return series.compare(means, "algorithm", I.ALGORITHMS)
