"""Queries of parsing, formatting, grouping and routing."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import grouping, messages, traces, updates
from ..schemas import RECORD_LABELS, REDUCED_LABELS
from ..session import materialize
from . import inputs as I
from . import oracle_parts as P
from .catalog import query
from .decision_loop import latest_state
from ..operators.selection import best_by_mean, ucb_picks
from ..operators.windows import window_scores

ORIGIN = "broker-a:9092"
WAY = P.draw("event_id", 20, "malformed")


@query(
    "parse_updates",
    f"""SELECT event_id,
       CASE WHEN {WAY} IN (0, 1) THEN NULL ELSE {P.GROUP} END AS group_id,
       CASE WHEN {WAY} = 0 THEN NULL WHEN {WAY} = 3 THEN '' ELSE event_type END AS decision,
       CASE WHEN {WAY} IN (0, 2, 3) THEN NULL ELSE CAST(value AS DOUBLE) END AS cost,
       CASE WHEN {WAY} IN (0, 2, 3) THEN NULL ELSE CAST(-value AS DOUBLE) END AS reward,
       {WAY} NOT IN (0, 1, 2, 3) AS ok FROM events""",
)
def parse_updates(spark, sf):
    parsed = updates.parse_updates(I.mixed_messages(spark, sf))
    return parsed.select("event_id", "group_id", "decision", "cost", "reward", "ok")


@query("project_labels", f"SELECT event_id, {P.UPDATE} AS update FROM events")
def project_labels(spark, sf):
    cut = updates.project_labels(I.records(spark, sf), RECORD_LABELS, REDUCED_LABELS)
    return cut.select("event_id", "update")


@query(
    "build_update",
    f"""SELECT event_id, '{{"update":"' || replace({P.RECORD}, chr(9), '\\t') || '","group_id":"' || {P.GROUP} || '"}}'
        AS value FROM events""",
)
def build_update(spark, sf):
    return updates.build_update(I.records(spark, sf)).select("event_id", "value")


@query(
    "feedback_record",
    f"""WITH {P.TRACE}
    SELECT line_no, array_to_string({P.features('ms')}, chr(9)) || chr(9) || decision || chr(9) || CAST(cost AS VARCHAR) AS update,
           sec + 2 AS due
    FROM (SELECT tr.*, user_id, {P.TRACE_MS.replace('ts', 'e.ts')} AS ms FROM tr JOIN events e ON e.event_id = tr.line_no)
    WHERE valid""",
)
def feedback_record(spark, sf):
    served = traces.chosen_cost(traces.valid_choice(I.trace(spark, sf)))
    return updates.feedback(served).select("line_no", "update", F.unix_seconds("due").alias("due"))


@query(
    "format_picks",
    f"""WITH RECURSIVE {P.PICKED}
    SELECT group_id, group_id || ';' || array_to_string(picks, ':') || ':;From: {ORIGIN}' AS value FROM picked""",
)
def format_picks(spark, sf):
    state = latest_state(I.messages(spark, sf), I.GAMMA, I.DAY, I.COST)
    picks = ucb_picks(state, I.GAMMA, I.PICKS)
    return messages.format_picks(picks, ORIGIN).select("group_id", "value")


def _day_best(spark, sf):
    return best_by_mean(window_scores(I.updates(spark, sf), I.DAY, I.DAY))


DAY_BEST = f"""
{P.UPDATES},
totals AS (SELECT group_id, decision, day, CAST(sum(-cost) AS DOUBLE) / CAST(count(*) AS DOUBLE) AS m FROM u GROUP BY ALL),
ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id, day ORDER BY m DESC, decision) AS place FROM totals),
best AS (SELECT group_id, (day + 1) * {I.DAY} AS w_end, max(CASE WHEN place = 1 THEN decision END) AS best,
                coalesce(list(decision ORDER BY decision) FILTER (WHERE place > 1), []) AS others FROM ranked GROUP BY ALL)
"""
BEST_BODY = """'{"random":[' || array_to_string(list_transform(others, lambda x: '"' || x || '"'), ',')
    || '],"best":"' || best || '","epsilon":0.3}'"""


@query(
    "format_best",
    f"""WITH {DAY_BEST}
    SELECT group_id, w_end, group_id || ';' || {BEST_BODY} || ';From: {ORIGIN}' AS value FROM best""",
)
def format_best(spark, sf):
    formed = messages.format_best(_day_best(spark, sf), I.EPSILON, ORIGIN)
    return formed.select("group_id", F.unix_seconds("w_end").alias("w_end"), "value")


@query(
    "parse_decisions",
    f"""WITH RECURSIVE {P.PICKED}, {DAY_BEST.replace(P.UPDATES + ',', '')}
    SELECT 'picks' AS kind, group_id, CAST(NULL AS BIGINT) AS w_end, array_to_string(picks, ':') AS decisions,
           CAST(NULL AS VARCHAR) AS best, CAST(NULL AS DOUBLE) AS epsilon, '{ORIGIN}' AS origin FROM picked
    UNION ALL
    SELECT 'best', group_id, w_end, array_to_string(others, ':'), best, 0.3, '{ORIGIN}' FROM best""",
)
def parse_decisions(spark, sf):
    picks = messages.parse_decisions(format_picks(spark, sf).select("value"), "picks").select(
        F.lit("picks").alias("kind"), "group_id", F.lit(None).cast("bigint").alias("w_end"),
        F.array_join("picks", ":").alias("decisions"), F.lit(None).cast("string").alias("best"),
        F.lit(None).cast("double").alias("epsilon"), "origin",
    )
    best = messages.parse_decisions(format_best(spark, sf).select("w_end", "value"), "best").select(
        F.lit("best").alias("kind"), "group_id", "w_end", F.array_join("others", ":").alias("decisions"),
        "best", "epsilon", "origin",
    )
    return picks.unionByName(best)


ASSIGNED = f"""
latest AS (SELECT {P.GROUP} AS group_id, arg_max('frontend' || (user_id % 3), event_id) AS cluster_id
           FROM events GROUP BY ALL)
"""


@query(
    "assignment_latest",
    f"WITH {ASSIGNED} SELECT * FROM latest UNION ALL SELECT 'null', '{I.SELF_CLUSTER}'",
)
def assignment_latest(spark, sf):
    return grouping.latest_assignment(I.assignments(spark, sf), I.SELF_CLUSTER)


@query(
    "route_topic",
    f"""WITH {ASSIGNED},
    routed AS (SELECT e.*, coalesce(cluster_id, '{I.SELF_CLUSTER}') AS c FROM events e LEFT JOIN latest ON group_id = {P.GROUP})
    SELECT event_id, 'upload' AS topic, {P.RECORD} AS value FROM events
    UNION ALL
    SELECT event_id, CASE WHEN c = '{I.SELF_CLUSTER}' THEN 'internal_groups' ELSE 'external_groups' END,
           substr({P.MESSAGE}, 1, length({P.MESSAGE}) - 1) || ',"cluster_id":"' || c || '"}}' FROM routed""",
)
def route_topic(spark, sf):
    assigned = materialize(grouping.latest_assignment(I.assignments(spark, sf), I.SELF_CLUSTER), "assigned")
    routed = grouping.route_updates(I.records(spark, sf), assigned, I.SELF_CLUSTER)
    return routed.select("event_id", "topic", "value")


@query(
    "group_cluster_join",
    f"""WITH {ASSIGNED} SELECT event_id, coalesce(cluster_id, '{I.SELF_CLUSTER}') AS cluster_id
    FROM (SELECT event_id, CAST(user_id % 9 AS VARCHAR) AS group_id FROM events) LEFT JOIN latest USING (group_id)""",
)
def group_cluster_join(spark, sf):
    """Cluster of each session's group; the own one for a group without."""
    assigned = materialize(grouping.latest_assignment(I.assignments(spark, sf), I.SELF_CLUSTER), "assigned")
    return grouping.cluster_of(I.sessions(spark, sf), assigned, I.SELF_CLUSTER).select("event_id", "cluster_id")


@query(
    "parse_requests",
    f"""SELECT event_id, array_to_string({P.FEATURES}, '|') AS features, array_to_string({P.CANDIDATES}, '|') AS candidates
        FROM events""",
)
def parse_requests(spark, sf):
    record = F.concat_ws("\t", F.concat_ws("\t", "features"), F.concat_ws("\t", "candidates"))
    requests = traces.parse_requests(I.sessions(spark, sf).select("event_id", record.alias("value")))
    return requests.select(
        "event_id", F.array_join("features", "|").alias("features"), F.array_join("candidates", "|").alias("candidates")
    )


ASN, CITY, OS = "user_id % 8", "user_id % 5", "event_id % 3"
MATCHED = f"""CASE WHEN {ASN} = 4 AND {OS} = 0 THEN 'os-zero' WHEN {ASN} = 2 AND {CITY} = 3 THEN 'west-three'
    WHEN {ASN} = 2 THEN 'west' WHEN {ASN} = 1 AND {CITY} = 2 THEN 'one-two'
    WHEN {ASN} = 1 AND {CITY} = 1 THEN 'one-one' WHEN {ASN} = 0 THEN 'east' END"""
MATCH_SQL = f"SELECT event_id, coalesce({MATCHED}, {P.GROUP}) AS group_id FROM events"


@query("match_groups", MATCH_SQL)
def match_groups(spark, sf):
    base = I.sessions(spark, sf).drop("group_id")
    return grouping.match_groups(base, I.RULES).select("event_id", "group_id")


@query("match_groups_large", MATCH_SQL)
def match_groups_large(spark, sf):
    """The same rules by the join form that large rule sets take."""
    base = I.sessions(spark, sf).drop("group_id")
    return grouping.match_groups(base, I.RULES, expression_paths=0).select("event_id", "group_id")


@query(
    "default_group",
    f"""SELECT event_id, coalesce({MATCHED}, {P.GROUP}) AS asn, {P.GROUP} AS asn_only,
        coalesce({MATCHED}, 'null') AS "unmatched" FROM events""",
)
def default_group(spark, sf):
    df = I.sessions(spark, sf).drop("group_id")
    for name, mode in [("asn", "asn"), ("asn_only", "asn_only"), ("unmatched", "null")]:
        df = grouping.match_groups(df, I.RULES, mode).withColumnRenamed("group_id", name)
    return df.select("event_id", "asn", "asn_only", "unmatched")
