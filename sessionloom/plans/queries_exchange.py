"""Queries of the exchange between clusters."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import exchange, selection, state
from ..session import materialize
from . import inputs as I
from . import oracle_parts as P
from .catalog import query

PUSHED = 3


def pairs(spark, sf):
    heard = exchange.parse_subscriptions(I.subscribe_messages(I.events(spark, sf)))
    return exchange.subscriptions(heard)


SUBS = f"""
subs AS (SELECT {P.GROUP} AS group_id, 'frontend' || (event_id % 3) AS cluster_id, min({P.tick(I.DAY)}) AS first_bucket
         FROM events WHERE event_type = 'signup' GROUP BY ALL)
"""


@query("subscribe_merge", f"WITH {SUBS} SELECT * FROM subs")
def subscribe_merge(spark, sf):
    return pairs(spark, sf)


@query(
    "subscriber_set",
    f"WITH {SUBS} SELECT group_id, string_agg(cluster_id, ',' ORDER BY cluster_id) AS clusters FROM subs GROUP BY ALL",
)
def subscriber_set(spark, sf):
    sets = exchange.subscriber_sets(pairs(spark, sf))
    return sets.select("group_id", F.array_join("clusters", ",").alias("clusters"))


DAILY = f"""
{P.UPDATES},
sums AS (SELECT group_id, decision, day AS b, CAST(sum(-cost) AS DOUBLE) AS s, count(*) AS n FROM u GROUP BY ALL),
starts AS (SELECT group_id, decision, min(b) AS lo FROM sums GROUP BY ALL),
spine AS (SELECT group_id, decision, unnest(range(lo, (SELECT max(b) + 1 FROM sums))) AS b FROM starts),
st AS (SELECT p.group_id, p.decision, p.b, sum(x.s * pow({P.G}, p.b - x.b)) AS s, sum(x.n * pow({P.G}, p.b - x.b)) AS n
       FROM spine p JOIN sums x ON x.group_id = p.group_id AND x.decision = p.decision AND x.b <= p.b GROUP BY ALL)
"""


def daily_picks(spark, sf):
    """Picks of every group on every day."""
    sums = state.bucket_sums(I.updates(spark, sf), I.DAY)
    history = state.discounted_history(sums, I.GAMMA)
    return selection.ucb_picks(history, I.GAMMA, PUSHED, keys=("group_id", "b"))


@query(
    "push_decisions",
    f"""WITH RECURSIVE {DAILY}, {P.rounds('st', 'group_id, b', PUSHED)}, {SUBS}
    SELECT group_id, b, cluster_id, array_to_string(picks, ':') AS picks, 'decision' AS topic
    FROM picked JOIN subs USING (group_id) WHERE first_bucket < b AND cluster_id <> '{I.SELF_CLUSTER}'""",
)
def push_decisions(spark, sf):
    known = materialize(pairs(spark, sf), "pairs")
    pushed = exchange.push_decisions(daily_picks(spark, sf), known, I.SELF_CLUSTER)
    return pushed.select("group_id", "b", "cluster_id", F.array_join("picks", ":").alias("picks"), "topic")


@query(
    "forward_updates",
    f"""SELECT event_id, 'frontend' || (user_id % 3) AS cluster_id, 'frontend' || (user_id % 3) || ':9092' AS brokers,
        'internal_groups' AS topic, {P.MESSAGE} AS value FROM events""",
)
def forward_updates(spark, sf):
    sent = exchange.forward_updates(I.forwarded(spark, sf), I.cluster_table(spark))
    return sent.select("event_id", "cluster_id", "brokers", "topic", "value")


@query(
    "forward_subscriptions",
    f"""SELECT {P.tick(I.DAY)} AS b, {P.GROUP} AS group_id, arg_min('frontend' || (user_id % 3), event_id) AS cluster_id,
        'subscribe' AS topic, {P.GROUP} || ';{I.SELF_CLUSTER}' AS value FROM events GROUP BY ALL""",
)
def forward_subscriptions(spark, sf):
    return exchange.forward_subscriptions(I.forwarded(spark, sf), I.SELF_CLUSTER, ("event_id",))


def _counts(where: str) -> str:
    return f"""WITH f AS (SELECT unnest({P.FEATURES}) AS feature, generate_subscripts({P.FEATURES}, 1) - 1 AS pos FROM events {where})
    SELECT CAST(pos AS INTEGER) AS pos, feature, count(*) AS n, pos || ';' || feature || ';' || count(*) AS value FROM f GROUP BY pos, feature"""


@query("feature_value_counts", _counts(f"WHERE {P.draw('event_id', 1 << 32, 'sample')} < 0.01 * 4294967296"))
def feature_value_counts(spark, sf):
    return exchange.feature_counts(I.records(spark, sf).withColumnRenamed("update", "value"))


@query("feature_value_counts_all", _counts(""))
def feature_value_counts_all(spark, sf):
    """The counts over every record."""
    return exchange.feature_counts(I.records(spark, sf).withColumnRenamed("update", "value"), fraction=1.0)


@query("upload_copy", f"SELECT event_id, 'upload' AS topic, {P.RECORD} AS value FROM events")
def upload_copy(spark, sf):
    return exchange.upload_copy(I.records(spark, sf), "update").select("event_id", "topic", "value")


@query(
    "cluster_heartbeat",
    f"""WITH e AS (SELECT 'frontend' || (user_id % 3) AS c, {P.tick(I.HOUR)} AS b FROM events),
    spine AS (SELECT 'frontend' || i AS cluster_id, b FROM range(0, 3) r(i),
              (SELECT unnest(range((SELECT min(b) FROM e), (SELECT max(b) + 1 FROM e))) AS b))
    SELECT cluster_id, spine.b, count(e.c) AS n, 'alive' AS topic, cluster_id AS value
    FROM spine LEFT JOIN e ON e.c = cluster_id AND e.b = spine.b GROUP BY cluster_id, spine.b""",
)
def cluster_heartbeat(spark, sf):
    seen = I.events(spark, sf).select("ts", I.cluster(F.col("user_id") % I.CLUSTERS).alias("cluster_id"))
    return exchange.heartbeat(seen, I.CLUSTER_LIST, I.HOUR)
