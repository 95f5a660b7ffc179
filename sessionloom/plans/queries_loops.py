"""Running loops: a table replayed as a stream with late rows must end in, or pass through, what the batch plan gives."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions.ticks import tick_start
from ..operators import messages as wire
from ..operators import versions
from ..schemas import FIELD_SEPARATOR
from ..session import fresh_path, materialize
from ..sources import BatchOutputs, union_streams
from . import decision_loop as loop
from . import inputs as I
from . import oracle_parts as P
from .catalog import ORACLES, query
from .queries_exchange import DAILY, PUSHED, daily_picks
from .queries_ingest import BEST_BODY, MATCHED, ORIGIN
from .queries_state import RESET, SLIDE, WINDOW, WINDOWS
from .replay import replay

NOW = {"availableNow": True}
LATE = 2 * I.DAY
RESET_PICKS = 4


def _published(out):
    def publish(df, batch_id):
        df.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return publish


@query(
    "decision_stream",
    f"""WITH RECURSIVE {P.PICKED}
    SELECT group_id, group_id || ';' || array_to_string(picks, ':') || ':;From: {ORIGIN}' AS value FROM picked""",
)
def decision_stream(spark, sf):
    """Messages that arrive up to two days late; the picks published last."""
    state, out, mark = (fresh_path(spark, label) for label in ("state", "published", "mark"))
    messages = replay(I.messages(spark, sf), late_seconds=LATE)
    loop.decision_stream(
        messages, state, mark, _published(out), I.GAMMA, I.PICKS, I.DAY, ORIGIN, NOW, LATE, chunk_cap=3, cost_type=I.COST
    ).awaitTermination()
    sent = spark.read.parquet(out)
    last = sent.select(F.max("batch")).scalar()
    return sent.filter(F.col("batch") == last).select("group_id", "value")


@query(
    "reset_stream",
    f"""WITH RECURSIVE {RESET.replace('min(day) AS lo', f'{I.ORIGIN_DAY} AS lo')}, {P.rounds('st', 'group_id, b, k', RESET_PICKS)}
    SELECT b, group_id || ';' || CASE WHEN k % 15 = 0 THEN 'random' ELSE array_to_string(picks, ':') || ':' END
           || ';From: edge' AS value FROM picked
    WHERE (b + 1) * {I.DAY} <= (SELECT max(epoch_us(ts)) // 1000000 - {LATE} FROM events)""",
)
def reset_stream(spark, sf):
    """The messages of all ticks that have passed, from reports that arrive up to two days late."""
    out, mark = fresh_path(spark, "published"), fresh_path(spark, "mark")
    messages = replay(I.messages(spark, sf), late_seconds=LATE)
    loop.reset_stream(
        messages, mark, _published(out), I.GAMMA, RESET_PICKS, I.ORIGIN_DAY, I.DAY, origin="edge", trigger=NOW, delay_seconds=LATE, cost_type=I.COST
    ).awaitTermination()
    return spark.read.parquet(out).select("b", "value")


BY_USER = "CAST(user_id AS VARCHAR)"


@query(
    "epsilon_stream",
    f"""WITH {WINDOWS.replace(P.GROUP, BY_USER)},
    ranked AS (SELECT *, row_number() OVER (PARTITION BY group_id, w_end ORDER BY round(s, 2) / n DESC, decision) AS place FROM win),
    best AS (SELECT group_id, w_end, max(CASE WHEN place = 1 THEN decision END) AS best,
                    coalesce(list(decision ORDER BY decision) FILTER (WHERE place > 1), []) AS others FROM ranked GROUP BY ALL),
    closed AS (SELECT *, group_id || ';' || {BEST_BODY} || ';From: {ORIGIN}' AS value,
                      lead(w_end) OVER (PARTITION BY group_id ORDER BY w_end) AS next
               FROM best WHERE w_end <= (SELECT max(epoch_us(ts)) // 1000000 - {LATE} FROM events)),
    hi AS (SELECT max(w_end) AS hi FROM closed)
    SELECT group_id, unnest(range(w_end, coalesce(next, hi + {SLIDE}), {SLIDE})) AS tick, w_end, value FROM closed, hi""",
)
def epsilon_stream(spark, sf):
    """Decisions in force at every closed tick, one group per user, so that many fall silent."""
    state, out, mark = (fresh_path(spark, label) for label in ("state", "published", "mark"))
    update = F.concat_ws(FIELD_SEPARATOR, "event_type", F.col("value").cast(I.COST).cast("string"))
    reports = I.events(spark, sf).select(
        "event_id", "ts", F.to_json(F.struct(update.alias("update"), I.text(F.col("user_id")).alias("group_id"))).alias("value")
    )
    loop.epsilon_stream(
        replay(reports, late_seconds=LATE), state, mark, _published(out), I.EPSILON, WINDOW, SLIDE, ORIGIN, NOW, LATE, I.COST, digits=2
    ).awaitTermination()
    return spark.read.parquet(out).select("group_id", "tick", "w_end", "value")


SUBSCRIBERS = 30  # clusters that subscribe; of them those of the cluster list have brokers
OWNERS = 4
LISTED = ", ".join(f"'{c}'" for c in I.CLUSTER_LIST)


def _exchange_input(spark, sf):
    events = I.events(spark, sf)
    uploads = I.records(spark, sf).select(F.col("event_id").alias("key"), "ts", F.col("update").alias("value"))
    heard = F.concat_ws(";", I.group(), I.cluster(F.col("event_id") % SUBSCRIBERS))
    subscribed = events.select(F.col("event_id").alias("key"), "ts", heard.alias("value"))
    body = F.struct(
        F.concat_ws(FIELD_SEPARATOR, "event_type", F.col("value").cast(I.COST).cast("string")).alias("update"),
        I.group().alias("group_id"), I.cluster(F.col("user_id") % OWNERS).alias("cluster_id"),
    )
    forwards = events.select(F.col("event_id").alias("key"), "ts", F.to_json(body).alias("value"))
    picks = materialize(wire.format_picks(daily_picks(spark, sf), "edge").select("b", "value"), "daily")
    decisions = picks.select(F.col("b").alias("key"), tick_start("b", I.DAY).alias("ts"), "value")
    rows = streaming.exchange_input(upload=uploads, subscribe=subscribed, forward=forwards, decision=decisions)
    return replay(rows, key="key")


FORWARD = f"""('{{"update":"' || event_type || '\\t' || {P.COST_TEXT} || '","group_id":"' || {P.GROUP} || '","cluster_id":"frontend' || (user_id % {OWNERS}) || '"}}')"""


@query(
    "stream_exchange",
    f"""WITH RECURSIVE {DAILY}, {P.rounds('st', 'group_id, b', PUSHED)},
    subs AS (SELECT {P.GROUP} AS group_id, 'frontend' || (event_id % {SUBSCRIBERS}) AS cluster_id, min({P.tick(I.DAY)}) AS first_bucket
             FROM events GROUP BY ALL),
    f AS (SELECT unnest({P.FEATURES}) AS feature, generate_subscripts({P.FEATURES}, 1) - 1 AS pos FROM events),
    sent AS (
      SELECT 'push' AS output, cluster_id, 'decision' AS topic, group_id || ';' || array_to_string(picks, ':') || ':;From: edge' AS value
      FROM picked JOIN subs USING (group_id) WHERE first_bucket < b AND cluster_id <> '{I.SELF_CLUSTER}'
      UNION ALL SELECT 'forward', 'frontend' || (user_id % {OWNERS}), 'internal_groups', {FORWARD} FROM events
      UNION ALL SELECT 'subscribe', * FROM (SELECT DISTINCT 'frontend' || (user_id % {OWNERS}), 'subscribe', {P.GROUP} || ';{I.SELF_CLUSTER}' FROM events)
    ),
    placed AS (SELECT CASE WHEN cluster_id IN ({LISTED}) THEN output ELSE 'unlisted' END AS output, cluster_id, topic, value FROM sent)
    SELECT output, cluster_id, topic, value, count(*) AS n FROM placed GROUP BY ALL
    UNION ALL SELECT 'upload', 'backend', 'upload', {P.RECORD}, count(*) FROM events GROUP BY ALL
    UNION ALL SELECT 'sample', 'backend', 'sample', pos || ';' || feature, count(*) FROM f GROUP BY ALL
    UNION ALL SELECT 'alive', 'backend', 'alive', '{I.SELF_CLUSTER}', 1""",
)
def stream_exchange(spark, sf):
    """All outputs of the exchange over the month, by message; the counts of the batches are added up, repeated subscriptions and signs of life are one."""
    out, state, mark = (fresh_path(spark, label) for label in ("exchanged", "pairs", "mark"))
    streaming.exchange_stream(_exchange_input(spark, sf), out, state, mark, I.SELF_CLUSTER, I.CLUSTER_LIST, I.DAY, 1.0, trigger=NOW).awaitTermination()
    outputs = BatchOutputs(spark, out)
    columns = ("output", "cluster_id", "topic", "value")
    parts = []
    for name in ("push", "forward", "subscribe", "unlisted", "upload", "sample", "alive"):
        rows = outputs.read(name).withColumn("output", F.lit(name)).withColumn("n", F.lit(1).cast("bigint"))
        if name == "sample":
            cut = F.substring_index("value", ";", -1)
            rows = rows.withColumn("n", cut.cast("bigint")).withColumn("value", F.expr("substring(value, 1, length(value) - length(substring_index(value, ';', -1)) - 1)"))
        if name in ("subscribe", "alive"):
            rows = rows.drop("batch").distinct()
        if name == "unlisted":
            # Subscriptions among them repeat with the batches too.
            again = F.when(F.col("topic") == "subscribe", F.lit(-1)).otherwise(F.col("batch"))
            added = rows.groupBy(*columns, again.alias("batch")).agg(F.sum("n").alias("n"))
            rows = added.withColumn("n", F.when(F.col("topic") == "subscribe", F.lit(1)).otherwise(F.col("n")).cast("bigint"))
        parts.append(rows.select(*columns, "n"))
    return union_streams(*parts).groupBy(*columns).agg(F.sum("n").alias("n"))


LATER = I.HOUR


def _assignments(spark, sf):
    """Assignments that hold from an hour after their event on."""
    return I.assignments(spark, sf).join(I.events(spark, sf).select(F.col("event_id").alias("offset"), "ts"), "offset").select(
        "offset", "value", (F.col("ts") + F.expr(f"interval {LATER} seconds")).alias("at")
    )


AT = f"""
a AS (SELECT {P.GROUP} AS group_id, ts + INTERVAL {LATER} SECOND AS at, arg_max('frontend' || (user_id % 3), event_id) AS cluster_id
      FROM events GROUP BY ALL),
e AS (SELECT *, CAST(user_id % 9 AS VARCHAR) AS group_id FROM events),
routed AS (SELECT e.*, coalesce(a.cluster_id, '{I.SELF_CLUSTER}') AS c FROM e ASOF LEFT JOIN a ON e.group_id = a.group_id AND e.ts >= a.at)
"""


@query("assignment_at", f"WITH {AT} SELECT event_id, group_id, c AS cluster_id FROM routed")
def assignment_at(spark, sf):
    """The cluster each session's group was assigned to when it came."""
    sessions = I.sessions(spark, sf).select("event_id", "ts", "group_id")
    found = versions.cluster_at(sessions, _assignments(spark, sf), I.SELF_CLUSTER, "at")
    return found.select("event_id", "group_id", "cluster_id")


MIDDLE = I.ORIGIN_DAY * I.DAY + 12 * I.DAY
NEWER = {
    "Field": "5",
    "Table": [
        {"Key": "0", "Rule": {"GroupName": "city-zero"}},
        {"Key": "3", "Rule": {"Field": "9", "Table": [{"Key": "1", "Rule": {"GroupName": "three-one"}}]}},
    ],
}
RULE_SETS = [(I.ORIGIN_DAY * I.DAY + I.DAY, I.RULES), (MIDDLE, NEWER)]
AT_RULES = f"""SELECT event_id, coalesce(CASE WHEN epoch_us(ts) // 1000000 >= {MIDDLE} THEN
        CASE WHEN user_id % 5 = 3 AND event_id % 3 = 1 THEN 'three-one' WHEN user_id % 5 = 0 THEN 'city-zero' END
      WHEN epoch_us(ts) // 1000000 >= {RULE_SETS[0][0]} THEN {MATCHED} END, {P.GROUP}) AS group_id FROM events"""


@query("match_groups_at", AT_RULES)
def match_groups_at(spark, sf):
    """Groups by the rules of the day: none on the first, one set until the twelfth, another one after it."""
    base = I.sessions(spark, sf).drop("group_id")
    return versions.match_groups_at(base, RULE_SETS).select("event_id", "group_id")


@query("match_groups_at_large", AT_RULES)
def match_groups_at_large(spark, sf):
    """The same by joins, as many rules take."""
    base = I.sessions(spark, sf).drop("group_id")
    return versions.match_groups_at(base, RULE_SETS, expression_paths=0).select("event_id", "group_id")


INGESTED = P.MESSAGE.replace(P.GROUP, "group_id")


@query(
    "stream_ingest",
    f"""WITH {AT}
    SELECT 'upload' AS topic, {P.RECORD} AS value, count(*) AS n FROM events GROUP BY ALL
    UNION ALL
    SELECT CASE WHEN c = '{I.SELF_CLUSTER}' THEN 'internal_groups' ELSE 'external_groups' END,
           substr({INGESTED}, 1, length({INGESTED}) - 1) || ',"cluster_id":"' || c || '"}}', count(*) FROM routed GROUP BY ALL""",
)
def stream_ingest(spark, sf):
    """Session records as they come, routed by the assignments of their time."""
    out, mark = fresh_path(spark, "ingested"), fresh_path(spark, "mark")
    known = materialize(_assignments(spark, sf), "assignments")
    rows = I.records(spark, sf).select("event_id", "ts", "update", I.text(F.col("user_id") % (I.GROUPS + 1)).alias("group_id"), F.lit(True).alias("ok"))
    streaming.ingest_stream(replay(rows, slices=4), lambda: known, out, mark, I.SELF_CLUSTER, "at", trigger=NOW).awaitTermination()
    outputs = BatchOutputs(spark, out)
    sent = union_streams(*[outputs.read(t).select("topic", "value") for t in ("upload", "internal_groups", "external_groups")])
    return sent.groupBy("topic", "value").agg(F.count(F.lit(1)).alias("n"))
