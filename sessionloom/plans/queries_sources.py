"""Queries that go through sources and sinks: written to the shared folder, then read back."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import sources
from ..operators import exchange, messages, selection, windows
from ..operators.updates import parse_updates, valid_updates
from ..session import fresh_path
from ..streaming.run import run_available
from . import inputs as I
from . import oracle_parts as P
from .catalog import ORACLES, query
from .queries_exchange import PUSHED, daily_picks
from .queries_ingest import DAY_BEST
from .queries_traces import moving_avg_60

COPIES = 600


def _by_decision(df):
    return df.groupBy("group_id", "decision").agg(
        F.count(F.lit(1)).alias("n"), F.sum("cost").cast("double").alias("cost")
    )


BY_DECISION = f"""SELECT {P.GROUP} AS group_id, event_type AS decision, count(*) AS n,
    CAST(sum({P.COST}) AS DOUBLE) AS cost FROM events GROUP BY ALL"""


@query("src_kafka", BY_DECISION)
def src_kafka(spark, sf):
    """A recorded message stream; the live form differs only in the format."""
    recorded, out, mark = (fresh_path(spark, label) for label in ("messages", "parsed", "mark"))
    I.messages(spark, sf).select("value", "ts").write.parquet(recorded)
    stream = sources.read_messages(spark, "parquet", recorded)
    parsed = valid_updates(parse_updates(stream, cost_type=I.COST))
    run_available(parsed, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), mark)
    return _by_decision(spark.read.parquet(out))


@query(
    "src_update_log",
    f"SELECT {P.GROUP} AS group_id, {P.RECORD} AS update, count(*) AS n FROM events GROUP BY ALL",
)
def src_update_log(spark, sf):
    """Queue files taken up as a stream."""
    queued, out, mark = (fresh_path(spark, label) for label in ("queue", "taken", "mark"))
    lines = F.to_json(F.struct("update", "group_id"))
    I.records(spark, sf).select(lines.alias("value")).write.text(queued)
    stream = sources.read_update_log(spark, queued, files_per_trigger=100)
    run_available(stream, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), mark)
    taken = spark.read.parquet(out).filter("ok")
    return taken.groupBy("group_id", "update").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_trace",
    f"""SELECT {P.GROUP} AS group_id, {P.TRACE_MS} // 60000 AS minute, count(*) AS n,
        CAST(sum({P.trace_cost(4)}) AS DOUBLE) AS view_cost FROM events GROUP BY ALL""",
)
def src_trace(spark, sf):
    path = fresh_path(spark, "trace")
    I.trace_lines(spark, sf).select("value").write.text(path)
    parsed = sources.read_trace(spark, path, "decimal(18,3)").filter("ok")
    return parsed.groupBy(
        F.get("features", F.lit(4)).alias("group_id"),
        F.floor(F.unix_seconds("ts") / 60).cast("bigint").alias("minute"),
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(F.try_element_at("costs", F.lit("view"))).cast("double").alias("view_cost"))


@query(
    "src_response_logs",
    f"""WITH {P.LOG}, h AS (SELECT worker, count(*) AS sent, CAST(max(sent_us) - min(sent_us) AS DOUBLE) / 1000000 AS seconds
             FROM lg GROUP BY worker)
    SELECT worker, any_value(sent) AS sent, any_value(seconds) AS seconds, count(*) AS succeeded,
           CAST(sum(rt_us) AS DOUBLE) / 1000000 AS rt FROM h JOIN lr USING (worker) GROUP BY worker""",
)
def src_response_logs(spark, sf):
    path = fresh_path(spark, "logs")
    head = I.response_headers(spark, sf).select("worker", F.concat(
        F.lit("["), F.col("sent").cast("string"), F.lit(", "), F.col("seconds").cast("string"), F.lit(", 800]")).alias("value"))
    line = F.concat(F.lit("["), F.concat_ws(", ", *[F.col(c).cast("string") for c in ("id", "sent", "recv", "rt")]), F.lit(", 1]"))
    body = I.response_rows(spark, sf).select("worker", line.alias("value"))
    head.unionByName(body).write.partitionBy("worker").text(path)
    headers, rows = sources.read_response_logs(spark, path, r"worker=([^/]+)/")
    got = rows.groupBy("worker").agg(F.count(F.lit(1)).alias("succeeded"), F.sum("rt").cast("double").alias("rt"))
    return headers.join(got, "worker").select("worker", "sent", F.col("seconds").cast("double").alias("seconds"), "succeeded", "rt")


@query(
    "src_result_csv",
    f"""WITH {P.TRACE} SELECT CAST(line_no % 2 AS INTEGER) AS frontend, CASE WHEN answered THEN 'online' ELSE 'local' END AS mode,
        count(*) AS n, CAST(sum(CASE WHEN answered THEN cost ELSE {P.trace_cost(2)} END) AS DOUBLE) AS cost
        FROM tr WHERE valid OR NOT answered GROUP BY ALL""",
)
def src_result_csv(spark, sf):
    from ..operators.traces import cost_with_fallback

    path = fresh_path(spark, "results")
    rows = cost_with_fallback(I.trace(spark, sf)).select((F.col("line_no") % 2).cast("string").alias("f"), "mode", "cost")
    rows.select(F.concat_ws(",", "f", "mode", F.col("cost").cast("string")).alias("value")).write.text(path)
    back = sources.read_results(spark, path)
    return back.groupBy("frontend", "mode").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col("cost").cast("decimal(18,3)")).cast("double").alias("cost")
    )


@query(
    "src_history_preload",
    f"""WITH x AS (SELECT user_id, event_type, value FROM events UNION ALL
        SELECT user_id, event_type, value FROM (SELECT * FROM events ORDER BY event_id LIMIT 1), range(0, {COPIES}))
    SELECT {P.GROUP} AS group_id, event_type AS decision, count(*) AS n, CAST(sum({P.COST}) AS DOUBLE) AS cost FROM x GROUP BY ALL""",
)
def src_history_preload(spark, sf):
    """Copies of the first record ahead of the messages."""
    live = I.messages(spark, sf)
    first = live.agg(F.min_by(F.struct("event_id", "value"), "event_id").alias("r")).select("r.*")
    loaded = sources.preload(live, first, COPIES, F.timestamp_seconds(F.lit(0)))
    return _by_decision(valid_updates(parse_updates(loaded, cost_type=I.COST)))


@query(
    "stream_union",
    f"""WITH x AS (SELECT user_id, event_type, value FROM events UNION ALL
        SELECT user_id, event_type, value FROM (SELECT * FROM events ORDER BY event_id LIMIT 1), range(0, {COPIES}))
    SELECT {P.GROUP} AS group_id, event_type AS decision, count(*) AS n, CAST(sum({P.COST}) AS DOUBLE) AS cost FROM x GROUP BY ALL""",
)
def stream_union(spark, sf):
    """The live stream and a history stream as one."""
    out, mark = fresh_path(spark, "union"), fresh_path(spark, "mark")
    live = I.events_stream(spark, sf).select(I.message().alias("value"), "ts")
    first = I.messages(spark, sf).agg(F.min_by("value", "event_id").alias("value"), F.min("ts").alias("ts"))
    both = sources.preload_stream(live, first, COPIES, F.col("ts"))
    parsed = valid_updates(parse_updates(both, cost_type=I.COST))
    run_available(parsed, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), mark)
    return _by_decision(spark.read.parquet(out))


@query(
    "snk_messages",
    f"""SELECT topic, count(*) AS n, count(DISTINCT value) AS kinds, CAST(sum(length(value)) AS BIGINT) AS chars FROM (
        SELECT 'upload' AS topic, {P.RECORD} AS value FROM events
        UNION ALL SELECT 'sample', feature || ';1' FROM (SELECT DISTINCT {P.GROUP} AS feature FROM events)) GROUP BY topic""",
)
def snk_messages(spark, sf):
    path = fresh_path(spark, "topics")
    copies = exchange.upload_copy(I.records(spark, sf), "update").select("topic", "value")
    groups = I.updates(spark, sf).select("group_id").distinct()
    samples = groups.select(F.lit("sample").alias("topic"), F.concat("group_id", F.lit(";1")).alias("value"))
    sources.write_messages(copies.unionByName(samples), "text", path)
    back = spark.read.text(path)
    return back.groupBy("topic").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("value").alias("kinds"), F.sum(F.length("value")).alias("chars")
    )


@query(
    "snk_multi_cluster",
    f"""SELECT 'frontend' || (user_id % 3) AS cluster_id, 'internal_groups' AS topic, {P.MESSAGE} AS value, count(*) AS n
        FROM events GROUP BY ALL""",
)
def snk_multi_cluster(spark, sf):
    root = fresh_path(spark, "clusters")
    sent = exchange.forward_updates(I.forwarded(spark, sf), I.cluster_table(spark))
    sources.write_by_cluster(sent, {c: {"path": f"{root}/cluster_id={c}"} for c in I.CLUSTER_LIST}, "text")
    return spark.read.text(root).groupBy("cluster_id", "topic", "value").agg(F.count(F.lit(1)).alias("n"))


@query(
    "snk_latest_decision",
    f"""WITH {DAY_BEST} SELECT group_id, arg_max(best, w_end) AS best, arg_max(array_to_string(others, ':'), w_end) AS others,
        0.3 AS epsilon, max(w_end) AS w_end FROM best GROUP BY group_id""",
)
def snk_latest_decision(spark, sf):
    """Decision messages stored in two rounds; each group keeps its newest."""
    path = fresh_path(spark, "latest")
    best = selection.best_by_mean(windows.window_scores(I.updates(spark, sf), I.DAY, I.DAY))
    sent = messages.format_best(best, I.EPSILON, "edge").withColumn("w_end", F.unix_seconds("w_end"))
    got = messages.parse_decisions(sent.select("w_end", "value"), "best").drop("origin")
    middle = sent.select(F.avg("w_end")).scalar()
    for version, part in enumerate([got.filter(F.col("w_end") <= middle), got.filter(F.col("w_end") > middle)]):
        sources.upsert_latest(part, path, ["group_id"], ["w_end"], version)
    latest = sources.LatestStore(spark, path, ["group_id"]).read()
    return latest.select("group_id", "best", F.array_join("others", ":").alias("others"), "epsilon", "w_end")


@query("snk_series", ORACLES["moving_avg_60"])
def snk_series(spark, sf):
    path = fresh_path(spark, "series")
    sources.write_series(moving_avg_60(spark, sf), path)
    return spark.read.option("sep", "\t").schema("i bigint, mean double").csv(path)


@query(
    "snk_picks_messages",
    f"""WITH {P.UPDATES}, s AS (SELECT group_id, max(day) OVER () - min(day) OVER (PARTITION BY group_id) + 1 AS n FROM u)
    SELECT group_id, max(n) AS n, max(n) * {PUSHED} AS picks FROM s GROUP BY group_id""",
)
def snk_picks_messages(spark, sf):
    """Daily pick messages by topic, read back and parsed."""
    path = fresh_path(spark, "picks")
    sent = messages.format_picks(daily_picks(spark, sf), "edge").withColumn("topic", F.lit("decision"))
    sources.write_messages(sent, "json", path)
    back = messages.parse_decisions(spark.read.schema("value string, topic string").json(path))
    return back.groupBy("group_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.size("picks")).alias("picks"))
