"""Session tables derived from the test tables: reports, requests, traces, response logs.

Every function reads whole tables. Costs are decimals, so sums are exact.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.draws import keyed_draw
from ..functions.ticks import tick_of, utc
from ..operators.traces import parse_trace
from ..schemas import DECISION_MARK, EVENTS, FIELD_SEPARATOR, LOAD_MARK

DAY, HOUR = 86_400, 3_600
ORIGIN_DAY = 19_723  # 2024-01-01, the first day of the test tables
COST = "decimal(18,2)"
GROUPS, CITIES, SYSTEMS, CLUSTERS, WORKERS = 8, 5, 3, 3, 16
SELF_CLUSTER = "frontend0"
CLUSTER_LIST = [f"frontend{i}" for i in range(CLUSTERS)]
TYPES = ["click", "error", "purchase", "signup", "view"]
ALGORITHMS = ["ucb", "eg", "akamai", "level3", "newucb", "c3"]
TRACE_SCALE = 60  # a minute of the table is a second of the trace
LOG_SCALE = 3_600  # an hour of the table is a second of the response log
LOADS = "0.2;1.5;0.5;2.0"
GAMMA = 0.987654321
PICKS = 10
EPSILON = 0.3
RULES = json.dumps(
    {
        "GroupingRules": {
            "Field": "4",
            "Table": [
                {"Key": "0", "Rule": {"GroupName": "east"}},
                {"Key": "1", "Rule": {"Field": "5", "Table": [
                    {"Key": "1", "Rule": {"GroupName": "one-one"}},
                    {"Key": "2", "Rule": {"GroupName": "one-two"}},
                ]}},
                {"Key": "2", "Rule": {"GroupName": "west"}},
                {"Key": "2", "Rule": {"Field": "5", "Table": [{"Key": "3", "Rule": {"GroupName": "west-three"}}]}},
                {"Key": "4", "Rule": {"Field": "9", "Table": [{"Key": "0", "Rule": {"GroupName": "os-zero"}}]}},
            ],
        }
    }
)


def events(spark: SparkSession, sf: str) -> DataFrame:
    df = spark.read.parquet(f"{sf}/events.parquet")
    return df.withColumn("ts", utc("ts"))


def events_stream(spark: SparkSession, sf: str) -> DataFrame:
    # A pattern, since a stream takes a folder or a pattern but no single file.
    df = spark.readStream.schema(EVENTS).parquet(f"{sf}/events*.parquet")
    return df.withColumn("ts", utc("ts"))


def text(column: Column) -> Column:
    return column.cast("string")


def group() -> Column:
    return text(F.col("user_id") % GROUPS)


def cluster(number: Column) -> Column:
    return F.concat(F.lit("frontend"), text(number))


def as_updates(df: DataFrame) -> DataFrame:
    cost = F.col("value").cast(COST)
    return df.select(
        "event_id", "ts", group().alias("group_id"), F.col("event_type").alias("decision"),
        cost.alias("cost"), (-cost).alias("reward"),
    )


def updates(spark: SparkSession, sf: str) -> DataFrame:
    return as_updates(events(spark, sf))


def item_updates(spark: SparkSession, sf: str) -> DataFrame:
    """A larger report table: groups are suppliers, decisions return flags."""
    df = spark.read.parquet(f"{sf}/lineitem.parquet").select("l_suppkey", "l_returnflag", "l_shipdate", "l_extendedprice")
    cost = F.col("l_extendedprice").cast(COST)
    return df.select(
        utc("l_shipdate").alias("ts"), text(F.col("l_suppkey")).alias("group_id"),
        F.col("l_returnflag").alias("decision"), cost.alias("cost"), (-cost).alias("reward"),
    )


def features(time: Column | None = None) -> Column:
    """The 15 feature values; group, city and system vary, the rest is fixed."""
    millis = F.unix_millis("ts") if time is None else time
    values = [
        text(millis), F.lit("0.1"), F.lit("1200"), F.lit("2.5"), group(), text(F.col("user_id") % CITIES),
        F.lit("us"), F.lit("wifi"), F.lit("ok"), text(F.col("event_id") % SYSTEMS), F.lit("vod"),
        F.lit("obj"), F.lit("html5"), F.lit("800"), F.lit("cdn"),
    ]
    return F.array(*values)


def candidates() -> Column:
    """All types but one."""
    left_out = keyed_draw(F.col("event_id"), len(TYPES), "candidates")
    return F.filter(F.array(*map(F.lit, TYPES)), lambda x, i: i != left_out)


def sessions(spark: SparkSession, sf: str) -> DataFrame:
    """Sessions to serve. Group 8 reports nothing, so it has no decisions."""
    return events(spark, sf).select(
        "event_id", "ts", text(F.col("user_id") % (GROUPS + 1)).alias("group_id"), features().alias("features"),
        candidates().alias("candidates"), (F.col("user_id") % CITIES != 4).alias("matched"),
    )


def records(spark: SparkSession, sf: str) -> DataFrame:
    """Full wire records with their group."""
    cost = text(F.col("value").cast(COST))
    record = F.concat_ws(FIELD_SEPARATOR, F.concat_ws(FIELD_SEPARATOR, features()), "event_type", cost)
    return events(spark, sf).select("event_id", "ts", "user_id", record.alias("update"), group().alias("group_id"))


def message() -> Column:
    update = F.concat_ws(FIELD_SEPARATOR, "event_type", text(F.col("value").cast(COST)))
    return F.to_json(F.struct(update.alias("update"), group().alias("group_id")))


def as_messages(df: DataFrame) -> DataFrame:
    return df.select("event_id", "ts", message().alias("value"))


def messages(spark: SparkSession, sf: str) -> DataFrame:
    """Reduced update messages, all well formed."""
    return as_messages(events(spark, sf))


def mixed_messages(spark: SparkSession, sf: str) -> DataFrame:
    """Update messages of which some are malformed, each in one of five ways."""
    way = keyed_draw(F.col("event_id"), 20, "malformed")
    cost = text(F.col("value").cast(COST))
    update = F.concat_ws(FIELD_SEPARATOR, "event_type", cost)
    good = F.to_json(F.struct(update.alias("update"), group().alias("group_id")))
    value = (
        F.when(way == 0, F.substring(good, 1, 20))
        .when(way == 1, F.to_json(F.struct(update.alias("update"))))
        .when(way == 2, F.to_json(F.struct(
            F.concat_ws(FIELD_SEPARATOR, "event_type", F.lit("n/a")).alias("update"), group().alias("group_id"))))
        .when(way == 3, F.to_json(F.struct(F.lit("").alias("update"), group().alias("group_id"))))
        .when(way == 4, F.to_json(F.struct(F.concat(update, F.lit("\t\t")).alias("update"), group().alias("group_id"))))
        .otherwise(F.concat(F.lit("  "), good, F.lit(" ")))
    )
    return events(spark, sf).select("event_id", "ts", value.alias("value"))


def assignments(spark: SparkSession, sf: str) -> DataFrame:
    """Group-to-cluster messages in event order."""
    entry = F.struct(group().alias("GroupName"), cluster(F.col("user_id") % CLUSTERS).alias("Cluster"))
    body = F.to_json(F.struct(F.array(entry).alias("GroupAssignment")))
    return events(spark, sf).select(F.col("event_id").alias("offset"), body.alias("value"))


def subscribe_messages(df: DataFrame) -> DataFrame:
    message = F.concat_ws(";", group(), cluster(F.col("event_id") % CLUSTERS))
    return df.filter(F.col("event_type") == "signup").select(message.alias("value"), tick_of("ts", DAY).alias("b"))


def forwarded(spark: SparkSession, sf: str) -> DataFrame:
    """External updates with the cluster that owns the group."""
    return events(spark, sf).select(
        "event_id", tick_of("ts", DAY).alias("b"), group().alias("group_id"),
        cluster(F.col("user_id") % CLUSTERS).alias("cluster_id"), message().alias("value"),
    )


def cluster_table(spark: SparkSession) -> DataFrame:
    """The configured clusters."""
    return spark.createDataFrame([(c, f"{c}:9092") for c in CLUSTER_LIST], "cluster_id string, brokers string")


def trace_lines(spark: SparkSession, sf: str) -> DataFrame:
    """Trace lines with their number, and who was served what."""
    millis = F.floor(F.unix_millis("ts") / TRACE_SCALE)
    cost = F.col("value").cast(COST)

    def priced(i: int, name: str) -> Column:
        tenths = (10 + (F.col("event_id") + i) % 5).cast("decimal(4,0)")
        return F.concat(F.lit(f"{name},"), text((cost * tenths / 10).cast("decimal(18,3)")))

    decisions = F.concat_ws(FIELD_SEPARATOR, *[priced(i, name) for i, name in enumerate(TYPES)])
    loads = F.lit(FIELD_SEPARATOR.join(f"{name},{LOADS}" for name in TYPES))
    line = F.concat_ws(
        FIELD_SEPARATOR, F.concat_ws(FIELD_SEPARATOR, features(millis)), F.lit(DECISION_MARK), decisions,
        F.lit(LOAD_MARK), loads,
    )
    served = F.when(keyed_draw(F.col("event_id"), 50, "served") == 0, "none").otherwise(F.col("event_type"))
    return events(spark, sf).select(
        F.col("event_id").alias("line_no"), line.alias("value"), served.alias("decision"),
        (keyed_draw(F.col("event_id"), 20, "answered") != 0).alias("answered"),
    )


def trace(spark: SparkSession, sf: str) -> DataFrame:
    """Parsed trace."""
    return parse_trace(trace_lines(spark, sf), cost_type="decimal(18,3)")


def response_rows(spark: SparkSession, sf: str) -> DataFrame:
    """Successful requests; times are microsecond-exact decimals."""
    sent = (F.floor(F.unix_micros("ts") / LOG_SCALE).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    rt = (F.col("value").cast(COST) / 1000).cast("decimal(18,6)")
    return events(spark, sf).filter(F.col("event_type") != "error").select(
        text(F.col("user_id") % WORKERS).alias("worker"), F.col("event_id").alias("id"), sent.alias("sent"),
        (sent + rt).cast("decimal(18,6)").alias("recv"), rt.alias("rt"), F.lit(True).alias("ok"),
    )


def response_headers(spark: SparkSession, sf: str) -> DataFrame:
    """One row per worker: all requests sent and the time it took."""
    sent = (F.floor(F.unix_micros("ts") / LOG_SCALE).cast("decimal(18,0)") / 1_000_000).cast("decimal(18,6)")
    return events(spark, sf).groupBy(text(F.col("user_id") % WORKERS).alias("worker")).agg(
        F.count(F.lit(1)).alias("sent"), (F.max(sent) - F.min(sent)).cast("decimal(18,6)").alias("seconds")
    )


def run_of(worker: str = "worker") -> Column:
    return (F.col(worker).cast("int") % 4).alias("run")
