"""File sources: update logs, traces, response logs, results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import RESULT, UPDATE_JSON

WORKER_PATTERN = r"([^/]+)\.bm$"
LOG_NUMBERS = "array<decimal(18,6)>"  # log times carry microseconds, so sums of them are exact
HEADER_FIELDS, ROW_FIELDS = 3, 5


def read_update_log(
    spark: SparkSession,
    path: str,
    streaming: bool = True,
    files_per_trigger: int | None = None,
    archive: str | None = None,
) -> DataFrame:
    """Queued updates, one JSON object a line: ``update, group_id, ok``.

    As a stream, files are taken up once each; ``archive`` moves finished ones away.
    """
    reader = spark.readStream if streaming else spark.read
    if streaming and files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", files_per_trigger)
    if streaming and archive:
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    message = F.from_json("value", UPDATE_JSON)
    return (
        reader.text(path)
        .select(message.alias("_m"), F.col("_metadata.file_modification_time").alias("ts"))
        .select(
            F.col("_m.update").alias("update"),
            F.col("_m.group_id").alias("group_id"),
            "ts",
            (F.col("_m.update").isNotNull() & F.col("_m.group_id").isNotNull()).alias("ok"),
        )
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Text lines with ``line_no``, a value that orders them by file and place in it."""
    place = F.struct(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("row"),
    )
    return spark.read.text(path).select("value", place.alias("line_no"))


def read_trace(spark: SparkSession, path: str, cost_type: str = "double") -> DataFrame:
    """Parsed trace lines, in file order by ``line_no``."""
    from ..operators.traces import parse_trace

    return parse_trace(read_lines(spark, path), cost_type=cost_type)


def read_response_logs(
    spark: SparkSession, path: str, worker_pattern: str = WORKER_PATTERN
) -> tuple[DataFrame, DataFrame]:
    """Headers and rows of per-worker response logs.

    A file's header ``[sent, seconds, rate]`` and its rows ``[id, sent, received,
    response time, ok]`` differ in length. The worker comes from the file path.
    """
    lines = spark.read.text(path).select(
        F.regexp_extract("_metadata.file_path", worker_pattern, 1).alias("worker"),
        F.from_json("value", LOG_NUMBERS).alias("x"),
    )
    headers = lines.filter(F.size("x") == HEADER_FIELDS).select(
        "worker",
        F.col("x")[0].cast("bigint").alias("sent"),
        F.col("x")[1].alias("seconds"),
        F.col("x")[2].alias("rate"),
    )
    rows = lines.filter(F.size("x") == ROW_FIELDS).select(
        "worker",
        F.col("x")[0].cast("bigint").alias("id"),
        F.col("x")[1].alias("sent"),
        F.col("x")[2].alias("recv"),
        F.col("x")[3].alias("rt"),
        (F.col("x")[4] == 1).alias("ok"),
    )
    return headers, rows


def read_run_reports(spark: SparkSession, path: str) -> DataFrame:
    """Rate and mean request time of load-test reports, one file per run: ``run, rate, mean_rt``."""
    lines = spark.read.text(path).select(F.col("_metadata.file_path").alias("run"), "value")
    rate = F.regexp_extract("value", r"^Requests per second:\s+(\S+)", 1).try_cast("double")
    # Two lines begin alike; the plain mean is the one not taken "across" requests.
    time = F.when(
        ~F.col("value").contains("across"), F.regexp_extract("value", r"^Time per request:\s+(\S+)", 1)
    ).try_cast("double")
    return lines.groupBy("run").agg(F.max(rate).alias("rate"), F.max(time).alias("mean_rt"))


def read_results(spark: SparkSession, path: str) -> DataFrame:
    """Session results ``frontend,mode,cost``, in file order by ``line_no``."""
    parts = F.split(F.col("value"), ",")
    columns = [part.split() for part in RESULT.split(", ")]
    return read_lines(spark, path).select(
        "line_no",
        *[F.trim(F.get(parts, F.lit(i))).try_cast(kind).alias(name) for i, (name, kind) in enumerate(columns)],
    )
