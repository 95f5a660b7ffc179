"""Session settings and the shared folder used to cut lineage."""

from __future__ import annotations

import gc
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass": (
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
    ),
}


PARTITION_BYTES = 128 * 1024 * 1024


def shuffle_partitions(data_bytes: int) -> int:
    """Shuffle partitions so that one holds about 128 MB when all of the data is shuffled."""
    return max(8, -(-data_bytes // PARTITION_BYTES))


def build_session(
    app: str = "sessionloom", master: str | None = None, data_bytes: int | None = None, **extra: str
) -> SparkSession:
    """A session with UTC time, adaptive execution and the RocksDB state store.

    ``master`` is for local runs; on a cluster leave it to the submit command.
    ``data_bytes`` is the size of the largest input: shuffles start with partitions
    for all of it, and adaptive execution merges those that turn out small.
    ``extra`` keys use ``__`` for ``.`` (``spark__driver__memory="8g"``).
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    sized = {} if data_bytes is None else {"spark.sql.shuffle.partitions": str(shuffle_partitions(data_bytes))}
    settings = {**SETTINGS, **sized, **{k.replace("__", "."): v for k, v in extra.items()}}
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """Folder every executor can reach, from ``spark.checkpoint.dir``.

    Only a local session without that setting gets a temporary folder of its own.
    """
    context = spark.sparkContext
    configured = spark.conf.get("spark.checkpoint.dir", None) or context.getCheckpointDir()
    if configured:
        return configured.rstrip("/")
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    context.setCheckpointDir(tempfile.mkdtemp(prefix="sessionloom-"))
    return context.getCheckpointDir().rstrip("/")


def run_dir(spark: SparkSession) -> str:
    """Folder of this run in the shared folder; it is removed when the driver's JVM ends."""
    context = spark.sparkContext
    path = f"{shared_dir(spark)}/sessionloom-{context.applicationId}"
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    system = hadoop.getFileSystem(context._jsc.hadoopConfiguration())
    if not system.exists(hadoop):
        system.mkdirs(hadoop)
        system.deleteOnExit(hadoop)
    return path


def fresh_path(spark: SparkSession, label: str) -> str:
    """A path in the folder of this run that nothing else uses."""
    return f"{run_dir(spark)}/{label}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Row placement (partition ids, sampled range bounds) is fixed by the written
    table, so later stages agree on it even when executors are lost. ``discard`` removes
    the table once nothing reads it; what is left goes with the folder of the run.
    """
    path = fresh_path(df.sparkSession, label)
    df.write.option("compression", "zstd").parquet(path)
    stored = df.sparkSession.read.schema(df.schema).parquet(path)
    stored.scratch_path = path
    return stored


def discard(*tables: DataFrame) -> None:
    """Remove tables that ``materialize`` wrote and that no later result reads."""
    for table in tables:
        context = table.sparkSession.sparkContext
        path = context._jvm.org.apache.hadoop.fs.Path(table.scratch_path)
        path.getFileSystem(context._jsc.hadoopConfiguration()).delete(path, True)


def release(spark: SparkSession) -> None:
    """Let Spark drop the shuffle files of finished steps; it does so when the driver collects its garbage.

    Spark's listener threads keep the plan of the last query in reach until the next one, so an empty one runs first.
    """
    spark.sql("SELECT 1").collect()
    gc.collect()
    spark.sparkContext._jvm.System.gc()
