"""A table as a stream: files that come in the order in which their rows would have arrived."""

from __future__ import annotations

import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.draws import keyed_draw
from ..session import fresh_path
from ..sources.folders import Folder

STEP_MILLIS = 1_000


def replay(df: DataFrame, slices: int = 6, late_seconds: int = 0, key: str = "event_id") -> DataFrame:
    """The rows of ``df`` as a stream of about ``slices`` batches, each row up to ``late_seconds`` after its time ``ts``.

    How late a row is follows from a draw on ``key``. The rows are written once, by slice of arrival; the files of a slice get
    a later time than those of the slice before, which is the order a file stream reads them in.
    """
    spark = df.sparkSession
    lateness = keyed_draw(F.col(key), late_seconds + 1, "late") if late_seconds else F.lit(0)
    placed = df.withColumn("_arrival", F.unix_seconds("ts") + lateness)
    span = placed.agg(F.min("_arrival").alias("lo"), F.max("_arrival").alias("hi")).first()
    low, width = (0, 1) if span["lo"] is None else (span["lo"], span["hi"] - span["lo"] + 1)
    path = fresh_path(spark, "arrivals")
    slot = F.floor((F.col("_arrival") - low) * slices / width).cast("int")
    placed.withColumn("slice", slot).drop("_arrival").write.partitionBy("slice").parquet(path)
    folder, files = Folder(spark, path), 0
    names = sorted((n for n in folder.names() if n.startswith("slice=")), key=lambda n: int(n.split("=")[1]))
    start = int(time.time() * 1000) - STEP_MILLIS * (len(names) + 1)
    for nth, name in enumerate(names):
        for file in folder.names(name):
            where, fs = folder._hadoop(f"{name}/{file}")
            fs.setTimes(where, start + nth * STEP_MILLIS, -1)
            files += 1
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", max(1, -(-files // max(len(names), 1))))
    return stream.parquet(f"{path}/slice=*")
