"""Small files and folder lists of a job's bookkeeping, in any file system Spark can reach."""

from __future__ import annotations

import json

from pyspark.sql import SparkSession


class Folder:
    """A folder by its path; names are relative to it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _hadoop(self, name: str = ""):
        where = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)
        return where, where.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def names(self, name: str = "") -> list[str]:
        """What lies in the folder, or one below it; nothing if there is none."""
        where, fs = self._hadoop(name)
        return sorted(s.getPath().getName() for s in fs.listStatus(where)) if fs.exists(where) else []

    def exists(self, name: str) -> bool:
        where, fs = self._hadoop(name)
        return fs.exists(where)

    def read(self, name: str) -> str:
        where, fs = self._hadoop(name)
        stream = fs.open(where)
        try:
            return bytes(stream.readAllBytes()).decode()
        finally:
            stream.close()

    def write(self, name: str, text: str, replace: bool = True) -> None:
        """A file that appears whole: written under another name, then renamed."""
        draft, fs = self._hadoop(f"{name}.draft")
        final, _ = self._hadoop(name)
        stream = fs.create(draft, True)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()
        if replace:
            fs.delete(final, False)
        if not fs.rename(draft, final):
            fs.delete(draft, False)

    def remove(self, name: str) -> None:
        where, fs = self._hadoop(name)
        fs.delete(where, True)


def checkpoint_owner(spark: SparkSession, checkpoint: str) -> str:
    """The id that Spark gives a stream with its checkpoint; a fresh checkpoint has another one."""
    return json.loads(Folder(spark, checkpoint).read("metadata").splitlines()[0])["id"]


def batch_watermark(spark: SparkSession, checkpoint: str, batch_id: int) -> int:
    """The watermark of a batch in milliseconds, as Spark noted it in the checkpoint before the batch began."""
    return json.loads(Folder(spark, checkpoint).read(f"offsets/{batch_id}").splitlines()[1])["batchWatermarkMs"]
