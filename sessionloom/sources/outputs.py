"""Several outputs of one stream, each published once for every batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Mapping

from pyspark.sql import DataFrame, SparkSession

from .folders import Folder

Publisher = Callable[[DataFrame, str, int], None]


class BatchOutputs:
    """Named outputs under ``path`` with a record of what each batch has published.

    An output writes its batch and is then marked; when all are, the batch is committed. A batch that is replayed, say after the driver
    was lost between two outputs, writes only those without a mark, and a folder that was left half written is written anew.
    ``publishers`` may send an output elsewhere (to a broker); such an output is sent twice only if the driver is
    lost between its sending and its mark. Readers see marked batches only.
    """

    def __init__(self, spark: SparkSession, path: str, owner: str | None = None, publishers: Mapping[str, Publisher] | None = None):
        self.spark, self.path, self.owner = spark, path.rstrip("/"), owner
        self.publishers = dict(publishers or {})
        self.folder = Folder(spark, path)

    def claim(self) -> None:
        """Note the writing stream on first use; raise if the folder is another's."""
        if not self.folder.exists("_owner"):
            self.folder.write("_owner", json.dumps(self.owner), replace=False)
        if (found := json.loads(self.folder.read("_owner"))) != self.owner:
            raise RuntimeError(f"{self.path} belongs to stream {found}, not to {self.owner}; use a fresh folder with a fresh checkpoint")

    def _mark(self, batch: int, name: str) -> str:
        return f"_marks/{name}/{batch:012d}"

    def publish(self, batch: int, outputs: Mapping[str, DataFrame]) -> list[str]:
        """Write the outputs of a batch that are not marked yet; gives their names."""
        self.claim()
        todo = [name for name in outputs if not self.folder.exists(self._mark(batch, name))]
        for name in todo:
            self.publishers.get(name, self._store)(outputs[name], name, batch)
            self.folder.write(self._mark(batch, name), "")
        self.folder.write(f"_commits/{batch:012d}", json.dumps(sorted(outputs)))
        return todo

    def _store(self, df: DataFrame, name: str, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch:012d}")

    def committed(self) -> list[int]:
        return [int(n) for n in self.folder.names("_commits") if n.isdigit()]

    def read(self, name: str) -> DataFrame | None:
        """All marked batches of an output, with their number in ``batch``; None before the first."""
        marked = [int(n) for n in self.folder.names(f"_marks/{name}") if n.isdigit()]
        if not marked:
            return None
        paths = [f"{self.path}/{name}/batch={b:012d}" for b in marked]
        return self.spark.read.option("basePath", f"{self.path}/{name}").parquet(*paths)
