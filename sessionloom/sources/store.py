"""A keyed table that a stream keeps up to date, batch by batch."""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .folders import Folder

KEPT_VERSIONS = 20
BUCKETS = 16


class LatestStore:
    """Latest row per key under ``path``, in buckets by a hash of the keys (or of ``bucket_by``, some of them).

    A micro-batch rewrites only the buckets that its keys fall in, as folders of its own version, and then commits the version with a
    small record. So what a batch writes follows the batch and not the table; a batch that is replayed starts from the versions
    before its own and gives the same table again; readers see committed versions only. The newest ``keep`` versions can
    still be read while later ones are written; of older ones what a later version replaced is removed.

    ``owner`` is the id of the stream that writes (see ``checkpoint_owner``). Batch numbers mean nothing to another
    stream, so a store refuses one: a fresh checkpoint needs a fresh store.
    """

    def __init__(
        self,
        spark: SparkSession,
        path: str,
        keys: Sequence[str],
        keep: int = KEPT_VERSIONS,
        buckets: int = BUCKETS,
        bucket_by: Sequence[str] | None = None,
        owner: str | None = None,
    ):
        self.spark, self.path, self.keys, self.keep = spark, path.rstrip("/"), list(keys), keep
        self.buckets, self.bucket_by, self.owner = buckets, list(bucket_by or keys), owner
        self.folder = Folder(spark, path)

    def claim(self, owner: str | None) -> None:
        """Note the writing stream on first use; raise if the store is another's, or has other buckets."""
        mine = {"owner": owner, "buckets": self.buckets}
        if not self.folder.exists("_owner"):
            self.folder.write("_owner", json.dumps(mine), replace=False)
        found = json.loads(self.folder.read("_owner"))
        if found != mine:
            raise RuntimeError(f"{self.path} belongs to {found}, not to {mine}; use a fresh folder with a fresh checkpoint")

    def versions(self) -> list[int]:
        """Committed versions that are kept."""
        return sorted(int(n) for n in self.folder.names("_commits") if n.isdigit())

    def note(self, before: int | None = None) -> dict:
        """What the newest version (older than ``before``) was committed with."""
        usable = [v for v in self.versions() if before is None or v < before]
        return json.loads(self.folder.read(f"_commits/{usable[-1]:012d}"))["note"] if usable else {}

    def _layout(self) -> dict[int, list[int]]:
        """Buckets of every kept folder of a committed version."""
        found = {}
        committed = set(self.versions())
        for name in self.folder.names():
            version = int(name.split("=")[1]) if name.startswith("version=") else -1
            if version in committed:
                found[version] = [int(b.split("=")[1]) for b in self.folder.names(name) if b.startswith("bucket=")]
        return found

    def read(self, before: int | None = None, only: Sequence[int] | None = None) -> DataFrame | None:
        """The newest version (older than ``before``), or None when there is none; ``only`` some buckets of it."""
        newest: dict[int, int] = {}
        for version, buckets in sorted(self._layout().items()):
            if before is None or version < before:
                newest |= {b: version for b in buckets}
        if not newest:
            return None
        paths = [f"{self.path}/version={v:012d}/bucket={b}" for b, v in sorted(newest.items()) if only is None or b in only]
        if not paths:
            return None
        return self.spark.read.parquet(*paths)

    def merge(
        self,
        rows: DataFrame,
        version: int,
        compact: Callable[[DataFrame], DataFrame] | None = None,
        order: Sequence[str] = (),
        note: dict | None = None,
    ) -> None:
        """Write ``version``: ``rows``, unique in the keys, over the rows of the version before.

        Of two rows of a key the one with the greater ``order`` stays, of equal ones the new one. ``compact`` may shrink the
        rows of the touched buckets before they are written; it must keep a row in its bucket.
        """
        self.claim(self.owner)
        columns = rows.columns
        bucket = F.pmod(F.xxhash64(*self.bucket_by), F.lit(self.buckets)).cast("int")
        placed = rows.persist()
        try:
            touched = sorted(r["b"] for r in placed.select(bucket.alias("b")).distinct().collect())
            if touched:
                old = self.read(before=version, only=touched)
                table = placed
                if old is not None:
                    ranked = placed.withColumn("_new", F.lit(1)).unionByName(old.withColumn("_new", F.lit(0)))
                    kept = [c for c in columns if c not in self.keys]
                    newest = F.max_by(F.struct(*kept), F.struct(*order, "_new")).alias("_row")
                    table = ranked.groupBy(*self.keys).agg(newest).select(*self.keys, "_row.*").select(*columns)
                if compact is not None:
                    table = compact(table).select(*columns)
                written = table.withColumn("bucket", bucket).repartition("bucket")
                written.write.mode("overwrite").partitionBy("bucket").parquet(f"{self.path}/version={version:012d}")
        finally:
            placed.unpersist()
        self.folder.write(f"_commits/{version:012d}", json.dumps({"buckets": touched, "note": note or {}}))
        self._prune(version)

    def _prune(self, version: int) -> None:
        old = [v for v in self.versions() if v < version][: -self.keep]
        if not old:
            return
        layout, later = self._layout(), set()
        for v in sorted(layout, reverse=True):
            if v <= old[-1]:
                gone = [b for b in layout[v] if b in later]
                for b in gone:
                    self.folder.remove(f"version={v:012d}/bucket={b}")
                if len(gone) == len(layout[v]):
                    self.folder.remove(f"version={v:012d}")
                    self.folder.remove(f"_commits/{v:012d}")
            later |= set(layout[v])
        for v in old:
            if v not in layout:
                self.folder.remove(f"_commits/{v:012d}")
