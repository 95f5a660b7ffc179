"""Starting streams."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..session import SETTINGS
from ..sources.store import LatestStore

STORE = "spark.sql.streaming.stateStore.providerClass"


def each_batch(
    df: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    trigger: dict | None = None,
) -> StreamingQuery:
    """Hand every micro-batch to ``write``. The default trigger is the two-second tick.

    The stream keeps its state in RocksDB, as timers need it; the setting of the session is left as it was.
    """
    conf = df.sparkSession.conf
    before = conf.get(STORE, None)
    conf.set(STORE, SETTINGS[STORE])
    try:
        return (
            df.writeStream.foreachBatch(write)
            .outputMode(mode)
            .option("checkpointLocation", checkpoint)
            .trigger(**(trigger or {"processingTime": "2 seconds"}))
            .start()
        )
    finally:
        conf.unset(STORE) if before is None else conf.set(STORE, before)


def run_available(
    df: DataFrame, write: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Process what the sources hold now, then return."""
    each_batch(df, write, checkpoint, mode, {"availableNow": True}).awaitTermination()


def keep_latest(store: LatestStore) -> Callable[[DataFrame, int], None]:
    """A batch writer for update-mode aggregates: their newest value per key."""
    return store.merge
