"""The front end's job: queued session records to routed messages, with the assignments that held at their time."""

from __future__ import annotations

from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.grouping import routed_messages
from ..operators.versions import cluster_at
from ..sources.folders import checkpoint_owner
from ..sources.outputs import BatchOutputs, Publisher
from .run import each_batch


def ingest_stream(
    records: DataFrame,
    assignments: Callable[[], DataFrame],
    out_path: str,
    checkpoint: str,
    self_cluster: str,
    at: str = "ts",
    time: str | Column = "ts",
    publishers: Mapping[str, Publisher] | None = None,
    trigger: dict | None = None,
) -> StreamingQuery:
    """Route a stream of ``update, group_id`` records (see ``read_update_log``) to the topics ``upload``, ``internal_groups`` and ``external_groups``.

    ``assignments`` gives the group-to-cluster messages known by now (``at``, ``offset``, ``value``) and is asked anew for every
    batch; a record goes by the one that held at its ``time``. Bad records go to the output ``rejected``. Each batch is published once (see ``BatchOutputs``).
    """
    spark = records.sparkSession
    kept: list[BatchOutputs] = []

    def serve(batch: DataFrame, batch_id: int) -> None:
        if not kept:
            kept.append(BatchOutputs(spark, out_path, checkpoint_owner(spark, checkpoint), publishers))
        rows = batch.persist()
        try:
            good = rows.filter("ok").drop("ok")
            placed = cluster_at(good, assignments(), self_cluster, at, time)
            sent = routed_messages(placed, self_cluster, columns=good.columns).select("topic", "value").persist()
            try:
                topics = {t: sent.filter(sent["topic"] == t) for t in ("upload", "internal_groups", "external_groups")}
                kept[0].publish(batch_id, {**topics, "rejected": rows.filter("NOT coalesce(ok, false)")})
            finally:
                sent.unpersist()
        finally:
            rows.unpersist()

    return each_batch(records, serve, checkpoint, "append", trigger)
