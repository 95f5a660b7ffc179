"""Decisions for a stream of sessions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from ..operators.assignment import assign_epsilon, assign_uniform

RULES = {"uniform": assign_uniform, "epsilon": assign_epsilon}


def stream_assign(
    latest: Callable[[], DataFrame], path: str, kind: str = "uniform", **options
) -> Callable[[DataFrame, int], None]:
    """A batch writer that serves each micro-batch of sessions with the latest decisions.

    ``latest`` is asked anew for every batch. A batch writes a folder of its own, so a
    replay overwrites and repeats nothing.
    """
    assign = RULES[kind]

    def serve(batch: DataFrame, batch_id: int) -> None:
        served = assign(batch, latest(), **options)
        served.write.mode("overwrite").parquet(f"{path}/batch={batch_id}")

    return serve
