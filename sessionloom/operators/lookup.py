"""Joining facts to a lookup table whose size is measured first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 * 1024 * 1024
ROW_OVERHEAD = 64


def fits_broadcast(table: DataFrame, limit_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the table's rows take no more than ``limit_bytes``, by one aggregation over it."""
    if table.isStreaming:
        return False
    text = F.octet_length(F.to_json(F.struct(*table.columns)))
    size = table.agg(F.coalesce(F.sum(text + F.lit(ROW_OVERHEAD)), F.lit(0)).alias("size")).first()["size"]
    return size <= limit_bytes


def lookup_join(
    facts: DataFrame,
    table: DataFrame,
    on: list[str],
    how: str = "left",
    limit_bytes: int = BROADCAST_BYTES,
    size: int | None = None,
) -> DataFrame:
    """Join ``facts`` with ``table`` on equal ``on`` columns.

    A table measured to be small is broadcast, so the facts are not shuffled and
    a hot key costs nothing. A larger one goes through a shuffle join, where
    adaptive execution splits the partitions of hot keys on the facts side. ``size``
    in bytes saves the measuring where it is known.
    """
    small = fits_broadcast(table, limit_bytes) if size is None else size <= limit_bytes
    side = F.broadcast(table) if small else table
    return facts.join(side, on=on, how=how)
