"""Exact row numbers over a whole table without a single-task sort."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import materialize
from .lookup import fits_broadcast

SLOT_BITS = 33  # monotonically_increasing_id keeps the row's place in its partition in the low 33 bits


def with_ordinal(
    df: DataFrame,
    order_by: Sequence[str],
    within: Sequence[str] = (),
    name: str = "ordinal",
) -> DataFrame:
    """Number rows 1, 2, .. by ``order_by``, for each ``within`` group.

    ``order_by`` has to end in a unique column. Rows are range-partitioned on
    (within, order), so a hot group or a hot order value spreads over many
    partitions. The sorted partitions are written once; the number is the place in
    the partition plus the count of the group's rows in earlier partitions. The
    table of counts has one row for each (group, partition) pair that occurs.
    """
    keys = [*within, *order_by]
    spot = F.monotonically_increasing_id()
    placed = (
        df.repartitionByRange(*keys)
        .sortWithinPartitions(*keys)
        .withColumn("_spot", spot)
        .withColumn("_part", F.shiftright("_spot", SLOT_BITS))
        .withColumn("_slot", F.col("_spot").bitwiseAND(F.lit((1 << SLOT_BITS) - 1)))
        .drop("_spot")
    )
    stored = materialize(placed, "ordinal")
    counts = stored.groupBy(*within, "_part").agg(
        F.count(F.lit(1)).alias("_rows"), F.min("_slot").alias("_first")
    )
    earlier = (
        Window.partitionBy(*(within or [F.lit(0)]))
        .orderBy("_part")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    shifts = counts.select(
        *[F.col(key).alias(f"_w{i}") for i, key in enumerate(within)],
        F.col("_part").alias("_wpart"),
        (F.coalesce(F.sum("_rows").over(earlier), F.lit(0)) - F.col("_first") + 1).alias("_shift"),
    )
    match = stored["_part"] == shifts["_wpart"]
    for i, key in enumerate(within):
        match = match & stored[key].eqNullSafe(shifts[f"_w{i}"])
    # Without groups there is one row for each partition.
    side = F.broadcast(shifts) if not within or fits_broadcast(shifts) else shifts
    return stored.join(side, match).select(
        *df.columns, (F.col("_slot") + F.col("_shift")).cast("bigint").alias(name)
    )


PLACE = ("_part", "_slot")


def placed_rows(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """The rows stored once in the order of ``order_by``, with their partition and their place in it; for :func:`numbered_rows`.

    ``order_by`` has to end in a unique column. The rows are read twice, to find the bounds of the partitions and to deal them out, so what is
    dear to compute should be stored before.
    """
    spot = F.monotonically_increasing_id()
    placed = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by).withColumn("_spot", spot)
    part, slot = F.shiftright("_spot", SLOT_BITS), F.col("_spot").bitwiseAND(F.lit((1 << SLOT_BITS) - 1))
    return materialize(placed.select(*df.columns, part.alias("_part"), slot.alias("_slot")), "placed")


def numbered_rows(placed: DataFrame, name: str, within: Sequence[str] = (), dense: bool = False) -> DataFrame:
    """Number placed rows 1, 2, .. in their order, for each ``within`` group, in ``name``.

    Several numberings take one stored copy: each counts its groups in every partition, and a row's number is its place among its
    group in its partition plus the group's rows in earlier ones. A window holds one group in one partition. The table of counts has a
    row for each (group, partition) pair that occurs; it is looked up. ``dense`` says that no placed row was left out; without groups
    the place then is the number, and nothing is shuffled.
    """
    local = Window.partitionBy(*within, "_part").orderBy("_slot")
    earlier = Window.partitionBy(*(within or [F.lit(0)])).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*within, "_part").agg(F.count(F.lit(1)).alias("_rows"))
    shifts = counts.select(
        *[F.col(key).alias(f"_w{i}") for i, key in enumerate(within)],
        F.col("_part").alias("_wpart"), F.coalesce(F.sum("_rows").over(earlier), F.lit(0)).alias("_shift"),
    )
    match = F.col("_part") == F.col("_wpart")
    for i, key in enumerate(within):
        match = match & F.col(key).eqNullSafe(F.col(f"_w{i}"))
    # Without groups there is one row for each partition.
    side = F.broadcast(shifts) if not within or fits_broadcast(shifts) else shifts
    place = F.col("_slot") + 1 if dense and not within else F.row_number().over(local)
    rows = placed.withColumn("_local", place).join(side, match)
    number = (F.col("_local") + F.col("_shift")).cast("bigint")
    return rows.select(*placed.columns, number.alias(name))


def previous_value(
    df: DataFrame, value: str, name: str, ordinal: str = "ordinal", chunk: int = 1 << 16
) -> DataFrame:
    """The value of the row numbered one less, in ``name``; NULL on the first row.

    Rows are cut into runs of ``chunk`` ordinals. The last row of each run is
    copied to the next one, so each run is a bounded window of its own.
    """
    own = F.floor((F.col(ordinal) - 1) / chunk)
    last = F.col(ordinal) % chunk == 0
    homes = F.when(last, F.array(own, own + 1)).otherwise(F.array(own))
    placed = df.withColumn("_run", F.explode(homes))
    by_run = Window.partitionBy("_run").orderBy(ordinal)
    return (
        placed.withColumn(name, F.lag(value).over(by_run))
        .filter(F.col("_run") == own)
        .drop("_run")
    )


def row_total(df: DataFrame) -> Column:
    """Number of rows, as a scalar subquery."""
    return df.select(F.count(F.lit(1))).scalar()
