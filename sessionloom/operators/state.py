"""Scores of (group, decision): per tick, decayed, reset and merged."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ticks import tick_of
from ..schemas import RESET_EVERY
from ..session import materialize

KEYS = ("group_id", "decision")
SCALE_RANGE = 230.0  # in-chunk weights stay within exp(+-230), about 1e+-100
DECAY_RANGE = 745.0  # exp(-745) is the smallest positive double
CHUNK_CAP = 1 << 16


def bucket_sums(df: DataFrame, seconds: int, keys: Sequence[str] = KEYS, reward: str = "reward") -> DataFrame:
    """Sum ``s`` of rewards and count ``n`` per key and tick ``b``."""
    return df.groupBy(*keys, tick_of("ts", seconds).alias("b")).agg(
        F.sum(reward).cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n")
    )


def _as_column(rows: DataFrame, at: int | Column | None, pick) -> Column:
    if at is None:
        return rows.select(pick("b")).scalar()
    return at if isinstance(at, Column) else F.lit(at).cast("bigint")


def discounted_latest(
    rows: DataFrame, gamma: float, at: int | Column | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """State at tick ``at`` (default: the last one): older sums weigh ``gamma`` per tick of age.

    ``rows`` may be tick sums or single rewards (``s`` the reward, ``n`` 1): one
    weighted aggregation either way, so the shuffle carries one row per key and
    task. Where the last tick has to be found first, rows are summed to chunks of ticks and read once all the same.
    """
    if at is None:
        return chunk_state(materialize(tick_chunks(rows, gamma, keys), "chunks"), gamma, keys=keys)
    last = at if isinstance(at, Column) else F.lit(at).cast("bigint")
    weight = F.pow(F.lit(float(gamma)), (F.col("_at") - F.col("b")).cast("double"))
    return (
        rows.withColumn("_at", last)
        .filter(F.col("b") <= F.col("_at"))
        .groupBy(*keys)
        .agg(
            F.max("_at").alias("b"),
            F.sum(F.col("s") * weight).alias("s"),
            F.sum(F.col("n") * weight).alias("n"),
        )
    )


def tick_chunks(rows: DataFrame, gamma: float, keys: Sequence[str] = KEYS, cap: int = CHUNK_CAP) -> DataFrame:
    """Rows of ``b, s, n`` summed per key and chunk of ticks, decayed to the chunk's ``end``; ``b`` is the newest tick."""
    h = chunk_ticks(gamma, cap)
    end = F.floor(F.col("b") / h) * h + (h - 1)
    weight = F.pow(F.lit(float(gamma)), (end - F.col("b")).cast("double"))
    return rows.groupBy(*keys, end.cast("bigint").alias("end")).agg(
        F.sum(F.col("s") * weight).alias("s"), F.sum(F.col("n") * weight).alias("n"), F.max("b").alias("b")
    )


def chunk_ticks(gamma: float, cap: int = CHUNK_CAP) -> int:
    """Ticks per chunk so that ``gamma ** -ticks`` is far from overflow."""
    if gamma <= 0.0:
        return 1
    if gamma >= 1.0:
        return cap
    return max(1, min(cap, int(SCALE_RANGE / -math.log(gamma))))


def block_copies(totals: DataFrame, keys: Sequence[str], q: float, size: int) -> DataFrame:
    """Totals of blocks (``_k``, decayed to their last chunk) as what each later block starts with, in ``_es`` and ``_en``.

    ``q`` is the decay of a chunk, ``size`` the chunks of a block. A block is copied to the blocks where it still counts: a handful if a
    block decays by the full range of weights, all later ones only if nothing decays, when blocks are as long as can be.
    """
    last = F.col("_last")
    counts = 1 if q <= 0.0 else int(DECAY_RANGE / (size * -math.log(q))) + 2 if q < 1.0 else None
    reach = last if counts is None else F.least(last, F.col("_k") + F.lit(counts))
    pull = F.pow(F.lit(q), ((F.col("_to") - F.col("_k") - 1) * size).cast("double"))
    return (
        totals.withColumn("_last", F.max("_k").over(Window.partitionBy(*keys)))
        .filter(F.col("_k") < last)
        .withColumn("_to", F.explode(F.sequence(F.col("_k") + 1, reach)))
        .groupBy(*keys, F.col("_to").alias("_k"))
        .agg(F.sum(F.col("_es") * pull).alias("_es"), F.sum(F.col("_en") * pull).alias("_en"))
    )


def carried_chunks(
    ends: DataFrame, spine: DataFrame, keys: Sequence[str], gamma: float, h: int, cap: int = CHUNK_CAP
) -> DataFrame:
    """What each chunk of ``spine`` (keys, ``_c``, ``_b0``) starts with: the decayed totals of all earlier chunks, in ``_cs`` and ``_cn``.

    A prefix scan in two levels: running sums over the chunks of a block, and block totals carried to later blocks. Its rows
    are linear in the chunks.
    """
    if gamma <= 0.0:
        return spine.select(*keys, "_c", "_b0", F.lit(0.0).alias("_cs"), F.lit(0.0).alias("_cn"))
    q = float(gamma) ** h
    size = chunk_ticks(q, cap)
    chunks = spine.select(*keys, "_c", "_b0", F.lit(0.0).alias("_es"), F.lit(0.0).alias("_en"))
    totals = ends.select(*keys, "_c", F.lit(None).cast("bigint").alias("_b0"), "_es", "_en")
    rows = (
        chunks.unionByName(totals)
        .groupBy(*keys, "_c")
        .agg(F.max("_b0").alias("_b0"), F.sum("_es").alias("_es"), F.sum("_en").alias("_en"))
        .withColumn("_k", F.floor(F.col("_c") / size).cast("bigint"))
    )
    to_end = F.pow(F.lit(q), (F.col("_k") * size + (size - 1) - F.col("_c")).cast("double"))
    blocks = rows.groupBy(*keys, "_k").agg(F.sum(F.col("_es") * to_end).alias("_es"), F.sum(F.col("_en") * to_end).alias("_en"))
    # What a block starts with stands as one more chunk before its first one.
    starts = block_copies(blocks, keys, q, size).select(
        *keys, (F.col("_k") * size - 1).alias("_c"), F.lit(None).cast("bigint").alias("_b0"), "_es", "_en", "_k"
    )
    place = (F.col("_c") - F.col("_k") * size).cast("double")
    up, down = (F.lit(1.0), F.lit(1.0)) if size == 1 else (F.pow(F.lit(q), -place), F.pow(F.lit(q), place - 1))
    before = Window.partitionBy(*keys, "_k").orderBy("_c").rowsBetween(Window.unboundedPreceding, -1)

    def carried(name: str) -> Column:
        return F.coalesce(F.sum(F.col(name) * up).over(before), F.lit(0.0)) * down

    scanned = rows.unionByName(starts).select(*keys, "_c", "_b0", carried("_es").alias("_cs"), carried("_en").alias("_cn"))
    return scanned.filter("_b0 IS NOT NULL")


def _decayed_series(
    sums: DataFrame, keys: Sequence[str], gamma: float, last: Column, since: Column | None, cap: int
) -> DataFrame:
    """State of each key at every tick from its first one to ``last`` (an expression of the keys).

    A prefix scan in chunks of ticks: running sums inside a chunk, the decayed
    totals of earlier chunks carried in. Each window holds one key and one chunk.
    """
    h = chunk_ticks(gamma, cap)
    g = F.lit(float(gamma))
    chunk = F.floor(F.col("b") / h)
    rows = sums.select(*keys, "b", "s", "n").filter(F.col("b") <= last).withColumn("_c", chunk)
    chunk_end = F.col("_c") * h + (h - 1)
    to_end = F.pow(g, (chunk_end - F.col("b")).cast("double"))
    ends = rows.groupBy(*keys, "_c").agg(
        F.sum(F.col("s") * to_end).alias("_es"),
        F.sum(F.col("n") * to_end).alias("_en"),
        F.min("b").alias("_b0"),
    )
    spine = (
        ends.groupBy(*keys)
        .agg(F.min("_b0").alias("_b0"))
        .withColumn("_c", F.explode(F.sequence(F.floor(F.col("_b0") / h), F.floor(last / h))))
        .select(*keys, "_c", "_b0")
    )
    chunks = carried_chunks(ends, spine, keys, gamma, h)
    begin = F.greatest(F.col("_b0"), F.col("_c") * h)
    if since is not None:
        begin = F.greatest(begin, since)
    until = F.least(chunk_end, last)
    ticks = chunks.filter(begin <= until).select(
        *keys,
        "_c",
        F.explode(F.sequence(begin, until)).alias("b"),
        F.lit(0.0).alias("s"),
        F.lit(0.0).alias("n"),
        F.col("_cs"),
        F.col("_cn"),
        F.lit(True).alias("_tick"),
    )
    data = rows.select(
        *keys,
        "_c",
        "b",
        "s",
        "n",
        F.lit(0.0).alias("_cs"),
        F.lit(0.0).alias("_cn"),
        F.lit(False).alias("_tick"),
    )
    running = (
        Window.partitionBy(*keys, "_c").orderBy("b").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    )
    place = (F.col("b") - F.col("_c") * h).cast("double")
    up, down, carry = F.pow(g, -place), F.pow(g, place), F.pow(g, place + 1)
    return (
        ticks.unionByName(data)
        .withColumn("_rs", F.sum(F.col("s") * up).over(running))
        .withColumn("_rn", F.sum(F.col("n") * up).over(running))
        .filter("_tick")
        .select(
            *keys,
            "b",
            (F.col("_rs") * down + F.col("_cs") * carry).alias("s"),
            (F.col("_rn") * down + F.col("_cn") * carry).alias("n"),
        )
    )


def discounted_history(
    sums: DataFrame,
    gamma: float,
    at: int | Column | None = None,
    since: int | None = None,
    keys: Sequence[str] = KEYS,
    chunk_cap: int = CHUNK_CAP,
) -> DataFrame:
    """Decayed state of every known key at every tick, from its first tick to ``at``.

    ``since`` keeps only ticks from there on; earlier sums still count. The tick sums are stored, as several steps read them; what they are
    summed from is read once.
    """
    sums = materialize(sums.select(*keys, "b", "s", "n"), "sums")
    last = _as_column(sums, at, F.max)
    floor = None if since is None else F.lit(since).cast("bigint")
    return _decayed_series(sums, keys, gamma, last, floor, chunk_cap)


def discounted_reset(
    sums: DataFrame,
    gamma: float,
    origin: int | Column | None = None,
    every: int = RESET_EVERY,
    at: int | Column | None = None,
    keys: Sequence[str] = KEYS,
    chunk_cap: int = CHUNK_CAP,
) -> DataFrame:
    """Decayed state that starts anew after every ``every`` ticks.

    Tick ``k`` counts from 1 at ``origin`` (default: the first tick). The last tick
    of an epoch has ``reset`` true and still carries the state of its epoch.
    """
    sums = materialize(sums.select(*keys, "b", "s", "n"), "sums")
    start = _as_column(sums, origin, F.min)
    last = _as_column(sums, at, F.max)
    staged = sums.withColumn("_o", start).filter(F.col("b") >= F.col("_o"))
    staged = staged.withColumn("epoch", F.floor((F.col("b") - F.col("_o")) / every).cast("bigint"))
    epoch_end = start + (F.col("epoch") + 1) * every - 1
    series = _decayed_series(staged, [*keys, "epoch"], gamma, F.least(last, epoch_end), None, chunk_cap)
    tick = (F.col("b") - start + 1).cast("bigint")
    return series.withColumn("k", tick).withColumn("reset", F.col("k") % every == 0)


def merge_state(
    old: DataFrame, new: DataFrame, gamma: float, ticks: int = 1, keys: Sequence[str] = KEYS
) -> DataFrame:
    """Old state decayed by ``ticks`` plus the sums of the new tick; keys of either side stay."""
    weight = F.lit(float(gamma) ** ticks)
    aged = old.select(*keys, (F.col("s") * weight).alias("s"), (F.col("n") * weight).alias("n"))
    fresh = new.select(*keys, F.col("s").cast("double").alias("s"), F.col("n").cast("double").alias("n"))
    return aged.unionByName(fresh).groupBy(*keys).agg(F.sum("s").alias("s"), F.sum("n").alias("n"))


def weighted_sums(df: DataFrame, to_end: Column, gamma: float, seconds: int, groups: list) -> DataFrame:
    weight = F.pow(F.lit(float(gamma)), to_end.cast("double"))
    return df.groupBy(*groups).agg(
        F.sum(F.col("reward").cast("double") * weight).alias("s"),
        F.sum(weight).alias("n"),
        F.max(tick_of("ts", seconds)).alias("b"),
        F.max("ts").alias("seen"),
    )


def chunk_sums(
    df: DataFrame, gamma: float, seconds: int, keys: Sequence[str] = KEYS, chunk_cap: int = CHUNK_CAP
) -> DataFrame:
    """Rewards and counts per key and chunk of ticks, decayed to the chunk's end; ``b`` is the newest tick, ``seen`` the newest time.

    Later rows never change the weight of earlier ones, so this is a plain
    aggregation: partial sums are combined before the shuffle, and it holds for a
    stream as for a table.
    """
    h = chunk_ticks(gamma, chunk_cap)
    end = F.floor(tick_of("ts", seconds) / h) * h + (h - 1)
    span = F.window("ts", f"{h * seconds} seconds").alias("span")
    sums = weighted_sums(df, end - tick_of("ts", seconds), gamma, seconds, [span, *keys])
    last = F.floor(F.unix_seconds("span.end") / seconds) - 1
    return sums.select(*keys, last.cast("bigint").alias("end"), "s", "n", "b", "seen")


def chunk_state(
    chunks: DataFrame, gamma: float, at: int | Column | None = None, keys: Sequence[str] = KEYS
) -> DataFrame:
    """State at tick ``at`` (default: the newest tick seen) from chunk sums."""
    last = chunks.select(F.max("b")).scalar() if at is None else (at if isinstance(at, Column) else F.lit(at))
    weight = F.pow(F.lit(float(gamma)), (F.col("_at") - F.col("end")).cast("double"))
    if gamma <= 0.0:
        weight = F.when(F.col("_at") == F.col("end"), 1.0).otherwise(0.0)
    return (
        chunks.withColumn("_at", last.cast("bigint"))
        .groupBy(*keys)
        .agg(
            F.max("_at").alias("b"),
            F.sum(F.col("s") * weight).alias("s"),
            F.sum(F.col("n") * weight).alias("n"),
        )
    )


def with_slot(chunks: DataFrame) -> DataFrame:
    """Open chunk sums as rows of a store: ``slot`` is their chunk, null in the folded row of a key."""
    return chunks.withColumn("slot", F.col("end"))


def fold_closed(chunks: DataFrame, gamma: float, closed: int, keys: Sequence[str] = KEYS) -> DataFrame:
    """Rows of a store with all chunks that ended at tick ``closed`` or before added to the folded row of their key, decayed to that tick.

    ``closed`` never goes back from one call on a store to the next. Only for chunks whose sums can change no more: an open row is replaced by its new total, a folded one never is. The state
    read from the result is the same, and a key holds few rows however long its stream runs.
    """
    done = F.col("slot").isNull() | (F.col("slot") <= closed)
    end = F.when(done, F.lit(closed)).otherwise(F.col("end"))
    weight = F.pow(F.lit(float(gamma)), (F.col("_end") - F.col("end")).cast("double"))
    folded = chunks.withColumn("_end", end).groupBy(*keys, F.when(~done, F.col("slot")).alias("_slot"), "_end").agg(
        F.sum(F.col("s") * weight).alias("s"), F.sum(F.col("n") * weight).alias("n"), F.max("b").alias("b")
    )
    return folded.select(*keys, F.col("_slot").alias("slot"), F.col("_end").cast("bigint").alias("end"), "s", "n", "b")
