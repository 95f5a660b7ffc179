"""Decayed and resetting state over streams.

Decay is folded into built-in aggregates: a reward is weighed by its distance to
the end of its chunk of ticks, which no later row changes. Sums per chunk are
therefore plain sums: combined before the shuffle, so a hot group costs no more
than others, kept in the state store, and the same for any arrival order. The
decayed state at a tick is a short weighted sum over chunks when it is read.

A state that has to speak up when time passes, and not only when a row comes, is kept
with a timer on event time (``reset_ticks``).
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from ..functions.ticks import tick_of
from ..operators.state import CHUNK_CAP, KEYS, chunk_state, chunk_sums, chunk_ticks, weighted_sums
from ..schemas import RESET_EVERY


def stream_discounted(
    df: DataFrame,
    gamma: float,
    seconds: int,
    keys: Sequence[str] = KEYS,
    delay: str | None = None,
    chunk_cap: int = CHUNK_CAP,
) -> DataFrame:
    """Chunk sums per key, for update mode; :func:`~sessionloom.operators.state.chunk_state` reads the state off them.

    With ``delay`` a watermark drops the state of chunks that have passed; without
    it rows may come in any order, however late.
    """
    staged = df.withWatermark("ts", delay) if delay else df
    return chunk_sums(staged, gamma, seconds, keys, chunk_cap)


def stream_reset(
    df: DataFrame,
    gamma: float,
    seconds: int,
    origin: int,
    every: int = RESET_EVERY,
    keys: Sequence[str] = KEYS,
    delay: str | None = None,
) -> DataFrame:
    """Chunk sums per key and epoch of ``every`` ticks from tick ``origin``, for update mode."""
    h = min(chunk_ticks(gamma), every)
    staged = df.withWatermark("ts", delay) if delay else df
    length = every * seconds
    shift = (origin * seconds) % length
    span = F.window("ts", f"{length} seconds", startTime=f"{shift} seconds").alias("span")
    offset = F.pmod(tick_of("ts", seconds) - F.lit(origin), F.lit(every))
    part = F.floor(offset / h)
    end = F.least(part * h + (h - 1), F.lit(every - 1))
    sums = weighted_sums(staged, end - offset, gamma, seconds, [span, part.alias("part"), *keys])
    first = F.floor(F.unix_seconds("span.start") / seconds)
    return sums.select(
        *keys,
        F.floor((first - origin) / every).cast("bigint").alias("epoch"),
        (first + F.least(F.col("part") * h + (h - 1), F.lit(every - 1))).cast("bigint").alias("end"),
        "s",
        "n",
        "b",
    )


def epoch_state(
    chunks: DataFrame,
    gamma: float,
    origin: int,
    every: int = RESET_EVERY,
    at: int | Column | None = None,
    keys: Sequence[str] = KEYS,
) -> DataFrame:
    """State at tick ``at`` from the chunks of its epoch only; older epochs no longer count."""
    last = chunks.select(F.max("b")).scalar() if at is None else (at if isinstance(at, Column) else F.lit(at))
    current = chunks.withColumn("_now", last.cast("bigint")).filter(
        F.col("epoch") == F.floor((F.col("_now") - origin) / every)
    )
    state = chunk_state(current.drop("_now"), gamma, last, keys)
    tick = (F.col("b") - origin + 1).cast("bigint")
    return state.withColumn("k", tick).withColumn("reset", F.col("k") % every == 0)


HELD = "tick bigint, decisions array<string>, s array<double>, n array<double>"
TICKS = "group_id string, b bigint, k bigint, decision string, s double, n double, reset boolean"


def tick_sums(df: DataFrame, seconds: int, delay: str) -> DataFrame:
    """Sums per group, decision and tick of a stream, for append mode: a tick comes out when the watermark has passed it."""
    return (
        df.withWatermark("ts", delay)
        .groupBy(F.window("ts", f"{seconds} seconds").alias("tick"), *KEYS)
        .agg(F.sum("reward").cast("double").alias("s"), F.count(F.lit(1)).cast("double").alias("n"))
    )


class ResetClock(StatefulProcessor):
    """The resetting state of one group, moved on tick by tick as the watermark passes.

    Kept are the decayed sums and the last tick they were emitted for. A timer on event time wakes the group at the end of its next tick, so a
    tick comes out when time passes and not only when a row comes. After the last tick of an epoch the state is cleared; a
    group that stays silent then has no state and no timer until its next row.
    """

    def __init__(self, gamma: float, seconds: int, origin: int, every: int) -> None:
        self.gamma, self.millis, self.origin, self.every = gamma, seconds * 1000, origin, every

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.held = handle.getValueState("held", HELD)

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        new: dict[int, dict[str, tuple[float, float]]] = {}
        for row in rows:
            new.setdefault(row["b"], {})[row["decision"]] = (row["s"], row["n"])
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        return self.advanced(key[0], new, timerValues.getCurrentWatermarkInMs())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        return self.advanced(key[0], {}, timerValues.getCurrentWatermarkInMs())

    def advanced(self, group: str, new: dict[int, dict[str, tuple[float, float]]], watermark: int) -> Iterator[Row]:
        # All decisions of a tick come at once, when it is closed.
        closed = max([watermark // self.millis - 1, *new])
        held: dict[str, tuple[float, float]] = {}
        tick = min(new, default=closed + 1)
        if self.held.exists():
            last, decisions, sums, counts = self.held.get()
            held, tick = {d: (s, n) for d, s, n in zip(decisions, sums, counts, strict=True)}, last + 1
        out = []
        while tick <= closed and (held or new):
            held = {d: (s * self.gamma, n * self.gamma) for d, (s, n) in held.items()}
            for decision, (s, n) in new.pop(tick, {}).items():
                before = held.get(decision, (0.0, 0.0))
                held[decision] = (before[0] + s, before[1] + n)
            k = tick - self.origin + 1
            reset = k % self.every == 0
            out += [Row(group_id=group, b=tick, k=k, decision=d, s=held[d][0], n=held[d][1], reset=reset) for d in sorted(held)]
            tick += 1
            if reset:
                held = {}
            if not held:
                tick = min(new, default=tick)
        if held:
            names = sorted(held)
            self.held.update((tick - 1, names, [held[d][0] for d in names], [held[d][1] for d in names]))
            # Timers fire when the watermark has reached them; a tick is closed by a watermark at its end.
            self.handle.registerTimer((tick + 1) * self.millis)
        else:
            self.held.clear()
        return iter(out)


def reset_ticks(sums: DataFrame, gamma: float, seconds: int, origin: int, every: int = RESET_EVERY) -> DataFrame:
    """The resetting state of every known group at every tick, from the closed tick sums of a stream (see ``tick_sums``).

    Tick ``k`` counts from 1 at tick ``origin``; ``reset`` is true on the last tick of an epoch. A group's clock sees one row for each decision
    and tick, however many reports there were. Needs the RocksDB state store.
    """
    placed = sums.select("group_id", F.floor(F.unix_seconds("tick.start") / seconds).cast("bigint").alias("b"), "decision", "s", "n")
    started = placed.filter(F.col("b") >= origin)
    clock = ResetClock(float(gamma), seconds, origin, every)
    return started.groupBy("group_id").transformWithState(clock, TICKS, "append", "eventTime")
