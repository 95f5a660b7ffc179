"""From session reports to decisions, as one batch plan or as running loops."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.messages import format_best, format_picks, format_reset
from ..operators.selection import best_by_mean, carry_forward, reset_picks, ucb_picks
from ..operators.state import CHUNK_CAP, KEYS, chunk_state, chunk_sums, fold_closed, with_slot
from ..operators.updates import parse_updates, valid_updates
from ..operators.windows import window_scores
from ..schemas import RESET_EVERY
from ..session import materialize
from ..sources.folders import batch_watermark, checkpoint_owner
from ..sources.store import LatestStore
from ..streaming.run import each_batch
from ..streaming.state import reset_ticks, stream_discounted, tick_sums
from ..streaming.windows import stream_panes, window_ends

STATE_KEYS = (*KEYS, "slot")
DELAY = 3_600
MICROS = 1_000_000

Publish = Callable[[DataFrame, int], None]


def latest_state(messages: DataFrame, gamma: float, seconds: int, cost_type: str = "double") -> DataFrame:
    """Decayed state at the last tick from messages.

    Messages are read once, into one row per group, decision and chunk of ticks; the
    last tick and the state come from those few rows, kept in the shared folder.
    """
    updates = valid_updates(parse_updates(messages, cost_type=cost_type))
    return chunk_state(materialize(chunk_sums(updates, gamma, seconds), "chunks"), gamma)


def ucb_decisions(
    messages: DataFrame, gamma: float, k: int, seconds: int = 2, cost_type: str = "double"
) -> DataFrame:
    """The next ``k`` decisions of every group from its update messages."""
    return ucb_picks(latest_state(messages, gamma, seconds, cost_type), gamma, k)


def best_decisions(messages: DataFrame, length: int = 60, slide: int = 2, cost_type: str = "double") -> DataFrame:
    """Best and other decisions of every group and window from its update messages."""
    updates = valid_updates(parse_updates(messages, cost_type=cost_type))
    return best_by_mean(window_scores(updates, length, slide))


def decision_stream(
    messages: DataFrame,
    state_path: str,
    checkpoint: str,
    publish: Publish,
    gamma: float,
    k: int,
    seconds: int = 2,
    origin: str = "",
    trigger: dict | None = None,
    delay_seconds: int | None = DELAY,
    chunk_cap: int = CHUNK_CAP,
    cost_type: str = "double",
) -> StreamingQuery:
    """Keep the decayed state of a message stream and publish picks after every batch.

    Each batch puts its changed chunk sums into the stored state and picks for all known groups at the newest tick, also for those
    without new rows. Rows later than ``delay_seconds`` may be dropped. Chunks that had ended by the watermark of the batch before
    can get no more rows: no later batch lets any through. They are added, once, to one folded row per group and decision, kept apart from the
    open chunks, whose totals are replaced. The newest time seen is committed with the store, so a replayed batch folds the
    same chunks. Without a delay no row is ever late and no chunk is ever folded.
    """
    spark = messages.sparkSession
    updates = valid_updates(parse_updates(messages, cost_type=cost_type))
    delay = None if delay_seconds is None else f"{delay_seconds} seconds"
    store: list[LatestStore] = []

    def serve(batch: DataFrame, batch_id: int) -> None:
        if not store:
            owner = checkpoint_owner(spark, checkpoint)
            store.append(LatestStore(spark, state_path, STATE_KEYS, bucket_by=KEYS, owner=owner))
        rows = batch.persist()
        try:
            before = store[0].note(before=batch_id).get("seen")
            now = rows.agg(F.max(F.unix_micros("seen")).alias("seen")).first()["seen"]
            seen = max((t for t in (before, now) if t is not None), default=None)
            fold = None
            if delay_seconds is not None and before is not None:
                closed = (before // MICROS - delay_seconds) // seconds - 1

                def fold(table: DataFrame) -> DataFrame:
                    return fold_closed(table, gamma, closed)

            store[0].merge(with_slot(rows.drop("seen")), batch_id, fold, note={"seen": seen})
        finally:
            rows.unpersist()
        if (table := store[0].read(before=batch_id + 1)) is not None:
            publish(format_picks(ucb_picks(chunk_state(table, gamma), gamma, k), origin), batch_id)

    changed = stream_discounted(updates, gamma, seconds, delay=delay, chunk_cap=chunk_cap)
    return each_batch(changed, serve, checkpoint, "update", trigger)


def reset_messages(series: DataFrame, gamma: float, k: int, origin: str, every: int = RESET_EVERY) -> DataFrame:
    """Messages ``b, value`` of a resetting state: picks, and the word for a free draw on reset ticks."""
    picks = reset_picks(series, gamma, k, every)
    listed = F.when(F.col("k") % every == 0, F.get("picks", F.lit(0))).otherwise(F.concat(F.array_join("picks", ":"), F.lit(":")))
    return format_reset(picks.withColumn("decision", listed), origin).select("b", "value")


def reset_stream(
    messages: DataFrame,
    checkpoint: str,
    publish: Publish,
    gamma: float,
    k: int,
    first_tick: int,
    seconds: int = 2,
    every: int = RESET_EVERY,
    origin: str = "",
    trigger: dict | None = None,
    delay_seconds: int = 2,
    cost_type: str = "double",
) -> StreamingQuery:
    """Publish the picks of every known group for every tick, with a state that starts anew after every ``every`` ticks.

    A tick is published when the watermark passes it. The last tick of an epoch carries the word for a free draw, for each
    group of that epoch, also for those that fell silent. ``publish`` gets all ticks that closed in a batch, with their number in ``b``.
    """
    updates = valid_updates(parse_updates(messages, cost_type=cost_type))
    ticks = reset_ticks(tick_sums(updates, seconds, f"{delay_seconds} seconds"), gamma, seconds, first_tick, every)

    def serve(batch: DataFrame, batch_id: int) -> None:
        publish(reset_messages(batch, gamma, k, origin, every), batch_id)

    return each_batch(ticks, serve, checkpoint, "append", trigger)


def epsilon_stream(
    messages: DataFrame,
    state_path: str,
    checkpoint: str,
    publish: Publish,
    epsilon: float,
    length: int = 60,
    slide: int = 2,
    origin: str = "",
    trigger: dict | None = None,
    delay_seconds: int = 2,
    cost_type: str = "double",
    digits: int | None = None,
) -> StreamingQuery:
    """Publish the best decision of every group whenever a sliding window closes.

    ``publish`` gets the decisions in force at the ticks that closed in a batch: ``group_id``, ``tick``, ``w_end`` (the window the decision comes
    from, which is older than the tick for a silent group) and the message ``value``. The last decision of each group is stored under
    ``state_path``, so a group stays in force however long it is silent.

    The stream's own state holds the open panes of one slide. Panes that closed are copied to the windows that hold them in plain batch steps, and
    the panes that later windows need, those of one window length, are kept beside the decisions, anew for every batch.
    """
    spark = messages.sparkSession
    updates = valid_updates(parse_updates(messages, cost_type=cost_type))
    panes = stream_panes(updates, slide, f"{delay_seconds} seconds")
    store: list[LatestStore] = []

    def kept(batch_id: int) -> str:
        return f"{state_path.rstrip('/')}/_panes/{batch_id:012d}"

    def serve(batch: DataFrame, batch_id: int) -> None:
        if not store:
            store.append(LatestStore(spark, state_path, ["group_id"], owner=checkpoint_owner(spark, checkpoint)))
        before = [v for v in store[0].versions() if v < batch_id]
        note = store[0].note(before=batch_id)
        after, closed = note.get("through"), note.get("closed")
        # All windows that end by the watermark are closed: their panes have come out in this batch or in those before.
        through = batch_watermark(spark, checkpoint, batch_id) // 1000 // slide * slide
        closing = batch.persist()
        known_panes = closing if not before else closing.unionByName(spark.read.schema(closing.schema).parquet(kept(before[-1])))
        scores = window_ends(known_panes, length, slide, after, through)
        if digits is not None:
            scores = scores.withColumn("s", F.round("s", digits))
        rows = best_messages(best_by_mean(scores, ("group_id", "w_end")), epsilon, origin).select("group_id", "w_end", "value").persist()
        try:
            known_panes.filter(F.col("end") > _whole(through + slide - length)).write.mode("overwrite").parquet(kept(batch_id))
            span = rows.agg(F.min("w_end").alias("lo"), F.max("w_end").alias("hi")).first()
            old = store[0].read(before=batch_id)
            newest = rows.groupBy("group_id").agg(F.max_by("value", "w_end").alias("value"), F.max("w_end").alias("w_end"))
            last = closed if span["hi"] is None else span["hi"]
            store[0].merge(newest.select("group_id", "w_end", "value"), batch_id, order=["w_end"], note={"closed": last, "through": through})
            if span["hi"] is not None:
                first = span["lo"] if closed is None else closed + slide
                known = rows if old is None else rows.unionByName(old)
                publish(carry_forward(known, _whole(first), _whole(last), slide), batch_id)
            # Only the batch before can be asked for again, by a replay of this one.
            for name in store[0].folder.names("_panes"):
                if before and int(name) < before[-1]:
                    store[0].folder.remove(f"_panes/{name}")
        finally:
            rows.unpersist()
            closing.unpersist()

    return each_batch(panes, serve, checkpoint, "append", trigger)


def _whole(number: int) -> Column:
    return F.lit(number).cast("bigint")


def best_messages(best: DataFrame, epsilon: float, origin: str) -> DataFrame:
    return format_best(best, epsilon, origin)
