"""Queries that run a stream to the end of its source; the result must be the batch result."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions.ticks import tick_of
from ..operators import exchange
from ..operators.state import chunk_state
from ..session import fresh_path
from ..sources.store import LatestStore
from . import inputs as I
from . import oracle_parts as P
from .catalog import ORACLES, query
from .decision_loop import ucb_decisions
from .queries_state import DIGITS, RESET, SLIDE, WINDOW, WINDOWS


def _latest(spark, stream, keys):
    """Newest value per key of an update-mode aggregate, after all input."""
    store = LatestStore(spark, fresh_path(spark, "state"), keys)
    streaming.run_available(stream, streaming.keep_latest(store), fresh_path(spark, "mark"), "update")
    return store.read()


@query("stream_discounted", ORACLES["discounted_latest"])
def stream_discounted(spark, sf):
    updates = I.as_updates(I.events_stream(spark, sf))
    chunks = _latest(
        spark, streaming.stream_discounted(updates, I.GAMMA, I.DAY, chunk_cap=7), ["group_id", "decision", "end"]
    )
    state = chunk_state(chunks, I.GAMMA)
    return state.select("group_id", "decision", "b", F.round("s", DIGITS).alias("s"), F.round("n", DIGITS).alias("n"))


@query(
    "stream_reset",
    f"""WITH {RESET.replace('min(day) AS lo', f'{I.ORIGIN_DAY} AS lo')} SELECT group_id, decision, k, b, round(s, {DIGITS}) AS s,
        round(n, {DIGITS}) AS n, k % 15 = 0 AS reset FROM st WHERE b = (SELECT hi FROM o)""",
)
def stream_reset(spark, sf):
    updates = I.as_updates(I.events_stream(spark, sf))
    chunks = _latest(
        spark, streaming.stream_reset(updates, I.GAMMA, I.DAY, I.ORIGIN_DAY), ["group_id", "decision", "epoch", "end"]
    )
    state = streaming.epoch_state(chunks, I.GAMMA, I.ORIGIN_DAY)
    return state.select(
        "group_id", "decision", "k", "b", F.round("s", DIGITS).alias("s"), F.round("n", DIGITS).alias("n"), "reset"
    )


@query(
    "stream_window_scores",
    f"""WITH {WINDOWS} SELECT group_id, decision, w_end, round(s, 2) AS s, n FROM win
        WHERE w_end < (SELECT max(epoch_us(ts)) / 1000000.0 - 10 FROM events)""",
)
def stream_window_scores(spark, sf):
    """Windows closed by the watermark at the end of the input."""
    out, mark = fresh_path(spark, "windows"), fresh_path(spark, "mark")
    scores = streaming.stream_window_scores(I.as_updates(I.events_stream(spark, sf)), WINDOW, SLIDE)
    streaming.run_available(scores, lambda batch, i: batch.write.mode("overwrite").parquet(f"{out}/batch={i}"), mark)
    return spark.read.parquet(out).select(
        "group_id", "decision", F.unix_seconds("w_end").alias("w_end"), F.round("s", 2).alias("s"), "n"
    )


@query("stream_subscriptions", ORACLES["subscribe_merge"])
def stream_subscriptions(spark, sf):
    heard = exchange.parse_subscriptions(I.subscribe_messages(I.events_stream(spark, sf)))
    return _latest(spark, streaming.stream_subscriptions(heard), ["group_id", "cluster_id"])


@query("stream_assign", ORACLES["assign_uniform"])
def stream_assign(spark, sf):
    """Sessions served as they come with the decisions stored by then."""
    stored, out, mark = (fresh_path(spark, label) for label in ("picks", "served", "mark"))
    ucb_decisions(I.messages(spark, sf), I.GAMMA, I.PICKS, I.DAY, I.COST).write.parquet(stored)
    sessions = I.events_stream(spark, sf).select(
        "event_id", I.text(F.col("user_id") % (I.GROUPS + 1)).alias("group_id"), I.candidates().alias("candidates")
    )
    serve = streaming.stream_assign(lambda: spark.read.parquet(stored), out)
    streaming.run_available(sessions, serve, mark)
    return spark.read.parquet(out).select("event_id", "group_id", "decision")


@query("stream_push", ORACLES["push_decisions"])
def stream_push(spark, sf):
    """Stored subscriptions, then daily decisions pushed as a stream."""
    from .queries_exchange import daily_picks

    store = streaming.subscription_store(spark, fresh_path(spark, "pairs"))
    heard = exchange.parse_subscriptions(I.subscribe_messages(I.events_stream(spark, sf)))
    streaming.run_available(
        streaming.stream_subscriptions(heard), streaming.keep_latest(store), fresh_path(spark, "mark"), "update"
    )
    sent, out = fresh_path(spark, "daily"), fresh_path(spark, "pushed")
    daily = daily_picks(spark, sf)
    daily.write.parquet(sent)
    decisions = spark.readStream.schema(daily.schema).parquet(sent)

    def write(batch, batch_id):
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    streaming.run_available(decisions, streaming.push_batch(store, I.SELF_CLUSTER, write), fresh_path(spark, "mark"))
    pushed = spark.read.parquet(out)
    return pushed.select("group_id", "b", "cluster_id", F.array_join("picks", ":").alias("picks"), "topic")
