"""A stream over shuffled files gives the batch result, also after a restart and a replay."""

from __future__ import annotations

import json
import random

import pytest
from pyspark.sql import functions as F

from sessionloom import sources, streaming
from sessionloom.functions import tick_of
from sessionloom.operators import exchange, selection, state, windows
from sessionloom.plans import inputs
from sessionloom.plans.decision_loop import decision_stream, ucb_decisions
from sessionloom.schemas import EVENTS
from sessionloom.session import fresh_path
from sessionloom.sources import LatestStore

FILES = 6


@pytest.fixture(scope="module")
def split_events(spark, sf):
    """The events in several folders, rows dealt out at random."""
    root = fresh_path(spark, "split")
    raw = spark.read.parquet(f"{sf}/events.parquet")
    for i in range(FILES):
        part = raw.filter(F.pmod(F.xxhash64("event_id"), F.lit(FILES)) == i)
        part.coalesce(1).write.parquet(f"{root}/part{i}")
    return root


def stream_of(spark, path, per_trigger=1):
    df = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", per_trigger).parquet(path)
    return df.withColumn("ts", F.to_timestamp("ts"))


def updates_of(spark, path):
    return inputs.as_updates(stream_of(spark, f"{path}/*"))


def as_dict(df, *keys):
    return {tuple(r[k] for k in keys): (r.s, r.n) for r in df.collect()}


def assert_close(got, expected):
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] == pytest.approx(value, rel=1e-9), key


@pytest.mark.parametrize("cap", [5, 1 << 16])
def test_discounted_state_in_any_order(spark, sf, split_events, cap):
    store = LatestStore(spark, fresh_path(spark, "state"), ["group_id", "decision", "end"])
    stream = streaming.stream_discounted(updates_of(spark, split_events), 0.9, inputs.DAY, chunk_cap=cap)
    batches = []

    def write(batch, batch_id):
        batches.append(batch_id)
        store.merge(batch, batch_id)

    streaming.run_available(stream, write, fresh_path(spark, "mark"), "update")
    assert len(batches) >= FILES
    expected = state.discounted_latest(state.bucket_sums(inputs.updates(spark, sf), inputs.DAY), 0.9)
    got = state.chunk_state(store.read(), 0.9)
    assert_close(as_dict(got, "group_id", "decision"), as_dict(expected, "group_id", "decision"))


def test_restart_goes_on_from_the_checkpoint(spark, sf, split_events):
    store = LatestStore(spark, fresh_path(spark, "state"), ["group_id", "decision", "end"])
    mark, arriving = fresh_path(spark, "mark"), fresh_path(spark, "arriving")
    for i in range(3):
        spark.read.schema(EVENTS).parquet(*[f"{split_events}/part{j}" for j in (2 * i, 2 * i + 1)]).write.mode("append").parquet(arriving)
        stream = streaming.stream_discounted(inputs.as_updates(stream_of(spark, arriving)), 0.9, inputs.DAY)
        streaming.run_available(stream, store.merge, mark, "update")
    expected = state.discounted_latest(state.bucket_sums(inputs.updates(spark, sf), inputs.DAY), 0.9)
    assert_close(as_dict(state.chunk_state(store.read(), 0.9), "group_id", "decision"), as_dict(expected, "group_id", "decision"))


def test_reset_in_any_order(spark, sf, split_events):
    origin, every = 19_723, 7
    store = LatestStore(spark, fresh_path(spark, "state"), ["group_id", "decision", "epoch", "end"])
    stream = streaming.stream_reset(updates_of(spark, split_events), 0.8, inputs.DAY, origin, every)
    streaming.run_available(stream, store.merge, fresh_path(spark, "mark"), "update")
    sums = state.bucket_sums(inputs.updates(spark, sf), inputs.DAY)
    last = sums.agg(F.max("b")).first()[0]
    expected = state.discounted_reset(sums, 0.8, origin, every).filter(F.col("b") == last)
    got = streaming.epoch_state(store.read(), 0.8, origin, every)
    assert_close(as_dict(got, "group_id", "decision"), as_dict(expected, "group_id", "decision"))


def test_passed_chunks_leave_the_state_store(spark, split_events, sf):
    ordered = fresh_path(spark, "ordered")
    rows = spark.read.parquet(f"{sf}/events.parquet")
    edges = [0, 300, 600, 1000]
    for low, high in zip(edges, edges[1:]):
        rows.filter((F.col("event_id") >= low) & (F.col("event_id") < high)).coalesce(1).write.mode("append").parquet(ordered)
    store = LatestStore(spark, fresh_path(spark, "state"), ["group_id", "decision", "end"])
    updates = inputs.as_updates(stream_of(spark, ordered))
    stream = streaming.stream_discounted(updates, 0.9, inputs.DAY, delay="1 hour", chunk_cap=2)
    query = streaming.run.each_batch(stream, store.merge, fresh_path(spark, "mark"), "update", {"availableNow": True})
    query.awaitTermination()
    kept = query.lastProgress.stateOperators[0].numRowsTotal
    assert kept < store.read().count()
    expected = state.discounted_latest(state.bucket_sums(inputs.updates(spark, sf), inputs.DAY), 0.9)
    assert_close(as_dict(state.chunk_state(store.read(), 0.9), "group_id", "decision"), as_dict(expected, "group_id", "decision"))


def test_windows_in_time_order(spark, sf):
    ordered = fresh_path(spark, "ordered")
    rows = spark.read.parquet(f"{sf}/events.parquet")
    for low in range(0, 1000, 250):
        rows.filter((F.col("event_id") >= low) & (F.col("event_id") < low + 250)).coalesce(1).write.mode("append").parquet(ordered)
    out = fresh_path(spark, "windows")
    scores = streaming.stream_window_scores(inputs.as_updates(stream_of(spark, ordered)), inputs.DAY, 2 * inputs.HOUR)
    streaming.run_available(scores, lambda b, i: b.write.mode("overwrite").parquet(f"{out}/batch={i}"), fresh_path(spark, "mark"))
    end = rows.agg(F.max("ts")).first()[0]
    expected = windows.window_scores(inputs.updates(spark, sf), inputs.DAY, 2 * inputs.HOUR).filter(
        F.col("w_end") < F.lit(end) - F.expr("interval 10 seconds")
    )
    keys = ("group_id", "decision", "w_end")
    assert_close(as_dict(spark.read.parquet(out), *keys), as_dict(expected, *keys))


def test_subscriptions_keep_the_earliest_tick(spark, sf, split_events):
    store = streaming.subscription_store(spark, fresh_path(spark, "pairs"))
    heard = exchange.parse_subscriptions(inputs.subscribe_messages(stream_of(spark, f"{split_events}/*")))
    streaming.run_available(streaming.stream_subscriptions(heard), store.merge, fresh_path(spark, "mark"), "update")
    expected = exchange.subscriptions(exchange.parse_subscriptions(inputs.subscribe_messages(inputs.events(spark, sf))))
    assert sorted(map(str, store.read().select(*expected.columns).collect())) == sorted(map(str, expected.collect()))


def test_pushes_see_only_stored_subscriptions(spark):
    store = streaming.subscription_store(spark, fresh_path(spark, "pairs"))
    sent = []
    push = streaming.push_batch(store, "me", lambda df, i: sent.append((i, [r.cluster_id for r in df.collect()])))
    decisions = spark.createDataFrame([("g", 5)], "group_id string, b long")
    push(decisions, 0)
    store.merge(spark.createDataFrame([("g", "far", 1)], "group_id string, cluster_id string, first_bucket long"), 0)
    push(decisions, 1)
    assert sent == [(1, ["far"])]


def test_assigned_sessions_follow_the_latest_decisions(spark, split_events):
    current = {"picks": "a"}
    types = F.array(*map(F.lit, "abc"))
    sessions = stream_of(spark, f"{split_events}/*").select("event_id", F.lit("g").alias("group_id"), types.alias("candidates"))
    out, mark = fresh_path(spark, "served"), fresh_path(spark, "mark")

    def latest():
        return spark.createDataFrame([("g", [current["picks"]])], "group_id string, picks array<string>")

    serve = streaming.stream_assign(latest, out)

    def step(batch, batch_id):
        current["picks"] = "ab"[batch_id % 2]
        serve(batch, batch_id)

    streaming.run_available(sessions, step, mark)
    by_batch = {r.batch: r.d for r in spark.read.parquet(out).groupBy("batch").agg(F.collect_set("decision").alias("d")).collect()}
    assert len(by_batch) == FILES and all(d == ["ab"[b % 2]] for b, d in by_batch.items())


def test_decision_stream_ends_with_the_batch_picks(spark, sf, split_events):
    messages = inputs.as_messages(stream_of(spark, f"{split_events}/*"))
    published = {}

    def publish(df, batch_id):
        published[batch_id] = sorted(r.value for r in df.collect())

    decision_stream(
        messages, fresh_path(spark, "state"), fresh_path(spark, "mark"), publish, inputs.GAMMA, 5, inputs.DAY, "edge",
        {"availableNow": True},
    ).awaitTermination()
    batch = ucb_decisions(inputs.messages(spark, sf), inputs.GAMMA, 5, inputs.DAY)
    expected = sorted(f"{r.group_id};{':'.join(r.picks)}:;From: edge" for r in batch.collect())
    assert len(published) >= FILES and published[max(published)] == expected


@pytest.mark.parametrize("gamma", [0.0, 0.9, 1.0])
def test_folded_chunks_give_the_same_state(spark, sf, gamma):
    chunks = state.with_slot(state.chunk_sums(inputs.updates(spark, sf), gamma, inputs.DAY, chunk_cap=2).drop("seen"))
    newest = chunks.agg(F.max("end")).first()[0]
    folded = state.fold_closed(chunks, gamma, newest - 4)
    again = state.fold_closed(folded, gamma, newest - 2)
    expected = as_dict(state.chunk_state(chunks, gamma), "group_id", "decision")
    for table, closed in ((folded, newest - 4), (again, newest - 2)):
        assert table.groupBy("group_id", "decision", "slot").count().filter("count > 1").count() == 0
        assert table.filter("slot IS NOT NULL").agg(F.min("slot")).first()[0] > closed
        assert_close(as_dict(state.chunk_state(table, gamma), "group_id", "decision"), expected)


def test_decision_stream_with_a_delay_keeps_little_state(spark, sf):
    ordered = fresh_path(spark, "ordered")
    rows = spark.read.parquet(f"{sf}/events.parquet")
    for low in range(0, 1000, 125):
        rows.filter((F.col("event_id") >= low) & (F.col("event_id") < low + 125)).coalesce(1).write.mode("append").parquet(ordered)
    published, root = {}, fresh_path(spark, "state")
    query = decision_stream(
        inputs.as_messages(stream_of(spark, ordered)), root, fresh_path(spark, "mark"),
        lambda df, i: published.update({i: sorted(r.value for r in df.collect())}), inputs.GAMMA, 5, inputs.DAY, "edge",
        {"availableNow": True}, delay_seconds=inputs.DAY, chunk_cap=2,
    )
    query.awaitTermination()
    batch = ucb_decisions(inputs.messages(spark, sf), inputs.GAMMA, 5, inputs.DAY)
    assert published[max(published)] == sorted(f"{r.group_id};{':'.join(r.picks)}:;From: edge" for r in batch.collect())
    stored = LatestStore(spark, root, ["group_id", "decision", "slot"]).read()
    assert stored.groupBy("group_id", "decision").count().agg(F.max("count")).first()[0] <= 5
    assert stored.filter("slot IS NULL").groupBy("group_id", "decision").count().agg(F.max("count")).first()[0] == 1


def test_store_replays_and_prunes(spark):
    path = fresh_path(spark, "store")
    store = LatestStore(spark, path, ["k"], keep=2, buckets=4)

    def rows(*pairs):
        return spark.createDataFrame(list(pairs), "k string, v int")

    def content(**options):
        return {r.k: r.v for r in store.read(**options).collect()}

    assert store.read() is None and store.note() == {}
    store.merge(rows(("a", 1), ("b", 1)), 0, note={"t": 0})
    store.merge(rows(("a", 2)), 1)
    store.merge(rows(("a", 3)), 1, note={"t": 1})
    assert content() == {"a": 3, "b": 1} and content(before=1) == {"a": 1, "b": 1}
    assert store.note() == {"t": 1} and store.note(before=1) == {"t": 0}
    for version in range(2, 8):
        store.merge(rows(("a", version)), version)
    store.merge(rows(), 8)
    assert content() == {"a": 7, "b": 1} and content(before=7) == {"a": 6, "b": 1}
    # Of the versions before the kept ones only what still holds is left: the bucket of b.
    assert store.versions()[-3:] == [6, 7, 8] and len(store.versions()) <= 5
    store.merge(rows(("b", None)), 9)
    assert content() == {"a": 7, "b": None}
    # A write that was not committed is not seen.
    rows(("a", 99)).write.parquet(f"{path}/version={10:012d}/bucket=0")
    assert content() == {"a": 7, "b": None}


def test_a_batch_writes_its_buckets_only(spark):
    store = LatestStore(spark, fresh_path(spark, "store"), ["k"], buckets=32)
    store.merge(spark.range(4_000).select(F.col("id").alias("k"), F.lit(0).alias("v")), 0)
    store.merge(spark.range(2).select(F.col("id").alias("k"), F.lit(1).alias("v")), 1)
    assert len(store._layout()[0]) == 32 and len(store._layout()[1]) <= 2
    got = store.read()
    assert got.count() == 4_000 and got.agg(F.sum("v")).first()[0] == 2


def test_a_store_refuses_another_stream(spark, sf, split_events):
    root = fresh_path(spark, "state")
    messages = inputs.as_messages(stream_of(spark, f"{split_events}/*", 100))

    def run(mark):
        decision_stream(messages, root, mark, lambda df, i: None, 0.9, 3, inputs.DAY, trigger={"availableNow": True}).awaitTermination()

    mark = fresh_path(spark, "mark")
    run(mark)
    run(mark)
    with pytest.raises(Exception, match="fresh checkpoint"):
        run(fresh_path(spark, "mark"))


def test_update_log_moves_finished_files(spark, tmp_path):
    queue, done, mark = tmp_path / "queue", tmp_path / "done", tmp_path / "mark"
    queue.mkdir()
    seen = []
    for i in range(3):
        (queue / f"q{i}").write_text(json.dumps({"update": f"u{i}", "group_id": "g"}) + "\nbroken\n")
        stream = sources.read_update_log(spark, str(queue), files_per_trigger=1, archive=str(done))
        streaming.run_available(stream, lambda b, _: seen.extend((r.update, r.ok) for r in b.collect()), str(mark))
    assert sorted(u for u, ok in seen if ok) == ["u0", "u1", "u2"] and sum(not ok for _, ok in seen) == 3


def test_message_stream_sink(spark, tmp_path, split_events):
    stream = stream_of(spark, f"{split_events}/*").select(F.col("event_type").alias("topic"), F.col("event_id").cast("string").alias("value"))
    with pytest.raises(ValueError):
        sources.write_messages(stream, "text", str(tmp_path / "x"))
    query = sources.write_messages(
        stream, "text", str(tmp_path / "out"), checkpoint=str(tmp_path / "mark"), trigger={"availableNow": True}
    )
    query.awaitTermination()
    got = {r.topic: r["count"] for r in spark.read.text(str(tmp_path / "out")).groupBy("topic").count().collect()}
    expected = {r.event_type: r["count"] for r in spark.read.parquet(f"{split_events}/*").groupBy("event_type").count().collect()}
    assert got == expected


def test_copies_are_counted_exactly(spark):
    seed = spark.createDataFrame([("x",)], "value string")
    live = spark.createDataFrame([("y",)], "value string").withColumn("ts", F.timestamp_seconds(F.lit(1)))
    for copies in (0, 1, 9_999, 10_000, 25_001):
        loaded = sources.preload(live, seed, copies, F.timestamp_seconds(F.lit(0)))
        assert loaded.count() == copies + 1


def test_files_of_results_logs_and_reports(spark, tmp_path):
    (tmp_path / "r").write_text("0,online,1.5\n1,local, 2\nbroken\n")
    rows = sources.read_results(spark, str(tmp_path / "r")).orderBy("line_no").collect()
    assert [(r.frontend, r["mode"], r.cost) for r in rows] == [(0, "online", 1.5), (1, "local", 2.0), (None, None, None)]
    (tmp_path / "host_1.bm").write_text("[3, 1.5, 800]\n[0, 10.000001, 10.1, 0.099999, 1]\n[1, 11.0, 11.5, 5e-1, 1]\n")
    headers, body = sources.read_response_logs(spark, str(tmp_path / "host_1.bm"))
    assert headers.first().worker == "host_1" and float(headers.first().seconds) == 1.5
    assert sorted((r.id, str(r.sent), str(r.rt), r.ok) for r in body.collect()) == [
        (0, "10.000001", "0.099999", True), (1, "11.000000", "0.500000", True)]
    for i, rate in enumerate((100.5, 99.5)):
        (tmp_path / f"run{i}.out").write_text(
            f"Complete requests: 9\nRequests per second:    {rate} [#/sec] (mean)\n"
            "Time per request:       10.5 [ms] (mean)\nTime per request:       1.5 [ms] (mean, across all concurrent requests)\n"
        )
    reports = sources.read_run_reports(spark, str(tmp_path / "run*.out"))
    total = reports.agg(F.avg("rate").alias("rate"), F.avg("mean_rt").alias("rt"), F.count(F.lit(1)).alias("n")).first()
    assert (total.rate, total.rt, total.n) == (100.0, 10.5, 2)


def test_trace_files_keep_line_order(spark, tmp_path):
    rng = random.Random(5)
    lines = [f"{rng.randint(1000, 9000)}\tx{i}\tDecisionMap\ta,{i}\tLoadMap\ta,0.1;2" for i in range(500)]
    (tmp_path / "t.txt").write_text("\n".join(lines) + "\n")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = sources.read_trace(spark, str(tmp_path / "t.txt")).orderBy("line_no").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", str(128 << 20))
    assert [r.costs["a"] for r in rows] == [float(i) for i in range(500)]


def test_window_messages_to_best_decision(spark, sf):
    from sessionloom.plans.decision_loop import best_decisions

    got = best_decisions(inputs.messages(spark, sf), inputs.DAY, inputs.DAY)
    expected = selection.best_by_mean(windows.window_scores(inputs.updates(spark, sf), inputs.DAY, inputs.DAY))
    assert sorted(map(str, got.collect())) == sorted(map(str, expected.collect()))


def test_ticks_floor_before_the_epoch(spark):
    df = spark.sql("select timestamp_seconds(-1) as ts").select(tick_of("ts", 60).alias("b"))
    assert df.first().b == -1
