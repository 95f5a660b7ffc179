"""Running loops: late rows, silent groups, lost drivers, versions of rules and assignments."""

from __future__ import annotations

import datetime as dt
import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from sessionloom import streaming
from sessionloom.operators import exchange, selection, versions
from sessionloom.plans import decision_loop as loop
from sessionloom.plans.replay import replay
from sessionloom.session import fresh_path
from sessionloom.sources import BatchOutputs, LatestStore

NOW = {"availableNow": True}
TICK = 60


def batches_of(spark, batches, schema):
    """A stream that gets one batch after the other."""
    rows = [(i, *row) for i, batch in enumerate(batches) for row in batch]
    df = spark.createDataFrame(rows, f"nth int, {schema}").coalesce(1)
    # The number of the batch is its time of arrival; rows keep their own time.
    stamped = df.withColumn("event", F.col("ts")).withColumn("ts", F.timestamp_seconds(F.col("nth")))
    return replay(stamped, slices=len(batches), key="nth").withColumn("ts", F.col("event"))


def at(tick, second=0):
    return dt.datetime.fromtimestamp(tick * TICK + second, dt.timezone.utc)


def reports(spark, batches):
    """Messages from (tick, second, group, decision, cost) rows by batch."""
    rows = [[(at(t, s), f'{{"update":"{d}\\t{c}","group_id":"{g}"}}') for t, s, g, d, c in batch] for batch in batches]
    return batches_of(spark, rows, "ts timestamp, value string")


def decayed(rows, gamma, last):
    """State of (tick, group, decision, cost) rows at a tick."""
    out = defaultdict(lambda: [0.0, 0.0])
    for t, g, d, c in rows:
        out[g, d][0] -= c * gamma ** (last - t)
        out[g, d][1] += gamma ** (last - t)
    return {k: tuple(v) for k, v in out.items()}


@pytest.mark.parametrize("late_by", [3, 50])
def test_late_rows_count_once_or_not_at_all(spark, late_by):
    """Rows up to the delay late are counted, in folded chunks too; rows of closed chunks are dropped, never added twice."""
    draw, gamma, delay_ticks = random.Random(late_by), 0.9, 4
    batches, kept, newest = [], [], []
    for nth in range(12):
        batch = []
        for _ in range(20):
            # Late rows come after the first batches, so that there is something to be late for.
            late = draw.randint(0, late_by) if nth > 2 and draw.random() < 0.4 else 0
            batch.append((max(0, 100 + 5 * nth + draw.randint(0, 4) - late), draw.randint(0, 59), f"g{draw.randint(0, 2)}", f"d{draw.randint(0, 2)}", draw.randint(1, 9)))
        # A row is let through unless its chunk of two ticks had ended by the watermark of the batch before the last.
        mark = max(newest[: max(0, nth - 1)], default=-(10**9)) - delay_ticks * TICK
        kept += [(t, g, d, c) for t, s, g, d, c in batch if (t // 2 * 2 + 2) * TICK > mark]
        newest.append(max([*newest[-1:], *(t * TICK + s for t, s, *_ in batch)]))
        batches.append(batch)
    root, mark = fresh_path(spark, "state"), fresh_path(spark, "mark")
    loop.decision_stream(
        reports(spark, batches), root, mark, lambda df, i: None, gamma, 3, TICK, trigger=NOW, delay_seconds=delay_ticks * TICK, chunk_cap=2
    ).awaitTermination()
    stored = LatestStore(spark, root, loop.STATE_KEYS).read()
    got = {(r.group_id, r.decision): (r.s, r.n) for r in loop.chunk_state(stored, gamma).collect()}
    want = decayed(kept, gamma, max(t for t, *_ in kept))
    assert got.keys() == want.keys()
    for key, value in want.items():
        assert got[key] == pytest.approx(value, rel=1e-9)
    assert (len(kept) < 240) == (late_by == 50)
    # Of 30 chunks a key keeps one folded row and those that the delay and two batches of five ticks have room for.
    assert stored.groupBy("group_id", "decision").count().agg(F.max("count")).first()[0] <= 1 + (delay_ticks + 10) / 2 + 1
    assert stored.filter("slot IS NULL").count() == len(want)


def test_silent_groups_get_their_random_tick(spark):
    """Group b reports once; its ticks go on to the end of the epoch, which is random, and then it sleeps."""
    every, gamma = 5, 0.5
    batches = [[(0, 1, "a", "x", 4.0), (1, 1, "b", "y", 2.0)], [(2, 5, "a", "x", 1.0)], [(9, 5, "a", "z", 3.0)], [(12, 0, "b", "y", 8.0), (16, 1, "a", "x", 1.0)], [(30, 0, "a", "x", 1.0)]]
    sent = []
    loop.reset_stream(
        reports(spark, batches), fresh_path(spark, "mark"), lambda df, i: sent.extend(tuple(r) for r in df.collect()), gamma, 2, 0, TICK, every, "edge", NOW, delay_seconds=0
    ).awaitTermination()
    words = {(b, v.split(";")[0]): v.split(";")[1] for b, v in sent}
    assert len(words) == len(sent)
    by_group = {g: sorted(b for b, group in words if group == g) for g in "ab"}
    # a: epochs 0-4, 5-9 (from its row in 9 on), 15-19; b: 1-4, and 12-14 of the third epoch.
    assert by_group == {"a": [0, 1, 2, 3, 4, 9, 16, 17, 18, 19], "b": [1, 2, 3, 4, 12, 13, 14]}
    assert {k: w for k, w in words.items() if k[0] % every == every - 1} == {(b, g): "random" for g in "ab" for b in by_group[g] if b % every == every - 1}
    assert words[3, "b"] == "y:y:" and words[9, "a"] == "random"


def test_a_reset_loop_goes_on_after_a_restart(spark):
    batches = [[(t, 0, "g", "d", float(t + 1))] for t in range(8)]
    whole, parts = [], []
    loop.reset_stream(reports(spark, batches), fresh_path(spark, "mark"), lambda df, i: whole.extend(tuple(r) for r in df.collect()), 0.9, 2, 0, TICK, 3, "", NOW, 0).awaitTermination()
    path, mark = fresh_path(spark, "arriving"), fresh_path(spark, "mark")
    schema = "ts timestamp, value string"
    for t in range(8):
        spark.createDataFrame([(at(t), f'{{"update":"d\\t{float(t + 1)}","group_id":"g"}}')], schema).write.mode("append").parquet(path)
        stream = spark.readStream.schema(schema).parquet(path)
        loop.reset_stream(stream, mark, lambda df, i: parts.extend(tuple(r) for r in df.collect()), 0.9, 2, 0, TICK, 3, "", NOW, 0).awaitTermination()
    assert sorted(parts) == sorted(whole) and [b for b, _ in sorted(whole)] == list(range(7))


def test_decisions_stay_in_force_while_a_group_is_silent(spark):
    batches = [[(0, 1, "a", "x", 4.0), (0, 2, "b", "y", 1.0)], [(1, 1, "a", "x", 4.0), (1, 2, "a", "z", 1.0)], [(4, 0, "a", "x", 1.0)], [(9, 0, "c", "x", 1.0)], [(20, 0, "c", "x", 1.0)]]
    sent = []
    loop.epsilon_stream(
        reports(spark, batches), fresh_path(spark, "state"), fresh_path(spark, "mark"),
        lambda df, i: sent.extend((r.group_id, r.tick // TICK, r.w_end // TICK, r.value.split('"best":"')[1][0]) for r in df.collect()), 0.1, 2 * TICK, TICK, "", NOW, 0,
    ).awaitTermination()
    assert len(sent) == len({s[:2] for s in sent})
    in_force = {s[:2]: s[2:] for s in sent}
    # Windows of two ticks end every tick; the last one with rows that closes is that of tick 9, at 11.
    assert {t for g, t in in_force if g == "b"} == set(range(1, 12)) and in_force["b", 11] == (2, "y")
    assert [in_force["a", t] for t in range(1, 8)] == [(1, "x"), (2, "z"), (3, "z"), (3, "z"), (5, "x"), (6, "x"), (6, "x")]
    assert in_force["c", 11] == (11, "x") and ("c", 9) not in in_force


def test_an_epsilon_loop_keeps_panes_not_windows(spark):
    """Restarted after every batch it publishes what one run and the windows of the table give; its state is one row per open pane."""
    draw = random.Random(8)
    batches = [[(b + draw.randint(0, 3), draw.randint(0, TICK - 1), draw.choice("abc"), draw.choice("xyz"), float(draw.randint(1, 9))) for _ in range(12)] for b in range(0, 12, 3)]
    whole, parts = [], []

    def run(stream, mark, state, sent):
        query = loop.epsilon_stream(stream, state, mark, lambda df, i: sent.extend(tuple(r) for r in df.select("group_id", "tick", "w_end", "value").collect()), 0.1, 6 * TICK, TICK, "", NOW, 2 * TICK)
        query.awaitTermination()
        return query.recentProgress

    progress = run(reports(spark, batches), fresh_path(spark, "mark"), fresh_path(spark, "state"), whole)
    held = [[o["numRowsTotal"] for o in p["stateOperators"]] for p in progress]
    assert {len(h) for h in held} == {1} and 0 < max(h[0] for h in held) <= 3 * 3 * 6
    path, mark, state = (fresh_path(spark, n) for n in ("arriving", "mark", "state"))
    schema = "ts timestamp, value string"
    for rows in batches:
        spark.createDataFrame([(at(t, s), f'{{"update":"{d}\\t{c}","group_id":"{g}"}}') for t, s, g, d, c in rows], schema).write.mode("append").parquet(path)
        run(spark.readStream.schema(schema).parquet(path), mark, state, parts)
    assert sorted(parts) == sorted(whole) and len({w[:2] for w in whole}) == len(whole)
    last = (max(at(t, s) for rows in batches for t, s, *_ in rows).timestamp() - 2 * TICK) // TICK * TICK
    scores = defaultdict(lambda: [0.0, 0])
    for t, s, g, d, c in (r for rows in batches for r in rows):
        for end in range(int(at(t).timestamp()) + TICK, int(at(t).timestamp()) + 7 * TICK, TICK):
            scores[g, end, d][0] -= c
            scores[g, end, d][1] += 1
    best = {(g, e): min((-v / n, d) for (h, f, d), (v, n) in scores.items() if (h, f) == (g, e))[1] for g, e, _ in scores if e <= last}
    assert best == {(g, w): v.split('"best":"')[1][0] for g, t, w, v in whole}


def test_carried_ticks(spark):
    rows = spark.createDataFrame([("g", 10, "a"), ("g", 16, "b"), ("h", 2, "c")], "group_id string, w_end long, v string")
    got = selection.carry_forward(rows, F.lit(12).cast("long"), F.lit(18).cast("long"), 2).collect()
    assert sorted((r.group_id, r.tick, r.v) for r in got) == [("g", 12, "a"), ("g", 14, "a"), ("g", 16, "b"), ("g", 18, "b"), *[("h", t, "c") for t in (12, 14, 16, 18)]]


class Lost(Exception):
    pass


def test_first_clusters_are_folded_by_hash(spark):
    """The cluster of the first record of each tick and group, one without a number first; records are not sorted for it."""
    draw = random.Random(6)
    rows = [(draw.randint(0, 2), draw.choice("gh"), f"c{draw.randint(0, 4)}", n) for n in draw.sample(range(1000), 200)] + [(7, "g", "c9", None), (7, "g", "c1", 1)]
    df = spark.createDataFrame(rows, "b long, group_id string, cluster_id string, key long")
    got = exchange.forward_subscriptions(df, "me", ("key",))
    want = {}
    for b, g, c, n in sorted(rows, key=lambda r: (r[3] is not None, r[3] or 0)):
        want.setdefault((b, f"{g};me"), c)
    assert {(r.b, r.value): r.cluster_id for r in got.collect()} == want
    assert "HashAggregate(keys=[b" in got._jdf.queryExecution().executedPlan().toString()


def exchange_batches(spark):
    def update(g, c):
        return f'{{"update":"d\\t1","group_id":"{g}","cluster_id":"{c}"}}'

    batches = [
        [("subscribe", 1, at(0), "g;far"), ("subscribe", 2, at(0), "g;me"), ("subscribe", 3, at(0), "g;gone"), ("subscribe", 4, at(0), "broken"), ("upload", 5, at(0), "f0\tf1\td\t1")],
        [("decision", 6, at(1), "g;x:y:;From: me"), ("decision", 7, at(0), "g;early:;From: me"), ("subscribe", 8, at(1), "g;late")],
        [("forward", 9, at(2), update("h", "far")), ("forward", 10, at(2), update("h", "near")), ("forward", 11, at(2), update("i", "gone")), ("forward", 12, at(2), "no json")],
        [("decision", 13, at(3), "g;z:;From: me"), ("subscribe", 14, at(3), "g;far")],
    ]
    return batches_of(spark, batches, "kind string, key long, ts timestamp, value string")


WANT = {
    "upload": [("backend", "upload", "f0\tf1\td\t1")],
    "sample": [("backend", "sample", "0;f0;1"), ("backend", "sample", "1;f1;1")],
    "push": [("far", "decision", "g;x:y:;From: me"), ("far", "decision", "g;z:;From: me"), ("late", "decision", "g;z:;From: me")],
    "forward": [("far", "internal_groups", "h"), ("near", "internal_groups", "h")],
    "subscribe": [("far", "subscribe", "h;me")],
    "unlisted": [("gone", "decision", "g;x:y:;From: me"), ("gone", "decision", "g;z:;From: me"), ("gone", "internal_groups", "i"), ("gone", "subscribe", "i;me")],
}


@pytest.mark.parametrize("lost_at", [None, "sample", "push", "unlisted"])
def test_an_exchange_publishes_once(spark, lost_at):
    """Whatever output the driver is lost before, a restart completes the batch and repeats nothing."""
    out, state, mark = (fresh_path(spark, n) for n in ("out", "state", "mark"))
    messages, writes, broken = exchange_batches(spark), [], [lost_at] * 2

    def publisher(name):
        def write(df, output, batch):
            if broken and broken[0] == name and batch >= 1:
                broken.pop()
                raise Lost(name)
            writes.append((name, batch))
            BatchOutputs(spark, out)._store(df, output, batch)

        return write

    publishers = {name: publisher(name) for name in (*WANT, "alive")}

    def run():
        streaming.exchange_stream(messages, out, state, mark, "me", ["me", "far", "near", "late"], TICK, 1.0, publishers, NOW).awaitTermination()

    for _ in range(2 if lost_at else 0):
        with pytest.raises(Exception, match="Lost"):
            run()
    run()
    assert len(writes) == len(set(writes))
    outputs = BatchOutputs(spark, out)
    for name, want in WANT.items():
        rows = outputs.read(name).collect()
        short = [(r.cluster_id, r.topic, r.value if r.topic != "internal_groups" else r.value.split('group_id":"')[1][0]) for r in rows]
        assert sorted(short) == want, name
    alive = outputs.read("alive").collect()
    assert len(alive) == len(outputs.committed()) and {r.value for r in alive} == {"me"}
    with pytest.raises(Exception, match="fresh checkpoint"):
        streaming.exchange_stream(messages, out, fresh_path(spark, "s"), fresh_path(spark, "m"), "me", [], trigger=NOW).awaitTermination()


def test_outputs_read_only_what_is_marked(spark):
    outputs = BatchOutputs(spark, fresh_path(spark, "out"), "me")
    one = spark.createDataFrame([(1,)], "v int")
    assert outputs.read("x") is None and outputs.publish(0, {"x": one, "y": one}) == ["x", "y"]
    outputs._store(one, "x", 1)
    assert outputs.read("x").count() == 1 and outputs.publish(0, {"x": one}) == [] and outputs.committed() == [0]
    assert outputs.publish(1, {"x": one}) == ["x"] and outputs.read("x").count() == 2


def test_ingest_follows_assignments_read_anew(spark):
    schema = "update string, group_id string, ok boolean, ts timestamp"
    record = "\t".join(["f"] * 15 + ["d", "1"])
    records = batches_of(spark, [[(record, "g", True, at(1)), ("x", None, False, at(1))], [(record, "g", True, at(5))]], schema)
    message = '{"GroupAssignment":[{"GroupName":"g","Cluster":"%s"}]}'
    known = [[(1, at(0), message % "me")], [(1, at(0), message % "me"), (2, at(3), message % "far")]]
    asked = []

    def assignments():
        asked.append(1)
        return spark.createDataFrame(known[len(asked) - 1], "offset long, since timestamp, value string")

    out = fresh_path(spark, "out")
    streaming.ingest_stream(records, assignments, out, fresh_path(spark, "mark"), "me", "since", trigger=NOW).awaitTermination()
    outputs = BatchOutputs(spark, out)
    assert [outputs.read(t).count() for t in ("upload", "internal_groups", "external_groups", "rejected")] == [2, 1, 1, 1]
    assert '"cluster_id":"far"' in outputs.read("external_groups").first().value


@pytest.mark.parametrize("limit_bytes", [0, 1 << 20])
def test_versions_in_force(spark, limit_bytes, monkeypatch):
    draw = random.Random(3)
    times = [draw.randint(0, 5_000) for _ in range(150)]
    changes = [(draw.choice(["a", "b", "c", None]), at(0, t), draw.randint(0, 3), i) for i, t in enumerate(times)] + [("a", None, 9, 999)]
    records = [(i, draw.choice(["a", "b", "c", "d", None]), None if i == 5 else at(0, draw.choice([draw.randint(-50, 6_000), draw.choice(times)]))) for i in range(400)]
    monkeypatch.setattr(versions, "LEAST_BINS", 7)
    table = spark.createDataFrame(changes, "k string, since timestamp, v int, n int")
    got = versions.in_force(spark.createDataFrame(records, "id int, k string, ts timestamp"), table, ["k"], "since", "ts", ["n"], limit_bytes)
    want = {}
    for i, k, t in records:
        held = [(s, n, v) for key, s, v, n in changes if k is not None and key == k and t is not None and s is not None and s <= t]
        want[i] = max(held)[2] if held else None
    rows = got.collect()
    assert len(rows) == 400 and {r.id: r.v for r in rows} == want
    empty = versions.in_force(spark.createDataFrame(records, "id int, k string, ts timestamp"), table.limit(0), ["k"], "since")
    assert empty.filter("v IS NOT NULL").count() == 0 and empty.count() == 400


def test_rules_of_the_time(spark):
    old = {"Field": "0", "Table": [{"Key": "x", "Rule": {"GroupName": "old"}}]}
    new = {"Field": "0", "Table": [{"Key": "x", "Rule": {"GroupName": "new"}}, {"Key": "x", "Rule": {"Field": "1", "Table": [{"Key": "y", "Rule": {"GroupName": "newer"}}]}}]}
    rows = spark.createDataFrame([(at(0, s), [a, b, "", "", "asn"]) for s in (5, 10, 19, 20, 99) for a, b in (("x", "y"), ("x", "n"), ("n", "n"))], "ts timestamp, features array<string>")
    for paths in (64, 0):
        got = versions.match_groups_at(rows, [(20, new), (10, {"GroupName": "replaced"}), (10, old)], expression_paths=paths)
        by_second = defaultdict(list)
        for r in got.collect():
            by_second[int(r.ts.timestamp()) % 100].append(r.group_id)
        assert by_second == {5: ["asn"] * 3, 10: ["old", "old", "asn"], 19: ["old", "old", "asn"], 20: ["newer", "new", "asn"], 99: ["newer", "new", "asn"]}
