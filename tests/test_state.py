"""Decay, reset, windows: properties and hand-worked cases."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import selection, state, windows
from sessionloom.plans import inputs
from sessionloom.streaming import epoch_state, stream_reset


def sums_of(spark, rows):
    return spark.createDataFrame(rows, "group_id string, decision string, b bigint, s double, n double")


def random_sums(seed: int, ticks: int, arms: int = 3):
    rng = random.Random(seed)
    rows = []
    for arm in range(arms):
        for b in sorted(rng.sample(range(ticks), max(2, ticks // 5))):
            rows.append(("g", f"d{arm}", b + 1000, -rng.random() * 100, float(rng.randint(1, 5))))
    return rows


def replay(rows, gamma, last):
    """Tick by tick: decay everything, add the tick's sums."""
    now, out = {}, {}
    by_tick = {}
    for g, d, b, s, n in rows:
        by_tick.setdefault(b, []).append((g, d, s, n))
    for b in range(min(by_tick), last + 1):
        now = {key: (s * gamma, n * gamma) for key, (s, n) in now.items()}
        for g, d, s, n in by_tick.get(b, []):
            old = now.get((g, d), (0.0, 0.0))
            now[g, d] = (old[0] + s, old[1] + n)
        out.update({(g, d, b): value for (g, d), value in now.items()})
    return out


def assert_close(got: dict, expected: dict):
    assert got.keys() == expected.keys()
    for key, value in expected.items():
        assert got[key] == pytest.approx(value, rel=1e-9, abs=1e-9), key


@pytest.mark.parametrize("gamma", [0.0, 0.3, 0.9, 0.9999, 1.0])
@pytest.mark.parametrize("cap", [1, 7, 1 << 16])
def test_history_equals_replay(spark, gamma, cap):
    rows = random_sums(7, 60)
    last = max(r[2] for r in rows) + 5
    df = state.discounted_history(sums_of(spark, rows), gamma, at=last, chunk_cap=cap)
    got = {(r.group_id, r.decision, r.b): (r.s, r.n) for r in df.collect()}
    assert_close(got, replay(rows, gamma, last))


def test_history_survives_small_gamma_over_many_ticks(spark):
    rows = [("g", "a", 0, -5.0, 1.0), ("g", "a", 2000, -3.0, 1.0)]
    df = state.discounted_history(sums_of(spark, rows), 0.5)
    got = {r.b: (r.s, r.n) for r in df.collect()}
    assert len(got) == 2001
    assert got[2000] == pytest.approx((-3.0, 1.0)) and got[10] == pytest.approx((-5 * 0.5**10, 0.5**10))
    assert got[1000][0] == pytest.approx(-5 * 0.5**1000, rel=1e-9)


def test_history_since_keeps_earlier_sums(spark):
    sums = sums_of(spark, random_sums(3, 40))
    full = {tuple(r) for r in state.discounted_history(sums, 0.9).collect() if r.b >= 1020}
    part = {tuple(r) for r in state.discounted_history(sums, 0.9, since=1020).collect()}
    assert part == full


@pytest.mark.parametrize("gamma", [0.0, 0.3, 0.97, 1.0])
def test_latest_is_the_end_of_the_history(spark, gamma):
    sums = sums_of(spark, random_sums(11, 50))
    latest = {(r.group_id, r.decision): (r.s, r.n) for r in state.discounted_latest(sums, gamma).collect()}
    last = max(r.b for r in sums.collect())
    history = state.discounted_history(sums, gamma).filter(F.col("b") == last)
    assert_close(latest, {(r.group_id, r.decision): (r.s, r.n) for r in history.collect()})


@pytest.mark.parametrize("gamma", [0.0, 0.3, 0.97, 1.0])
@pytest.mark.parametrize("cap", [4, 1 << 16])
def test_chunk_sums_give_the_latest_state(spark, sf, gamma, cap):
    updates = inputs.updates(spark, sf)
    sums = state.bucket_sums(updates, inputs.DAY)
    chunks = state.chunk_sums(updates, gamma, inputs.DAY, chunk_cap=cap)
    got = {(r.group_id, r.decision): (r.s, r.n) for r in state.chunk_state(chunks, gamma).collect()}
    expected = state.discounted_latest(sums, gamma)
    assert_close(got, {(r.group_id, r.decision): (r.s, r.n) for r in expected.collect()})


def test_chunk_state_decays_idle_groups_to_a_later_tick(spark, sf):
    chunks = state.chunk_sums(inputs.updates(spark, sf), 0.5, inputs.DAY)
    now = {(r.group_id, r.decision): r for r in state.chunk_state(chunks, 0.5).collect()}
    last = next(iter(now.values())).b
    later = {(r.group_id, r.decision): r for r in state.chunk_state(chunks, 0.5, at=last + 3).collect()}
    for key, row in now.items():
        assert later[key].n == pytest.approx(row.n / 8) and later[key].s == pytest.approx(row.s / 8)


def test_merging_ticks_one_by_one_equals_latest(spark):
    rows = random_sums(5, 6)
    sums = sums_of(spark, rows)
    merged = None
    for b in range(min(r[2] for r in rows), max(r[2] for r in rows) + 1):
        new = sums.filter(F.col("b") == b)
        merged = new if merged is None else state.merge_state(merged, new, 0.8)
    got = {(r.group_id, r.decision): (r.s, r.n) for r in merged.collect()}
    expected = state.discounted_latest(sums, 0.8)
    assert_close(got, {(r.group_id, r.decision): (r.s, r.n) for r in expected.collect()})


def test_reset_starts_anew_after_every_third_tick(spark):
    rows = [("g", "a", b, -1.0, 1.0) for b in range(10, 18)]
    df = state.discounted_reset(sums_of(spark, rows), 0.5, every=3)
    got = {r.b: (r.k, r.epoch, r.reset, r.n) for r in df.collect()}
    assert [got[b][0] for b in range(10, 18)] == list(range(1, 9))
    assert [got[b][2] for b in range(10, 18)] == [False, False, True, False, False, True, False, False]
    assert [got[b][3] for b in range(10, 16)] == [1.0, 1.5, 1.75, 1.0, 1.5, 1.75]


def test_reset_forgets_idle_keys_in_the_next_epoch(spark):
    rows = [("g", "a", 0, -1.0, 1.0), ("g", "b", 4, -1.0, 1.0)]
    df = state.discounted_reset(sums_of(spark, rows), 0.5, every=3)
    got = {(r.decision, r.b): r.n for r in df.collect()}
    assert got == {("a", 0): 1.0, ("a", 1): 0.5, ("a", 2): 0.25, ("b", 4): 1.0}


@pytest.mark.parametrize("gamma", [0.0, 1e-60, 0.7, 1.0])
def test_reset_chunks_equal_the_series(spark, sf, gamma):
    updates = inputs.updates(spark, sf)
    sums = state.bucket_sums(updates, inputs.DAY)
    origin = 19_720
    series = state.discounted_reset(sums, gamma, origin=origin, every=11)
    last = sums.agg(F.max("b")).first()[0]
    expected = {(r.group_id, r.decision): (r.s, r.n) for r in series.filter(F.col("b") == last).collect()}
    chunks = stream_reset(updates, gamma, inputs.DAY, origin, every=11)
    got = epoch_state(chunks, gamma, origin, every=11)
    assert_close({(r.group_id, r.decision): (r.s, r.n) for r in got.collect()}, expected)


def test_reset_picks_say_random_on_reset_ticks(spark):
    rows = [("g", "a", b, -1.0, 1.0) for b in range(1, 31)]
    picks = selection.reset_picks(state.discounted_reset(sums_of(spark, rows), 0.9), 0.9, 2)
    got = {r.k: r.picks for r in picks.collect()}
    assert [k for k, p in got.items() if p == ["random"]] == [15, 30]
    assert got[14] == ["a", "a"]


def test_panes_equal_plain_windows(spark, sf):
    updates = inputs.updates(spark, sf)
    panes = windows.window_scores(updates, inputs.DAY, 2 * inputs.HOUR)
    plain = updates.groupBy(
        "group_id", "decision", F.window("ts", f"{inputs.DAY} seconds", f"{2 * inputs.HOUR} seconds").alias("w")
    ).agg(F.sum("reward").cast("double").alias("s"), F.count(F.lit(1)).alias("n"))
    got = {(r.group_id, r.decision, r.w_end): (round(r.s, 4), r.n) for r in panes.collect()}
    expected = {(r.group_id, r.decision, r.w.end): (round(r.s, 4), r.n) for r in plain.collect()}
    assert got == expected


def test_window_length_has_to_be_whole_slides():
    with pytest.raises(ValueError):
        windows.panes_per_window(60, 7)


@pytest.mark.parametrize("gamma", [0.0, 1e-200, 0.5, 0.99999, 1.0])
def test_carried_chunks_are_linear_and_exact(spark, gamma):
    """Sums of many chunks carried in two levels; blocks of five chunks, so that there are many of both."""
    h, chunks = 3, 400
    rows = [("g", "d", c, float(c % 7) - 2.0, 1.0 + c % 3) for c in range(chunks) if c % 4 != 1] + [("h", "d", c, 1.0, 1.0) for c in (5, 399)]
    ends = spark.createDataFrame(rows, "group_id string, decision string, _c long, _es double, _en double")
    spine = spark.createDataFrame([(g, "d", c, first * h) for g, first in (("g", 0), ("h", 5)) for c in range(first, chunks)], "group_id string, decision string, _c long, _b0 long")
    got = {(r.group_id, r._c): (r._cs, r._cn) for r in state.carried_chunks(ends, spine, state.KEYS, gamma, h, cap=5).collect()}
    totals = {(g, c): (s, n) for g, _, c, s, n in rows}
    assert len(got) == chunks + chunks - 5
    for g, first in (("g", 0), ("h", 5)):
        s = n = 0.0
        for c in range(first, chunks):
            assert got[g, c] == pytest.approx((s, n) if gamma else (0.0, 0.0), rel=1e-9, abs=1e-9)
            own = totals.get((g, c), (0.0, 0.0))
            # At the start of the next chunk: all of this one, and what came before decayed by it.
            s, n = own[0] + s * gamma**h, own[1] + n * gamma**h


def test_blocks_are_copied_where_they_count(spark):
    blocks = spark.range(300).select(F.lit("g").alias("group_id"), F.lit("d").alias("decision"), F.col("id").alias("_k"), F.lit(1.0).alias("_es"), F.lit(1.0).alias("_en"))

    def copies(q, size):
        plan = state.block_copies(blocks, state.KEYS, q, size)
        return plan.count(), plan.agg(F.max("_en")).first()[0]

    # Nothing decays: one sum for each later block. Otherwise a block reaches a few others only.
    assert copies(1.0, 1 << 16) == (299, 299.0)
    count, most = copies(0.99999**65536, 351)
    assert count == 299 and most == pytest.approx(1.0, rel=1e-6)


def test_history_at_slow_decay_equals_the_sum_of_all(spark):
    rows = [("g", "d", b, 1.0, 1.0) for b in range(0, 900, 7)]
    sums = spark.createDataFrame(rows, "group_id string, decision string, b long, s double, n double")
    for gamma in (0.99999, 1.0):
        got = {r.b: r.n for r in state.discounted_history(sums, gamma, chunk_cap=4).collect()}
        n = 0.0
        for b in range(0, 897):
            n = n * gamma + (b % 7 == 0)
            assert got[b] == pytest.approx(n, rel=1e-9)


@pytest.mark.parametrize("name", ["discounted_latest", "discounted_history", "discounted_reset", "state_merge", "push_decisions", "cluster_heartbeat"])
def test_reports_are_read_once(spark, sf, name):
    """The report table is summed and stored first; the plan of the result reads what was stored."""
    from sessionloom.plans import catalog

    catalog.load()
    plan = catalog.QUERIES[name](spark, sf)._jdf.queryExecution().toString()
    # What the query itself still scans after it has stored its sums.
    assert "events.parquet" not in plan[plan.index("== Physical Plan"):]
