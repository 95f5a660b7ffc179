"""Draws and assignments."""

from __future__ import annotations

import hashlib

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import keyed_draw
from sessionloom.operators import assignment
from sessionloom.operators.lookup import fits_broadcast, lookup_join


def draw(key, m, name="", seed=42):
    return int(hashlib.md5(f"{key}:{seed}{name}".encode()).hexdigest()[:8], 16) % m


def test_draws_are_fixed_by_key_and_name(spark):
    df = spark.range(200).select("id", keyed_draw(F.col("id"), 7, "x").alias("d"), keyed_draw(F.col("id"), 0, "x").alias("z"))
    rows = df.repartition(5).collect()
    assert all(r.d == draw(r.id, 7, "x") and r.z is None for r in rows)


def sessions(spark, n=300):
    types = F.array(*map(F.lit, "abc"))
    return spark.range(n).select(F.col("id").alias("event_id"), (F.col("id") % 3).cast("string").alias("group_id"), types.alias("candidates"))


def test_uniform_falls_back_to_the_candidates(spark):
    picks = spark.createDataFrame([("0", ["a", "b"]), ("1", ["x"])], "group_id string, picks array<string>")
    rows = assignment.assign_uniform(sessions(spark), picks).collect()
    for r in rows:
        fallback = "abc"[draw(r.event_id, 3, "fallback")]
        expected = {"0": ["a", "b"][draw(r.event_id, 2, "pick")]}.get(r.group_id, fallback)
        assert r.decision == expected


@pytest.mark.parametrize("mode", ["explore", "exploit"])
def test_epsilon_modes(spark, mode):
    best = spark.createDataFrame(
        [("0", "a", ["b", "x"], 0.3), ("1", "b", [], 1.0)], "group_id string, best string, others array<string>, epsilon double"
    )
    for r in assignment.assign_epsilon(sessions(spark), best, mode=mode).collect():
        percent, fallback = draw(r.event_id, 101, "explore"), "abc"[draw(r.event_id, 3, "fallback")]
        if r.group_id == "2":
            expected = None if mode == "explore" else fallback
        elif r.group_id == "1":
            expected = "b"
        else:
            other = percent < 30 if mode == "explore" else percent > 30
            expected = ["b", "x"][draw(r.event_id, 2, "pick")] if other else "a"
            if mode == "exploit" and expected == "x":
                expected = fallback
        assert r.decision == expected


def test_weighted_takes_the_last_when_none_is_reached(spark):
    weights = spark.createDataFrame([("0", 1, "a", 0.2), ("0", 2, "z", 0.1)], "group_id string, ord int, decision string, p double")
    stored = spark.createDataFrame([("1", "kept")], "group_id string, default_decision string")
    df = sessions(spark).withColumn("matched", F.col("group_id") == "0")
    for r in assignment.assign_weighted(df, weights, stored=stored).collect():
        expected = {"0": "a" if draw(r.event_id, 101, "weight") <= 20 else "z", "1": "kept"}.get(r.group_id)
        assert r.decision == expected


@pytest.mark.parametrize("limit", [0, 1 << 20])
@pytest.mark.parametrize("how", ["left", "inner"])
def test_lookup_is_the_same_with_and_without_broadcast(spark, limit, how):
    # A third of all facts share one key.
    facts = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"))
    table = spark.range(0, 3000, 2).select(F.col("id").alias("k"), (F.col("id") * 10).alias("v"))
    got = lookup_join(facts, table, ["k"], how, limit)
    plan = got._jdf.queryExecution().toString()
    assert ("ResolvedHint" in plan or "broadcast" in plan) == fits_broadcast(table, limit) or not limit
    rows = {(r.id, r.v) for r in got.collect()}
    key = {i: 0 if i % 3 == 0 else i for i in range(3000)}
    expected = {(i, k * 10 if k % 2 == 0 else None) for i, k in key.items()}
    assert rows == {r for r in expected if how == "left" or r[1] is not None}


def test_broadcast_size_is_measured(spark):
    table = spark.range(1000).select("id", F.lit("x" * 100).alias("text"))
    assert fits_broadcast(table, 1 << 20) and not fits_broadcast(table, 50_000)
    assert fits_broadcast(table.limit(0), 0)
