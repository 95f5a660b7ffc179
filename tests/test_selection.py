"""Picks against a plain replay of the rounds, and the fixed points of the rule."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import selection


def arms_of(spark, rows):
    return spark.createDataFrame(rows, "group_id string, decision string, s double, n double")


def replay(arms: dict[str, tuple[float, float]], gamma: float, k: int, scale: float) -> list[str]:
    means = {d: s / n if n > 0 else 0.0 for d, (s, n) in arms.items()}
    pulls = {d: n for d, (_, n) in arms.items()}
    total = sum(math.floor(n) for n in pulls.values())
    picks = []
    for _ in range(k):
        bonus = scale * math.sqrt(2 * math.log(total)) if total > 1 else 0.0
        score = {d: means[d] + bonus / math.sqrt(pulls[d]) if pulls[d] > 0 else 0.0 for d in arms}
        best = min(d for d in arms if score[d] == max(score.values()))
        picks.append(best)
        pulls[best] += 1
        total += 1
        pulls = {d: n * gamma for d, n in pulls.items()}
    return picks


@pytest.mark.parametrize("gamma", [0.0, 0.5, 0.98, 1.0])
@pytest.mark.parametrize("scale", [0.0, 1.0, 1000.0])
def test_picks_equal_replay(spark, gamma, scale):
    rng = random.Random(1)
    groups = {
        f"g{i}": {f"d{j}": (-rng.random() * 50, rng.choice([0.0, 0.4, 1.0, rng.random() * 30])) for j in range(rng.randint(1, 6))}
        for i in range(12)
    }
    rows = [(g, d, s, n) for g, arms in groups.items() for d, (s, n) in arms.items()]
    got = {r.group_id: r.picks for r in selection.ucb_picks(arms_of(spark, rows), gamma, 15, scale).collect()}
    assert got == {g: replay(arms, gamma, 15, scale) for g, arms in groups.items()}


def test_total_adds_whole_parts_only(spark):
    # 0.9 + 0.9 would be above 1, whole parts add to 0: no bonus in the first round.
    rows = [("g", "a", -9.0, 0.9), ("g", "b", -0.9, 0.9)]
    assert selection.ucb_picks(arms_of(spark, rows), 1.0, 1).first().picks == ["b"]


def test_arm_without_pulls_beats_negative_means(spark):
    rows = [("g", "a", -1.0, 1.0), ("g", "b", 0.0, 0.0)]
    assert selection.ucb_picks(arms_of(spark, rows), 1.0, 1).first().picks == ["b"]


def test_smaller_name_wins_a_tie(spark):
    rows = [("g", "b", -4.0, 2.0), ("g", "a", -2.0, 1.0), ("g", "c", -8.0, 4.0)]
    assert selection.ucb_picks(arms_of(spark, rows), 1.0, 1, scale=0.0).first().picks == ["a"]
    scores = arms_of(spark, rows).withColumn("w_end", F.timestamp_seconds(F.lit(0)))
    best = selection.best_by_mean(scores).first()
    assert (best.best, best.others) == ("a", ["b", "c"])


def test_single_decision_has_no_others(spark):
    scores = arms_of(spark, [("g", "a", -1.0, 1.0)]).withColumn("w_end", F.timestamp_seconds(F.lit(0)))
    assert selection.best_by_mean(scores).first().others == []


def test_shares_add_to_one(spark):
    rows = [("g", d, -1.0, float(n)) for n, d in enumerate("abc", 1)]
    shares = selection.pick_shares(selection.ucb_picks(arms_of(spark, rows), 0.9, 8)).collect()
    assert sum(r.share for r in shares) == pytest.approx(1.0)
