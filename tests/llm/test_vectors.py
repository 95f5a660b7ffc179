"""Exact search and hard negatives against brute force, with ties, repeats, odd vectors and every way a score is summed."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from sessionloom.llm import hard_negatives, topk_search, vector_tiles
from sessionloom.llm.vector_tiles import Found

SCHEMA = "vec_id long, embedding array<double>, label int, score string, tile string, known string"
BIG = 2**63 - 1


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", "clash", "clash") for r in rows], SCHEMA)


def scaled(vector):
    if vector is None or any(x is None or not math.isfinite(x) or not math.isfinite(256 * x) for x in vector):
        return None
    return [math.floor(256 * x) for x in vector]


def score(a, b):
    return min(max(sum(x * y for x, y in zip(a, b, strict=False)), -BIG - 1), BIG)


def ranked(rows):
    return sorted(rows, key=lambda r: (-r[0], r[1] is None, r[1] or 0))


def brute_top(rows, every, keep):
    some = [(i, scaled(v)) for i, v, _ in rows if scaled(v) is not None]
    out = []
    for k, (i, v) in enumerate(some):
        if i is not None and i % every == 0:
            best = ranked([(score(v, w), j) for m, (j, w) in enumerate(some) if m != k])[:keep]
            out += [(i, rank, j, s) for rank, (s, j) in enumerate(best, 1)]
    return out


def brute_hard(rows, every, n_pos, n_neg, low, high):
    some = [(i, scaled(v), label) for i, v, label in rows if scaled(v) is not None and label is not None]
    out = []
    for k, (i, v, label) in enumerate(some):
        if i is None or i % every:
            continue
        others = [(score(v, w), j, b) for m, (j, w, b) in enumerate(some) if m != k]
        negatives = ranked([o for o in others if o[2] != label])
        for p, j, _ in ranked([o for o in others if o[2] == label])[:n_pos]:
            hard = [o for o in negatives if low * p <= 100 * o[0] <= high * p][:n_neg]
            out += [(i, j, rank, b, p, s) for rank, (s, b, _) in enumerate(hard, 1)]
    return out


def in_order(rows):
    return sorted(map(tuple, rows), key=str)


def unit(draw, dim):
    v = [draw.gauss(0, 1) for _ in range(dim)]
    size = math.sqrt(sum(x * x for x in v))
    return [x / size for x in v]


def some_rows(seed, n, dim, labels, copies=0):
    draw = random.Random(seed)
    rows = [(i, unit(draw, dim), draw.randrange(labels)) for i in range(n)]
    # One vector many times over, under both labels, and vectors close to each other.
    rows += [(n + k, rows[0][1], k % 2) for k in range(copies)]
    rows += [(n + copies + k, [x + draw.gauss(0, 0.05) for x in rows[k][1]], draw.randrange(labels)) for k in range(n // 4)]
    return rows


ODD = [
    (None, [0.5, 0.5], 0), (None, [0.5, 0.5], 1), (0, None, 0), (0, [], 0), (5, [], 1), (10, [0.1, None], 0), (10, [float("nan"), 1.0], 0),
    (20, [float("inf"), 1.0], 1), (30, [1e308, 1.0], 0), (40, [0.25, -0.5], 0), (40, [0.25, -0.5], 0), (40, [0.25, -0.5], 1), (50, [0.0, 0.0], 0),
    (60, [1.0, 2.0, 3.0], 0), (61, [1.0, 2.0, 3.0], 1), (70, [-1.0, -1.0], None), (80, [-0.001, 0.001], 1), (90, [0.003, 0.003], 1), (-10, [0.2, 0.1], -3),
]
LARGE = [(10 * k, [(-1) ** k * 10.0 ** (3 * k), 1.0 + k, -(10.0**k)], k % 2) for k in range(1, 8)]


@pytest.mark.parametrize("rows", [some_rows(1, 120, 24, 3, copies=40), ODD, LARGE, [(0, [1.0], 0)], []], ids=["plain", "odd", "large", "one", "none"])
def test_search_equals_brute_force(spark, rows):
    for keep, query_rows in ((5, 7), (1, 1024)):
        found = topk_search.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, keep=keep, query_rows=query_rows)
        assert found.columns == ["query_id", "rank", "vec_id", "score"]
        assert in_order(found.collect()) == in_order(brute_top(rows, 10, keep))


@pytest.mark.parametrize("rows", [some_rows(2, 150, 24, 2, copies=60), some_rows(3, 90, 5, 40), ODD, LARGE, [(0, [1.0], 0)], []], ids=["hot", "labels", "odd", "large", "one", "none"])
def test_negatives_equal_brute_force(spark, rows):
    for low, high, anchor_rows in ((80, 100, 512), (20, 95, 3)):
        found = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, 4, 3, low, high, anchor_rows=anchor_rows)
        assert in_order(found.collect()) == in_order(brute_hard(rows, 10, 4, 3, low, high))


def test_groups_of_blocks_merge_as_a_tree(spark, monkeypatch):
    monkeypatch.setattr(vector_tiles, "ROWS", 4)
    monkeypatch.setattr(vector_tiles, "GROUP", 2)
    monkeypatch.setattr(vector_tiles, "FAN", 2)
    rows = some_rows(5, 80, 8, 3, copies=20)
    assert in_order(topk_search.top_k(table(spark, rows), F.col("vec_id") % 10 == 0, 3, query_rows=5).collect()) == in_order(brute_top(rows, 10, 3))
    found = hard_negatives.mine(table(spark, rows), F.col("vec_id") % 10 == 0, 3, 3, 50, 100, anchor_rows=5)
    assert in_order(found.collect()) == in_order(brute_hard(rows, 10, 3, 3, 50, 100))


def test_an_index_leaves_out_what_cannot_reach():
    draw = np.random.default_rng(4)
    rows = np.floor(256 * draw.normal(size=(300, 40)) * np.linspace(0.02, 0.3, 40)).astype(np.int64)
    anchors = rows[:20]
    a, b = hard_negatives.Side(anchors, np.float32), hard_negatives.Side(rows, np.float32)
    exact = anchors @ rows.T
    for share in (0.9, 0.5, 0.2, 0.0, -0.5):
        least = share * np.sqrt((anchors * anchors).sum(axis=1)) * b.norms[:, -1].max()
        i, j, scores = hard_negatives.reaching(a, b, least)
        assert sorted(zip(i.tolist(), j.tolist(), scores.tolist(), strict=True)) == sorted(
            (int(x), int(y), int(exact[x, y])) for x, y in zip(*np.nonzero(exact >= least[:, None]), strict=True)
        )
    postings = hard_negatives.Index(b, 60.0).counts
    assert postings[0] < postings[-1] <= len(rows) and hard_negatives.Index(b, -1.0).counts[0] == len(rows)


def test_best_keeps_ties_in_order_of_id():
    found = Found(np.array([1, 0, 1, 1, 0], np.int32), np.array([5, 7, 5, 5, 8]), np.array([9, 1, 3, 0, 2]), np.array([1, 1, 1, 0, 1], np.uint8))
    best = found.best(2)
    assert list(zip(best.owner.tolist(), best.score.tolist(), best.ids.tolist(), strict=True)) == [(0, 8, 2), (0, 7, 1), (1, 5, 3), (1, 5, 9)]
