"""Row numbers, series, traces and response logs against plain Python."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from sessionloom.operators import exchange, responses, series, traces
from sessionloom.functions.ticks import RUN, number_line
from sessionloom.operators.ordinal import numbered_rows, placed_rows, previous_value, with_ordinal


@pytest.fixture(scope="module")
def skewed():
    """A third of the rows share one group and one order value."""
    rng = random.Random(3)
    return [(i, "hot" if rng.random() < 0.34 else f"g{rng.randint(0, 40)}", 7 if rng.random() < 0.34 else rng.randint(0, 50)) for i in range(3000)]


@pytest.mark.parametrize("parts", [1, 5, 40])
def test_ordinals_do_not_depend_on_partitioning(spark, skewed, parts):
    df = spark.createDataFrame(skewed, "id long, g string, v int").repartition(parts)
    got = {r.id: r.ordinal for r in with_ordinal(df, ["v", "id"], ["g"]).collect()}
    expected, seen = {}, {}
    for i, g, _ in sorted(skewed, key=lambda r: (r[1], r[2], r[0])):
        seen[g] = seen.get(g, 0) + 1
        expected[i] = seen[g]
    assert got == expected
    total = {r.id: r.n for r in with_ordinal(df, ["v", "id"], name="n").collect()}
    assert total == {r[0]: n for n, r in enumerate(sorted(skewed, key=lambda r: (r[2], r[0])), 1)}


def test_ordinals_count_rows_without_a_group(spark):
    df = spark.createDataFrame([(1, None), (2, None), (3, "a")], "id long, g string")
    assert {r.id: r.ordinal for r in with_ordinal(df, ["id"], ["g"]).collect()} == {1: 1, 2: 2, 3: 1}


def test_hot_group_spreads_over_partitions(spark, skewed):
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.createDataFrame(skewed, "id long, g string, v int").withColumn("g", F.lit("hot"))
        placed = df.repartitionByRange("g", "v", "id").groupBy(F.spark_partition_id().alias("p")).count().collect()
        assert len(placed) > 1 and max(r["count"] for r in placed) < len(skewed) * 0.6
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")


def test_previous_value_crosses_runs(spark):
    df = spark.range(1, 50).select(F.col("id").alias("i"), (F.col("id") * 2).alias("v"))
    got = {r.i: r.p for r in previous_value(df, "v", "p", "i", chunk=4).collect()}
    assert got == {i: (i - 1) * 2 if i > 1 else None for i in range(1, 50)}


@pytest.mark.parametrize("n,every", [(60, 60), (6, 4), (4, 6), (1, 1)])
def test_moving_average(spark, n, every):
    values = [float(i * i % 17) for i in range(150)]
    df = spark.createDataFrame(list(enumerate(values)), "idx int, value double")
    got = {r.i: r.mean for r in series.moving_avg(df, n=n, every=every).collect()}
    expected = {i: sum(values[i - n:i]) / n for i in range(every, 151, every) if i >= n}
    assert got == pytest.approx(expected)


def test_blocks_and_pairs(spark):
    rows = [(i, 0 if i % 3 else 1, float(i)) for i in range(1, 61)]
    df = spark.createDataFrame(rows, "line_no int, frontend int, cost double").withColumn("part", series.frontend_part())
    means = series.block_means(df, n=8)
    plain = {p: [r[2] for r in rows if (r[1] != 0) == p] for p in (False, True)}
    blocks = {p: [sum(v[i:i + 8]) / 8 for i in range(0, len(v) - 7, 8)] for p, v in plain.items()}
    first, second = means.filter("part = 0"), means.filter("part = 1")
    zipped = sorted((r.block, r.first, r.second) for r in series.zip_series(first, second).collect())
    assert zipped == [(i, a, b) for i, (a, b) in enumerate(zip(blocks[False], blocks[True]))]
    assert series.length_gap(first, second).first().gap == len(blocks[False]) - len(blocks[True])


def line(ms, *rest):
    features = "\t".join([str(ms), *map(str, range(1, 15))])
    return features + "\t" + "".join(rest)


def test_trace_lines(spark):
    texts = [
        line(12_999, "DecisionMap\ta,1.5\tb,2\tLoadMap\ta,0.2;1.5;0.5;2.0\tb,0.3;9\n"),
        line(1000, "DecisionMap\ta,1\ta,3\tb,x\t\tc\tLoadMap\ta,0.1;5\ta,0.1;6;0.2"),
        line(1000, "no maps here"),
        line("when", "DecisionMap\ta,1\tLoadMap\ta,0.2;1"),
        line(1000, "DecisionMap\tLoadMap\t"),
        "",
    ]
    df = spark.createDataFrame(list(enumerate(texts)), "line_no int, value string")
    rows = traces.parse_trace(df).orderBy("line_no").collect()
    assert rows[0].ts.timestamp() == 12 and len(rows[0].features) == 15
    assert rows[0].candidates == ["a", "b"] and rows[0].costs == {"a": 1.5, "b": 2.0}
    assert [tuple(x) for x in rows[0].loads["a"]] == [(0.2, 1.5), (0.5, 2.0)]
    assert rows[1].costs == {"a": 3.0, "b": None, "c": None}
    assert [tuple(x) for x in rows[1].loads["a"]] == [(0.1, 6.0), (0.2, None)]
    assert [r.ok for r in rows] == [True, True, False, False, True, False]


def test_trace_order_is_textual_or_numeric(spark):
    df = spark.createDataFrame([(0, "10\tx"), (1, "9\ty"), (2, "10\ta")], "line_no int, value string")
    assert [r.line_no for r in traces.sort_trace(df).collect()] == [0, 2, 1]
    assert [r.line_no for r in traces.sort_trace(df, numeric=True).collect()] == [1, 0, 2]


def test_load_share_and_factor(spark):
    rows = [(i, 100 + i * 10, "a" if i % 3 else "none", ["a"], {"a": [(0.2, 1.5), (0.5, 2.0)]}) for i in range(9)]
    df = spark.createDataFrame(
        rows, "line_no int, sec long, decision string, candidates array<string>, loads map<string,array<struct<thr:double,factor:double>>>"
    ).withColumn("ts", F.timestamp_seconds("sec"))
    shares = traces.load_share(df)
    got = {r.line_no: (r.minute, r.running, r.total_sessions) for r in shares.collect()}
    assert got == {1: (0, 1, 6), 2: (0, 2, 6), 4: (0, 3, 6), 5: (0, 4, 6), 7: (1, 1, 3), 8: (1, 2, 3)}
    factors = {r.line_no: r.factor for r in traces.load_cost_factor(shares, enabled=True).collect()}
    assert factors == {1: 1.0, 2: 1.5, 4: 1.5, 5: 2.0, 7: 1.5, 8: 2.0}
    assert {r.factor for r in traces.load_cost_factor(shares).collect()} == {1.0}


def test_cost_with_fallback(spark):
    costs = {"a": 1.0, "b": 2.0, "c": 3.0}
    rows = [(1, True, "b", ["a", "b", "c"]), (2, False, "b", ["c", "a", "b"]), (3, True, "z", ["a", "b", "c"]), (4, False, "", ["a"])]
    df = spark.createDataFrame([(*r, costs) for r in rows], "line_no int, answered boolean, decision string, candidates array<string>, costs map<string,double>")
    got = {r.line_no: (r.mode, r.cost) for r in traces.cost_with_fallback(df).collect()}
    assert got == {1: ("online", 2.0), 2: ("local", 2.0), 4: ("local", None)}


def logs(spark, times):
    rows = [("w", i, s, s + rt, rt) for i, (s, rt) in enumerate(times)]
    return spark.createDataFrame(rows, "worker string, id long, sent double, recv double, rt double")


@pytest.mark.parametrize("n", [1, 9, 10, 11, 1000])
@pytest.mark.parametrize("q", [0.0, 0.5, 0.9, 0.99])
def test_quantile_is_the_ranked_element(spark, n, q):
    rng = random.Random(n)
    times = [0.25 if rng.random() < 0.4 else rng.random() for _ in range(n)]
    df = logs(spark, [(float(i), t) for i, t in enumerate(times)])
    assert responses.response_quantile(df, q, unit=1).first().rt == sorted(times)[int(q * n)]


def test_quantile_with_a_coarse_bracket_is_still_exact(spark):
    times = [((i * 37) % 500) / 1000 for i in range(500)]
    df = logs(spark, [(float(i), t) for i, t in enumerate(times)])
    for accuracy in (10, 100_000):
        assert responses.response_quantile(df, 0.9, accuracy=accuracy, unit=1).first().rt == 0.45


def test_quantile_of_nothing(spark):
    assert responses.response_quantile(logs(spark, [(0.0, 0.1)]).limit(0)).count() == 0


def test_responses_per_second(spark):
    df = logs(spark, [(10.0, 0.1), (10.5, 0.3), (12.2, 0.5)])
    got = [(r.second, r.mean_rt, r.succeeded) for r in responses.response_by(df).orderBy("second").collect()]
    assert got == [(0, 200.0, 2), (1, 0.0, 0), (2, 500.0, 1), (3, 0.0, 0)]
    plain = responses.response_by(df, "recv", millis=False).orderBy("second").collect()
    assert [(r.second, r.mean_rt, r.succeeded) for r in plain] == [(0, 0.2, 2), (1, 0.0, 0), (2, 0.5, 1), (3, 0.0, 0)]


def test_message_times(spark):
    seconds = [0, 1, 3, 6, 10, 15, 21, 28, 36, 45, 55, 66, 78]
    df = spark.createDataFrame(list(enumerate(seconds)), "event_id int, s long").select("event_id", F.timestamp_seconds("s").alias("ts"))
    gaps = {r.event_id: r.gap for r in responses.message_gaps(df).collect()}
    assert gaps[0] is None and [gaps[i] for i in range(1, 13)] == list(range(1, 13))
    assert [(r.block, r.mean_gap) for r in responses.interarrival(df, 4).orderBy("block").collect()] == [(0, 2.5), (1, 6.5), (2, 10.5)]
    blocks = responses.throughput_blocks(df, 5).orderBy("block").collect()
    assert [(r.block, r.total, r.seconds) for r in blocks] == [(1, 5, 10.0), (2, 10, 35.0)]
    each = responses.throughput_blocks(df, 1).orderBy("block").collect()
    assert [r.seconds for r in each] == [0.0, *map(float, range(1, 13))]


def test_pushes_need_an_earlier_subscription(spark):
    decisions = spark.createDataFrame([("g", 1), ("g", 2), ("g", 3), ("h", 3)], "group_id string, b long")
    heard = spark.createDataFrame([("g;far", 2), ("g;far", 1), ("g;me", 0), ("g;near", 2)], "value string, b long")
    pairs = exchange.subscriptions(exchange.parse_subscriptions(heard))
    got = sorted((r.group_id, r.b, r.cluster_id) for r in exchange.push_decisions(decisions, pairs, "me").collect())
    assert got == [("g", 2, "far"), ("g", 3, "far"), ("g", 3, "near")]


def test_feature_counts_skip_the_last_labels(spark):
    df = spark.createDataFrame([(1, "a\tb\td\t1"), (2, "a\tc\td\t2"), (3, "x")], "event_id long, value string")
    got = sorted(r.value for r in exchange.feature_counts(df, 1.0).collect())
    assert got == ["0;a;2", "1;b;1", "1;c;1"]


@pytest.mark.parametrize("parts", [1, 7])
def test_several_numbers_from_one_stored_order(spark, skewed, parts):
    placed = placed_rows(spark.createDataFrame(skewed, "id long, g string, v int").repartition(parts), ["v", "id"])
    both = numbered_rows(numbered_rows(placed, "n", dense=True), "i", ["g"])
    some = numbered_rows(placed.filter("id % 3 = 0"), "few", ["g"])
    order, seen = sorted(skewed, key=lambda r: (r[2], r[0])), {}
    want = {}
    for n, (i, g, _) in enumerate(order, 1):
        seen[g] = seen.get(g, 0) + 1
        want[i] = (n, seen[g])
    assert {r.id: (r.n, r.i) for r in both.collect()} == want
    seen = {}
    for i, g, _ in order:
        if i % 3 == 0:
            seen[g] = seen.get(g, 0) + 1
            want[i] = seen[g]
    assert {r.id: r.few for r in some.collect()} == {i: want[i] for i, *_ in skewed if i % 3 == 0}


def test_failover_blocks_and_their_gap(spark):
    rows = [(i, float(i * i % 13)) for i in range(1, 118)]
    means = series.failover_blocks(spark.createDataFrame(rows, "line_no int, cost double"), 3, n=10)
    plain = {0: [c for k, (_, c) in enumerate(rows) if k % 3 == 0], 1: [c for k, (_, c) in enumerate(rows) if k % 3]}
    blocks = {p: [sum(v[i : i + 10]) / 10 for i in range(0, len(v) - 9, 10)] for p, v in plain.items()}
    assert {(r.part, r.block): r.mean for r in means.collect()} == pytest.approx({(p, i): m for p, v in blocks.items() for i, m in enumerate(v)})
    pairs = series.paired_blocks(means).collect()
    assert sorted((r.block, r.gap) for r in pairs) == [(i, len(blocks[1]) - len(blocks[0])) for i in range(len(blocks[0]))]


def test_long_lines_are_made_by_many_tasks(spark):
    span = spark.createDataFrame([(-5, 3_000_000)], "lo long, hi long")
    line = number_line(span, "lo", "hi", "n")
    found = line.groupBy(F.spark_partition_id().alias("p")).agg(F.count(F.lit(1)).alias("rows"), F.sum("n").alias("sum")).collect()
    assert sum(r["rows"] for r in found) == 3_000_006 and sum(r["sum"] for r in found) == sum(range(-5, 3_000_001))
    assert len(found) == 4 and max(r["rows"] for r in found) < 3_000_006 * 0.6
    assert number_line(spark.createDataFrame([(RUN - 1, RUN), (7, 3)], "lo long, hi long"), "lo", "hi", "n").count() == 2


def test_long_lists_take_linear_time(spark):
    import time

    def seconds(n):
        names = [f"d{i}" for i in range(n)] + ["d0"]
        text = "\t".join(map(str, range(1000, 1015))) + "\tDecisionMap\t" + "\t".join(f"{d},{i}" for i, d in enumerate(names)) + "\tLoadMap\ta,0.1;2"
        df = spark.createDataFrame([(1, text)], "line_no int, value string")
        begin = time.perf_counter()
        row = traces.parse_trace(df).first()
        taken = time.perf_counter() - begin
        assert len(row.costs) == n and row.costs["d0"] == float(n) and len(row.candidates) == n
        return taken

    seconds(10)
    assert seconds(10_000) < 5
