"""Messages, grouping and routing: hand-worked cases."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from sessionloom.functions import fields, flatten_rules
from sessionloom.operators import grouping, messages, traces, updates
from sessionloom.schemas import RECORD_LABELS, REDUCED_LABELS


def values(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, value string")


def test_malformed_updates_are_flagged(spark):
    df = values(
        spark,
        '{"update":"d1\\t2.5","group_id":"g"}',
        ' {"update":"d1\\t2.5\\textra\\t\\t","group_id":"g;1"} ',
        '{"update":"d1\\t2.5"',
        '{"update":"d1\\t2.5"}',
        '{"update":"d1","group_id":"g"}',
        '{"update":"d1\\tx","group_id":"g"}',
        '{"update":"","group_id":"g"}',
        "",
        None,
    )
    rows = {r.i: r for r in updates.parse_updates(df).collect()}
    assert [rows[i].ok for i in range(9)] == [True, True] + [False] * 7
    assert rows[0].reward == -2.5 and rows[1].group_id == "g;1"
    assert updates.valid_updates(updates.parse_updates(df)).count() == 2


def test_empty_fields_at_the_end_do_not_count(spark):
    df = values(spark, "a\tb\t\t", "a\t\tb", "")
    assert [r.f for r in df.orderBy("i").select(fields(F.col("value")).alias("f")).collect()] == [["a", "b"], ["a", "", "b"], [""]]


def test_project_labels(spark):
    record = "\t".join(str(i) for i in range(17))
    df = spark.createDataFrame([(record,), ("too\tshort",)], "update string")
    got = [r.update for r in updates.project_labels(df, RECORD_LABELS, REDUCED_LABELS).collect()]
    assert got == ["15\t16", None]
    with pytest.raises(ValueError):
        updates.project_labels(df, RECORD_LABELS, ["no such label"])


def test_messages_round_trip(spark):
    picks = spark.createDataFrame([("g", ["a", "b;c", "a"])], "group_id string, picks array<string>")
    sent = messages.format_picks(picks, "h:1").select("value")
    assert sent.first().value == "g;a:b;c:a:;From: h:1"
    back = messages.parse_decisions(sent).first()
    assert (back.group_id, back.picks, back.origin) == ("g", ["a", "b;c", "a"], "h:1")
    best = spark.createDataFrame([("g", "a;x", ["b", "c"])], "group_id string, best string, others array<string>")
    sent = messages.format_best(best, 0.25, "h:1").select("value")
    assert sent.first().value == 'g;{"random":["b","c"],"best":"a;x","epsilon":0.25};From: h:1'
    back = messages.parse_decisions(sent, "best").first()
    assert (back.best, back.others, back.epsilon) == ("a;x", ["b", "c"], 0.25)


def test_decision_lists_without_origin_or_decisions(spark):
    df = values(spark, "g;random", "g;:;From: x", "g; :a:\t")
    assert [r.picks for r in messages.parse_decisions(df).orderBy("i").collect()] == [["random"], [], ["a"]]


def sessions(spark, *features):
    return spark.createDataFrame([(list(f),) for f in features], "features array<string>")


TREE = {"Field": "0", "Table": [
    {"Key": "x", "Rule": {"GroupName": "first"}},
    {"Key": "x", "Rule": {"GroupName": "last", "Field": "1", "Table": [{"Key": "y", "Rule": {"GroupName": "deep"}}]}},
    {"Key": "x", "Rule": {"Field": "0", "Table": [{"Key": "z", "Rule": {"GroupName": "never"}}]}},
    {"Key": "w", "Rule": {}},
]}


@pytest.mark.parametrize("limit", [0, 64])
def test_last_rule_that_holds_wins(spark, limit):
    df = sessions(spark, ["x", "y", "", "", "as"], ["x", "n", "", "", "as"], ["w", "y", "", "", "as"], ["q"])
    for mode, unmatched in [("asn", ["as", None]), ("null", ["null", "null"])]:
        got = grouping.match_groups(df, json.dumps({"GroupingRules": TREE}), mode, expression_paths=limit)
        assert [r.group_id for r in got.collect()] == ["deep", "first", *unmatched]
    assert [r.group_id for r in grouping.match_groups(df, TREE, "asn_only").collect()] == ["as", "as", "as", None]


def test_contradictory_paths_are_left_out():
    assert [p.group for p in flatten_rules(TREE)] == ["first", "deep"]


def test_a_rule_without_conditions_matches_all(spark):
    for limit in (0, 64):
        got = grouping.match_groups(sessions(spark, ["a"]), {"GroupName": "all"}, expression_paths=limit)
        assert got.first().group_id == "all"


def test_large_rule_sets_agree_with_the_expression(spark):
    table = [{"Key": str(i % 50), "Rule": {"Field": "1", "Table": [{"Key": str(i % 7), "Rule": {"GroupName": f"g{i}"}}]}} for i in range(200)]
    df = spark.range(500).select(F.array((F.col("id") % 60).cast("string"), (F.col("id") % 9).cast("string")).alias("features"))
    a = grouping.match_groups(df, {"Field": "0", "Table": table}, "null", expression_paths=0)
    b = grouping.match_groups(df, {"Field": "0", "Table": table}, "null", expression_paths=10_000)
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


def test_last_assignment_wins_also_within_a_message(spark):
    def message(*pairs):
        return json.dumps({"GroupAssignment": [{"GroupName": g, "Cluster": c} for g, c in pairs]})

    rows = [(1, message(("g", "a"), ("g", "b"))), (0, message(("g", "z"), ("h", "y"))), (2, '{"GroupingRules":{}}'), (3, "no json")]
    df = spark.createDataFrame(rows, "offset long, value string")
    got = {r.group_id: r.cluster_id for r in grouping.latest_assignment(df, "me").collect()}
    assert got == {"g": "b", "h": "y", "null": "me"}
    moved = spark.createDataFrame([(5, message(("null", "other")))], "offset long, value string")
    assert {r.group_id: r.cluster_id for r in grouping.latest_assignment(moved, "me").collect()} == {"null": "other"}


def test_routing(spark):
    record = "\t".join(str(i) for i in range(17))
    df = spark.createDataFrame([(record, "own"), (record, "far"), (record, "new")], "update string, group_id string")
    table = spark.createDataFrame([("own", "me"), ("far", "you")], "group_id string, cluster_id string")
    rows = grouping.route_updates(df, table, "me").collect()
    assert sorted((r.group_id, r.topic) for r in rows if r.topic != "upload") == [
        ("far", "external_groups"), ("new", "internal_groups"), ("own", "internal_groups")]
    assert {r.value for r in rows if r.topic == "upload"} == {record}
    assert json.loads(next(r.value for r in rows if r.topic == "external_groups")) == {
        "update": "15\t16", "group_id": "far", "cluster_id": "you"}


def test_requests(spark):
    df = values(spark, "\t".join([*map(str, range(15)), "a", "b"]), "short")
    rows = traces.parse_requests(df).orderBy("i").collect()
    assert rows[0].candidates == ["a", "b"] and len(rows[0].features) == 15 and rows[1].candidates == []
