"""Traces: parsing, order, cost and load of served sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wire import fields
from ..schemas import DECISION_MARK, FEATURE_LABELS, FIELD_SEPARATOR, LOAD_MARK
from ..session import materialize
from .lookup import lookup_join
from .ordinal import PLACE, numbered_rows, placed_rows, with_ordinal

FALLBACK_CANDIDATE = 3
MINUTE = 60


def _items(text: Column) -> Column:
    return F.split(text, FIELD_SEPARATOR)


def _names(items: Column) -> Column:
    """Distinct names of ``name,rest`` items; empty items have none."""
    return F.array_distinct(F.transform(F.filter(items, lambda x: x != ""), lambda x: F.substring_index(x, ",", 1)))


def _named(text: Column, items: Column, names: Column) -> Column:
    """A map from the ``name,rest`` items of a tab-separated list; a name given twice keeps its last item.

    A list with as many names as items is read as it is. Otherwise the items are sorted by name and place, and of equal neighbours the last one stays.
    """
    plain = F.str_to_map(text, F.lit(FIELD_SEPARATOR), F.lit(","))
    entries = F.transform(
        F.filter(items, lambda x: x != ""),
        lambda x, i: F.struct(F.substring_index(x, ",", 1).alias("k"), i.alias("i"), F.get(F.split(x, ",", 2), F.lit(1)).alias("v")),
    )

    def last_of_each(ordered: Column) -> Column:
        kept = F.filter(ordered, lambda e, i: ~F.coalesce(F.get(ordered, i + 1)["k"] == e["k"], F.lit(False)))
        return F.map_from_entries(F.transform(kept, lambda e: F.struct(e["k"], e["v"])))

    # The sorted list is made once for all of its items.
    careful = F.get(F.transform(F.array(F.array_sort(entries)), last_of_each), F.lit(0))
    return F.when(F.size(names) == F.size(items), plain).otherwise(careful)


def parse_trace(df: DataFrame, value: str = "value", cost_type: str = "double") -> DataFrame:
    """Trace lines as ``ts, features, candidates, costs, loads, ok``.

    ``costs`` maps each candidate decision to its cost, ``loads`` to its ``(thr,
    factor)`` steps. Times are milliseconds, cut to whole seconds. A line without
    both marks or with a time that is no number keeps its row, ``ok`` false.
    """
    def stripped(text: Column) -> Column:
        return F.btrim(text, F.lit(" \t\r\n"))

    def steps(numbers: Column) -> Column:
        return F.zip_with(
            F.filter(numbers, lambda x, i: i % 2 == 0),
            F.filter(numbers, lambda x, i: i % 2 == 1),
            lambda thr, factor: F.struct(thr.alias("thr"), factor.alias("factor")),
        )

    # Each stage is read several times by the next, so it stays a projection of its own.
    staged = (
        df.withColumn("_halves", F.split(F.col(value), DECISION_MARK, 2))
        .withColumn("_maps", F.split(F.get("_halves", F.lit(1)), LOAD_MARK, 2))
        .withColumn("_features", fields(F.get("_halves", F.lit(0))))
        .withColumn("_priced", stripped(F.get("_maps", F.lit(0))))
        .withColumn("_loaded", stripped(F.get("_maps", F.lit(1))))
        .withColumn("_millis", F.get("_features", F.lit(0)).try_cast("bigint"))
        .withColumn("_price_items", _items(F.col("_priced")))
        .withColumn("_load_items", _items(F.col("_loaded")))
        .withColumn("_price_names", _names(F.col("_price_items")))
        .withColumn("_load_names", _names(F.col("_load_items")))
    )
    costs = _named(F.col("_priced"), F.col("_price_items"), F.col("_price_names"))
    loads = _named(F.col("_loaded"), F.col("_load_items"), F.col("_load_names"))
    numbers = F.transform_values(loads, lambda k, v: F.split(v, ";").try_cast("array<double>"))
    return staged.select(
        *[c for c in df.columns if c != value],
        F.timestamp_seconds(F.floor(F.col("_millis") / 1000)).alias("ts"),
        F.col("_features").alias("features"),
        # Not taken from the map: filters on candidates are pushed down to the scan, and are cheaper without it.
        F.col("_price_names").alias("candidates"),
        F.transform_values(costs, lambda k, v: v.try_cast(cost_type)).alias("costs"),
        F.transform_values(numbers, lambda k, v: steps(v)).alias("loads"),
        (F.col("_millis").isNotNull() & (F.size("_halves") == 2) & (F.size("_maps") == 2)).alias("ok"),
    )


def parse_requests(df: DataFrame, value: str = "value", features: int = len(FEATURE_LABELS)) -> DataFrame:
    """Request records: the features, then the candidate decisions."""
    parts = F.split(F.col(value), FIELD_SEPARATOR, -1)
    rest = F.greatest(F.size(parts) - features, F.lit(0))
    return df.select(
        *[c for c in df.columns if c != value],
        F.slice(parts, 1, features).alias("features"),
        F.slice(parts, F.lit(features + 1), rest).alias("candidates"),
    )


def sort_trace(df: DataFrame, numeric: bool = False, value: str = "value", place: str | None = None) -> DataFrame:
    """Lines in the order of their first field, as text (or as a number); equal ones in line order.

    ``place`` names a column for each line's place in that order.
    """
    first = F.get(F.split(F.col(value), FIELD_SEPARATOR, 2), F.lit(0))
    staged = df.withColumn("_first", first.try_cast("double") if numeric else first)
    if place:
        return with_ordinal(staged, ["_first", "line_no"], name=place).drop("_first")
    return staged.orderBy("_first", "line_no").drop("_first")


def is_candidate() -> Column:
    return F.coalesce(F.array_contains("candidates", F.col("decision")), F.lit(False))


def valid_choice(df: DataFrame) -> DataFrame:
    """Sessions whose chosen decision is one of their candidates."""
    return df.filter(is_candidate())


def chosen_cost(df: DataFrame, name: str = "cost") -> DataFrame:
    return df.withColumn(name, F.try_element_at("costs", F.col("decision")))


def second_of(ts: str = "ts") -> Column:
    return F.unix_seconds(F.col(ts))


def first_second(df: DataFrame, ts: str = "ts") -> Column:
    """First second of a trace, as a scalar subquery."""
    return df.select(F.min(second_of(ts))).scalar()


def minute_totals(df: DataFrame, start: Column | None = None) -> DataFrame:
    """Sessions per minute since the trace began, valid or not."""
    begin = first_second(df) if start is None else start
    minute = F.floor((second_of() - begin) / MINUTE).cast("bigint")
    return df.groupBy(minute.alias("minute")).agg(F.count(F.lit(1)).alias("total_sessions"))


def load_share(df: DataFrame, order_by: tuple[str, ...] = ("line_no",)) -> DataFrame:
    """Running count of each valid session's decision within its minute, over the minute's sessions.

    The minute's total has all sessions; only valid ones raise the running count.
    The sessions are parsed once, then stored in order. Hot minutes are numbered across its partitions, and the totals (one row a minute)
    are looked up.
    """
    placed = placed_rows(materialize(df.withColumn("_valid", is_candidate()).drop("candidates"), "sessions"), order_by)
    begin = first_second(placed)
    staged = placed.withColumn("minute", F.floor((second_of() - begin) / MINUTE).cast("bigint"))
    totals = staged.groupBy("minute").agg(F.count(F.lit(1)).alias("total_sessions"))
    numbered = numbered_rows(staged.filter("_valid"), "running", ("minute", "decision")).drop("_valid", *PLACE)
    shares = lookup_join(numbered, totals, ["minute"], "inner")
    return shares.withColumn("load", F.col("running") / F.col("total_sessions"))


def load_cost_factor(df: DataFrame, enabled: bool = False) -> DataFrame:
    """Cost factor of the largest threshold under the load; 1 without one, and 1 when not enabled."""
    if not enabled:
        return df.withColumn("factor", F.lit(1.0))
    passed = F.filter(F.try_element_at("loads", F.col("decision")), lambda x: x["thr"] < F.col("load"))
    return df.withColumn("factor", F.coalesce(F.array_max(passed)["factor"], F.lit(1.0)))


def cost_per_second(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """Mean cost of the valid sessions of each second, with sent and valid counts.

    ``df`` has ``ts``, ``cost`` and ``valid``. Seconds without a valid session are
    left out.
    """
    valid = F.col("valid")
    return (
        df.groupBy(*keys, second_of().alias("sec"))
        .agg(
            F.sum(F.when(valid, F.col("cost"))).cast("double").alias("_cost"),
            F.count(F.lit(1)).alias("sent"),
            F.count_if(valid).alias("succeeded"),
        )
        .filter(F.col("succeeded") > 0)
        .select(*keys, "sec", (F.col("_cost") / F.col("succeeded")).alias("mean_cost"), "sent", "succeeded")
    )


def cost_with_fallback(df: DataFrame) -> DataFrame:
    """Cost and mode of sessions where a request may have failed (``answered`` false).

    A failed one costs what its third candidate costs, mode ``local``; an answered
    one with an invalid decision is dropped; the others are ``online``.
    """
    third = F.try_element_at("candidates", F.lit(FALLBACK_CANDIDATE))
    local = F.try_element_at("costs", third)
    online = F.try_element_at("costs", F.col("decision"))
    return (
        df.filter(~F.col("answered") | is_candidate())
        .withColumn("mode", F.when(F.col("answered"), "online").otherwise("local"))
        .withColumn("cost", F.when(F.col("answered"), online).otherwise(local))
    )
