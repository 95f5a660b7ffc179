"""Publish and collect: decision messages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.wire import strip_wire
from ..schemas import BEST_JSON, ORIGIN_MARK

DECISION_MESSAGE = r"(?s)^([^;]*);(.*?)(?:;From: ([^;]*))?$"


def decision_message(group: Column, body: Column, origin: str) -> Column:
    return F.concat(group, F.lit(";"), body, F.lit(ORIGIN_MARK + origin))


def format_picks(df: DataFrame, origin: str, picks: str = "picks", name: str = "value") -> DataFrame:
    """``group;d1:d2:..:dK:;From: origin`` for a list of picks."""
    listed = F.concat(F.array_join(picks, ":"), F.lit(":"))
    return df.withColumn(name, decision_message(F.col("group_id"), listed, origin))


def format_reset(df: DataFrame, origin: str, body: str = "decision", name: str = "value") -> DataFrame:
    """``group;word;From: origin``, as sent on a reset tick."""
    return df.withColumn(name, decision_message(F.col("group_id"), F.col(body), origin))


def format_best(df: DataFrame, epsilon: float, origin: str, name: str = "value") -> DataFrame:
    """``group;{"random":[..],"best":..,"epsilon":..};From: origin``."""
    body = F.to_json(
        F.struct(
            F.col("others").alias("random"), F.col("best"), F.lit(float(epsilon)).alias("epsilon")
        )
    )
    return df.withColumn(name, decision_message(F.col("group_id"), body, origin))


def parse_decisions(df: DataFrame, kind: str = "picks", value: str = "value") -> DataFrame:
    """Decision messages back as columns.

    ``picks`` gives ``picks array<string>``, ``best`` gives ``best, others,
    epsilon``. The group ends at the first separator and the origin starts at the
    last mark, so a separator inside the body does no harm.
    """
    part = {i: F.regexp_extract(value, DECISION_MESSAGE, i) for i in (1, 2, 3)}
    base = df.select(
        *[c for c in df.columns if c != value],
        part[1].alias("group_id"),
        part[2].alias("_body"),
        F.nullif(part[3], F.lit("")).alias("origin"),
    )
    if kind == "picks":
        listed = strip_wire(F.col("_body"))
        return base.withColumn("picks", F.filter(F.split(listed, ":"), lambda d: d != "")).drop("_body")
    if kind == "best":
        return (
            base.withColumn("_j", F.from_json("_body", BEST_JSON))
            .withColumn("best", F.col("_j.best"))
            .withColumn("others", F.col("_j.random"))
            .withColumn("epsilon", F.col("_j.epsilon"))
            .drop("_j", "_body")
        )
    raise ValueError(f"unknown kind of decision message: {kind}")
