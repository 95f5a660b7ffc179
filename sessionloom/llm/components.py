"""Connected components of a table of links, by hooking and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import discard, materialize

JUMPS = 2


def components(links: DataFrame) -> DataFrame:
    """``id`` and ``root`` (the smallest id reachable) of every id in a link ``a``, ``b``.

    Each round points every node at its smallest neighbour, shortens the pointers, and contracts the
    links to what is left between roots. A hub sends one partial minimum from each task. Rounds end when no link
    is left; no step gathers a component. Links may repeat and point either way; null ends
    link nothing.
    """
    edges = materialize(
        links.filter("a != b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "edges"
    )
    roots = None
    while not edges.isEmpty():
        ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("id"), F.col("b").alias("other")),
                                              F.struct(F.col("b").alias("id"), F.col("a").alias("other")))).alias("e"))
        hooks = ends.select("e.*").groupBy("id").agg(F.min("other").alias("other")).select("id", F.least("id", "other").alias("root"))
        for _ in range(JUMPS):
            hooks = follow(materialize(hooks, "hooks"))
        hooks = materialize(hooks, "hooks")
        left, right = hooks.select(F.col("id").alias("a"), F.col("root").alias("ra")), hooks.select(F.col("id").alias("b"), F.col("root").alias("rb"))
        rest = edges.join(left, "a").join(right, "b").filter("ra != rb")
        rest = materialize(rest.select(F.least("ra", "rb").alias("a"), F.greatest("ra", "rb").alias("b")).distinct(), "edges")
        discard(edges)
        edges = rest
        if roots is None:
            roots = hooks
        else:
            step = hooks.select(F.col("id").alias("root"), F.col("root").alias("_next"))
            roots = materialize(
                roots.join(step, "root", "left").select("id", F.coalesce("_next", "root").alias("root")), "roots"
            )
    return edges.select(F.col("a").alias("id"), F.col("b").alias("root")) if roots is None else roots


def follow(hooks: DataFrame) -> DataFrame:
    """Every pointer moved on to where its target points."""
    step = hooks.select(F.col("id").alias("root"), F.col("root").alias("_next"))
    return hooks.join(step, "root", "left").select("id", F.coalesce("_next", "root").alias("root"))
