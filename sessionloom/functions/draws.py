"""Repeatable random draws."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def keyed_draw(key: Column, m: Column | int, name: str = "", seed: int = 42) -> Column:
    """An integer in ``[0, m)`` fixed by key, seed and the draw's name.

    A task retry gives the same draw, which ``rand()`` does not promise. Draws of
    one key under different names are independent. NULL when ``m`` is 0 or NULL.
    """
    modulus = F.lit(m) if isinstance(m, int) else m
    digest = F.md5(F.concat_ws(":", key.cast("string"), F.lit(f"{seed}{name}")))
    number = F.conv(F.substring(digest, 1, 8), 16, 10).cast("bigint")
    return number % F.nullif(modulus.cast("bigint"), F.lit(0).cast("bigint"))
