"""Column expressions shared by the operators that run on built-in functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
SPACE = r"[\x20\x09-\x0D]+"
NOT_SPACE = r"[^\x20\x09-\x0D]"


def whole(text: str) -> Column:
    """The text, a null one as the empty text."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def words(text: Column) -> Column:
    """Array of the maximal runs of characters other than ASCII white space."""
    return F.array_remove(F.split(text, SPACE), "")


def spaced_words(text: Column) -> Column:
    """The words, each with the white space before it; joined they are the text up to its last word."""
    return F.regexp_extract_all(text, F.lit(r"[\x20\x09-\x0D]*" + NOT_SPACE + "+"), F.lit(0))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.transform(F.array(value), body).getItem(0)


def upto(count: Column) -> Column:
    """Array 0 .. count-1, empty for a count of zero or less."""
    none = F.array().cast("array<int>")
    return F.when(count > 0, F.sequence(F.lit(0), (count - 1).cast("int"))).otherwise(none)
