"""Reading separated wire strings."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..schemas import STRIPPED


def fields(value: Column) -> Column:
    """Tab-separated fields; empty fields at the end do not count."""
    return F.split(F.rtrim(value, F.lit("\t")), "\t", -1)


def strip_wire(value: Column) -> Column:
    """Drop separators and white space on both ends of a decision list."""
    return F.btrim(value, F.lit(STRIPPED))
