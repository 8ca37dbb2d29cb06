"""Small expressions for dirty text and integer days."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def text(c: str | Column) -> Column:
    """Trimmed; blank becomes null."""
    return F.nullif(F.trim(c), F.lit(""))


def code(c: str | Column) -> Column:
    """Trimmed and in upper case; blank becomes null."""
    return F.upper(text(c))


def day_of(c: str | Column) -> Column:
    """The DATE of an integer day yyyyMMdd; null where it is no calendar day, such as one of another number of digits."""
    n = (F.col(c) if isinstance(c, str) else c).cast("long")
    return F.when(n.between(10101, 99991231), F.try_to_date(F.lpad(n.cast("string"), 8, "0"), "yyyyMMdd"))


def day_int(c: str | Column) -> Column:
    """yyyyMMdd of a date or timestamp."""
    c = F.col(c) if isinstance(c, str) else c
    return (F.year(c) * 10000 + F.month(c) * 100 + F.dayofmonth(c)).cast("int")
