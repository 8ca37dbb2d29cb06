"""Totals over trailing calendar windows by event-contribution deltas.

An amount of a day raises every window total on that day and lowers it again when it leaves the window: +a at its day,
-a ``w`` days later. The running sum of the deltas of an entity is its window total, constant between two events, so days
without activity need no grid to join with: each stretch between events is spread over its days at the end.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def trailing_totals(daily: DataFrame, key: str, day: str, amount: str, windows: tuple[int, ...] = (7, 30)) -> DataFrame:
    """One row per key and calendar day from its first to its last day: ``key, day, first_day, total_<w>...``.

    ``daily`` holds amounts of an exact type (integer or decimal); several rows of a key and day add up, a null amount is
    0. Rows with a null key or day are left out. An empty table gives no rows. The deltas are summed per key and day before
    the window, on the map side first, so the rows of a key in one task are bounded by its calendar days, whatever its rows.
    """
    base = daily.where(F.col(key).isNotNull() & F.col(day).isNotNull()).select(F.col(key).alias("__k"), F.col(day).alias("__d"), F.coalesce(F.col(amount), F.lit(0)).alias("__a"))
    base = base.groupBy("__k", "__d").agg(F.sum("__a").alias("__a"))  # first, so that a day gives its events once
    # one event at the day, one per window at its end; an event carries its delta for every window
    shifts = F.array(*(F.lit(s) for s in (0, *windows)))
    events = base.select("__k", "__a", F.col("__d").alias("__at"), F.explode(shifts).alias("__s"))
    deltas = [F.when(F.col("__s") == 0, F.col("__a")).when(F.col("__s") == w, -F.col("__a")).otherwise(F.lit(0)).alias(f"__x{w}") for w in windows]
    events = events.select("__k", F.date_add("__at", F.col("__s")).alias("__at"), "__s", *deltas)
    events = events.groupBy("__k", "__at").agg(*(F.sum(f"__x{w}").alias(f"__x{w}") for w in windows), F.max(F.col("__s") == 0).alias("__real"))
    run = W.partitionBy("__k").orderBy("__at")
    whole = W.partitionBy("__k")
    spans = events.select(
        "__k",
        "__at",
        F.lead("__at").over(run).alias("__next"),
        F.min("__at").over(whole).alias("__first"),
        F.max(F.when(F.col("__real"), F.col("__at"))).over(whole).alias("__last"),
        *(F.sum(f"__x{w}").over(run.rowsBetween(W.unboundedPreceding, 0)).alias(f"total_{w}") for w in windows),
    ).where(F.col("__at") <= F.col("__last"))
    until = F.least(F.coalesce(F.date_sub("__next", 1), F.col("__last")), F.col("__last"))
    return spans.select(
        F.col("__k").alias(key),
        F.explode(F.sequence("__at", until)).alias(day),
        F.col("__first").alias("first_day"),
        *(f"total_{w}" for w in windows),
    )


def latest_by(df: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """The value of the row with the greatest ``order`` per key; of ties the greatest value, null last. A map-side combinable
    maximum, so repeated rows of a hot key shrink before the shuffle."""
    best = F.max(F.struct(F.col(order), F.col(value))).alias("__b")
    return df.groupBy(*keys).agg(best).select(*keys, F.col("__b")[value].alias(value))


def union_all(frames: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionByName, frames)
