"""Running totals, rates and comparisons of business periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.functions.clean import day_of

#: What a running total restarts with: the key of a date.
_PERIOD = {
    "mtd": lambda d: F.year(d) * 100 + F.month(d),
    "ytd": lambda d: F.year(d),
    "wtd": lambda d: F.date_trunc("week", d),  # ISO weeks begin on Monday
}


def running_totals(df: DataFrame, metrics: list[str], grain: list[str], day: str, kinds: tuple[str, ...] = ("mtd", "ytd"), day_is_int: bool = True) -> DataFrame:
    """``<metric>_<kind>`` for each kind: the metric summed within grain and period up to the row's day. One row per grain and
    day is expected; the period is derived from the day itself."""
    d = day_of(day) if day_is_int else F.col(day)
    out = {}
    for k in kinds:
        w = W.partitionBy(*grain, _PERIOD[k](d)).orderBy(day).rowsBetween(W.unboundedPreceding, 0)
        out |= {f"{m}_{k}": F.sum(m).over(w) for m in metrics}
    return df.withColumns(out)


def rate(numerator: str, denominator: str) -> Column:
    """Ratio; null where the denominator is 0 or null."""
    return F.try_divide(F.col(numerator).cast("double"), F.col(denominator).cast("double"))


_BEFORE = {
    "dod": lambda d: F.date_sub(d, 1),
    "wow": lambda d: F.date_sub(d, 7),
    "mom": lambda d: F.when(F.dayofmonth(F.add_months(d, -1)) == F.dayofmonth(d), F.add_months(d, -1)),
    "yoy": lambda d: F.when(F.dayofmonth(F.add_months(d, -12)) == F.dayofmonth(d), F.add_months(d, -12)),
}


def compare(df: DataFrame, metric: str, grain: list[str], date: str, kind: str) -> DataFrame:
    """``<metric>_<kind>_prev``, ``_delta`` and ``_pct`` against the same day of the period before (dod, wow, mom, yoy). A day
    that did not exist then, or has no row, gives null, not the row before it."""
    prev = df.select(*grain, F.col(date).alias("__then"), F.col(metric).alias(f"{metric}_{kind}_prev"))
    cond = [F.col(f"a.{g}").eqNullSafe(F.col(f"b.{g}")) for g in grain] + [F.col("__want") == F.col("b.__then")]
    j = df.withColumn("__want", _BEFORE[kind](F.col(date))).alias("a").join(prev.alias("b"), cond, "left").select("a.*", f"b.{metric}_{kind}_prev").drop("__want")
    p = F.col(f"{metric}_{kind}_prev")
    return j.withColumns({f"{metric}_{kind}_delta": F.col(metric) - p, f"{metric}_{kind}_pct": F.try_divide((F.col(metric) - p) * 100.0, p)})
