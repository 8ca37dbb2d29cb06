"""Features of time series and categories, and splits for evaluation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def lags(df: DataFrame, keys: list[str], order: list[str], cols: list[str], steps: tuple[int, ...] = (1, 7, 30)) -> DataFrame:
    """``<col>_lag_<n>``: the value n rows before."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumns({f"{c}_lag_{n}": F.lag(c, n).over(w) for c in cols for n in steps})


def rolling(df: DataFrame, keys: list[str], order: list[str], cols: list[str], sizes: tuple[int, ...] = (7, 30, 90)) -> DataFrame:
    """``<col>_avg_<n>``, ``_std_<n>``, ``_cv_<n>`` over the last n rows; the coefficient of variation is null at a mean of 0."""
    out = {}
    for n in sizes:
        w = W.partitionBy(*keys).orderBy(*order).rowsBetween(1 - n, 0)
        for c in cols:
            avg, std = F.avg(c).over(w), F.stddev_samp(c).over(w)
            out |= {f"{c}_avg_{n}": avg, f"{c}_std_{n}": std, f"{c}_cv_{n}": F.try_divide(std, avg)}
    return df.withColumns(out)


def z_scores(df: DataFrame, keys: list[str], order: list[str], col: str, size: int = 7) -> DataFrame:
    """``roll_mean``, ``roll_std``, ``z_score`` (deviation from the rolling mean, its standard deviation at least 1e-6), and the
    value 1 and ``size`` rows before."""
    o = W.partitionBy(*keys).orderBy(*order)
    w = o.rowsBetween(1 - size, 0)
    mean, std = F.avg(col).over(w), F.coalesce(F.stddev_samp(col).over(w), F.lit(0.0))
    return df.withColumns({"roll_mean": mean, "roll_std": std, "z_score": (F.col(col) - mean) / F.greatest(std, F.lit(1e-6)), f"{col}_lag_1": F.lag(col, 1).over(o), f"{col}_lag_{size}": F.lag(col, size).over(o)})


def calendar(df: DataFrame, date: Column | str) -> DataFrame:
    """day_of_week (1 is Sunday), day_of_month, month, is_weekend, and weekday and month on the circle."""
    d = F.col(date) if isinstance(date, str) else date
    dow, mon = F.dayofweek(d), F.month(d)
    turn = lambda x, n: x * (2 * F.pi() / n)
    return df.withColumns(
        {"day_of_week": dow, "day_of_month": F.dayofmonth(d), "month": mon, "is_weekend": dow.isin(1, 7).cast("int"), "dow_sin": F.sin(turn(dow, 7)), "dow_cos": F.cos(turn(dow, 7)), "month_sin": F.sin(turn(mon, 12)), "month_cos": F.cos(turn(mon, 12))}
    )


def category_index(df: DataFrame, col: str) -> DataFrame:
    """(col, <col>_index): 0 for the most frequent value, ties in alphabetical order; nulls get none. Join it to new data with a
    left join: unseen values stay, without index. One row per distinct value is ordered in one place."""
    n = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("__n"))
    return n.select(col, (F.row_number().over(W.orderBy(F.desc("__n"), col)) - 1).alias(f"{col}_index"))


def temporal_split(df: DataFrame, date: str, days: int) -> DataFrame:
    """``split``: test for the last ``days`` days up to the greatest date, else train."""
    cut = df.agg(F.date_sub(F.max(date).cast("date"), days).alias("__cut"))
    return df.crossJoin(F.broadcast(cut)).withColumn("split", F.when(F.col(date).cast("date") > F.col("__cut"), "test").otherwise("train")).drop("__cut")


def hash_split(df: DataFrame, keys: list[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """``split`` by a hash of the keys: the same row always falls on the same side, and so do all rows of a key."""
    h = F.pmod(F.xxhash64(F.lit(seed), *keys), F.lit(10_000))
    return df.withColumn("split", F.when(h < int(test * 10_000), "test").otherwise("train"))


def stratified_split(df: DataFrame, stratum: str, keys: list[str], test: float = 0.2, seed: int = 42) -> DataFrame:
    """As ``hash_split``, with the share of test rows exact in every stratum (rounded down). Ranks come from hash buckets
    counted first, so only the rows of one bucket and stratum are sorted together."""
    d = df.withColumn("__h", F.xxhash64(F.lit(seed), *keys))
    d = d.withColumn("__b", F.shiftright("__h", 54))
    n = d.groupBy(stratum, "__b").agg(F.count(F.lit(1)).alias("__n"))
    before = n.select(F.col(stratum).alias("__st"), F.col("__b").alias("__bb"), (F.sum("__n").over(W.partitionBy(stratum).orderBy("__b")) - F.col("__n")).alias("__off"), F.sum("__n").over(W.partitionBy(stratum)).alias("__all"))
    j = d.join(before, F.col(stratum).eqNullSafe(F.col("__st")) & (F.col("__b") == F.col("__bb")))
    rank = F.col("__off") + F.row_number().over(W.partitionBy(stratum, "__b").orderBy("__h", *keys))
    return j.withColumn("split", F.when(rank <= F.floor(F.col("__all") * test), "test").otherwise("train")).select(*df.columns, "split")
