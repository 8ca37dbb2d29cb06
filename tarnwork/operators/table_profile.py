"""Profile of a table for sizing jobs: volume, skew, duplicates, nulls."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def skew(df: DataFrame, keys: list[str]) -> DataFrame:
    """(max_rows, avg_rows, skew_ratio, null_share, verdict): how uneven the rows per key are; nulls of the first key column."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    s = per.agg(F.max("n").alias("max_rows"), F.avg("n").alias("avg_rows"), F.sum("n").alias("__all"), F.sum(F.when(F.col(keys[0]).isNull(), F.col("n")).otherwise(0)).alias("__null"))
    ratio, null = F.try_divide(F.col("max_rows"), F.col("avg_rows")), F.coalesce(F.try_divide("__null", "__all"), F.lit(0.0))
    verdict = F.when((ratio > 3) | (null > 0.8), "SKEWED").otherwise("EVEN")
    return s.select("max_rows", "avg_rows", ratio.alias("skew_ratio"), null.alias("null_share"), verdict.alias("verdict"))


def volume(df: DataFrame, key: str, period: str) -> DataFrame:
    """rows, distinct_keys (exact), periods, first_period, last_period."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.countDistinct(key).alias("distinct_keys"), F.countDistinct(period).alias("periods"), F.min(period).alias("first_period"), F.max(period).alias("last_period"))


def volume_estimate(df: DataFrame, key: str, period: str) -> DataFrame:
    """As ``volume`` with an approximate number of keys: one pass, no expansion of distinct values."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.approx_count_distinct(key).alias("distinct_keys"), F.approx_count_distinct(period).alias("periods"), F.min(period).alias("first_period"), F.max(period).alias("last_period"))


def distribution(df: DataFrame, period: str) -> DataFrame:
    """Rows per period and their share of all; as many rows as periods."""
    per = df.groupBy(period).agg(F.count(F.lit(1)).alias("rows"))
    return per.withColumn("share", F.col("rows") * 100.0 / F.sum("rows").over(W.partitionBy()))


def key_statistics(df: DataFrame, keys: list[str]) -> DataFrame:
    """Rows per key: keys, average, standard deviation, bounds, p50 to p99 (values that occur), coefficient of variation."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    p = lambda q: F.percentile_disc("n", q) if hasattr(F, "percentile_disc") else F.expr(f"percentile_disc({q}) WITHIN GROUP (ORDER BY n)")
    # counts of counts first: what the percentiles keep is small whatever the number of keys
    return per.agg(
        F.count(F.lit(1)).alias("keys"), F.avg("n").alias("avg_rows"), F.stddev_samp("n").alias("std_rows"), F.min("n").alias("min_rows"), F.max("n").alias("max_rows"),
        p(0.5).alias("p50"), p(0.9).alias("p90"), p(0.95).alias("p95"), p(0.99).alias("p99"), F.try_divide(F.stddev_samp("n"), F.avg("n")).alias("cv"),
    )


def duplicates(df: DataFrame, keys: list[str]) -> DataFrame:
    """rows, distinct_keys, duplicate_rows."""
    per = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    return per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count(F.lit(1)).alias("distinct_keys"), F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("duplicate_rows"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("rows")).where("rows > 1")


def null_shares(df: DataFrame) -> DataFrame:
    """(column_name, nulls, null_pct, severity) of every column, in one pass."""
    n = F.count(F.lit(1))
    one = df.agg(n.alias("__n"), *(F.count_if(F.col(f"`{c}`").isNull()).alias(f"__{i}") for i, c in enumerate(df.columns)))
    long = one.select("__n", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"__{i}").alias("nulls")) for i, c in enumerate(df.columns)))).alias("x")).select("__n", "x.*")
    pct = F.coalesce(F.try_divide(F.col("nulls") * 100.0, "__n"), F.lit(0.0))
    return long.select("column_name", "nulls", pct.alias("null_pct"), F.when(pct > 50, "CRITICAL").when(pct > 10, "HIGH").otherwise("OK").alias("severity"))


def top_keys(df: DataFrame, key: str, n: int = 10) -> DataFrame:
    """The ``n`` most frequent keys with their share of all rows; ties by key."""
    per = df.groupBy(key).agg(F.count(F.lit(1)).alias("rows"))
    total = df.agg(F.count(F.lit(1)).alias("__all"))
    return per.crossJoin(F.broadcast(total)).select(key, "rows", (F.col("rows") * 100.0 / F.col("__all")).alias("share")).orderBy(F.desc("rows"), key).limit(n)


def row_bytes(df: DataFrame) -> DataFrame:
    """(avg_row_bytes): mean length of a row as JSON, over all rows."""
    return df.agg(F.avg(F.length(F.to_json(F.struct("*")))).alias("avg_row_bytes"))


def quality_score(duplicate_pct: float, avg_null_pct: float) -> float:
    return 100.0 - min(duplicate_pct, 30.0) - min(avg_null_pct, 30.0)


def union_groups(profiles: DataFrame) -> DataFrame:
    """Profiles (union_group, size_gb, rows, skew_ratio) rolled up by group; a null group stays single."""
    return profiles.groupBy("union_group").agg(F.count(F.lit(1)).alias("sources"), F.sum("size_gb").alias("size_gb"), F.sum("rows").alias("rows"), F.max("skew_ratio").alias("skew_ratio"))
