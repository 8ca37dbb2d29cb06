"""Deduplication, dimension joins, zero-filled grids and daily marts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.session import plan_bytes

#: A dimension whose estimated size is at most this is broadcast; a larger one is joined by key.
BROADCAST_BYTES = 64 << 20


def small(df: DataFrame, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``df`` with a broadcast hint if Catalyst's estimate of its size allows one."""
    return F.broadcast(df) if plan_bytes(df) <= limit else df


def dedup_latest(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row per key in ``order``, which must be a total order of the key's rows; null keys are a group."""
    w = W.partitionBy(*keys).orderBy(*order)
    return df.withColumn("__rn", F.row_number().over(w)).where("__rn = 1").drop("__rn")


def restrict_to(fact: DataFrame, dim: DataFrame, key: str) -> DataFrame:
    """Rows of the fact whose key the dimension has."""
    return fact.join(small(dim.select(key)), key, "left_semi")


def enrich(fact: DataFrame, dim: DataFrame, on: dict[str, str]) -> DataFrame:
    """Left join on differently named keys (fact -> dimension), which are not kept twice."""
    renamed = dim.withColumnsRenamed({d: f"__d_{d}" for d in on.values()})
    cond = [F.col(f) == F.col(f"__d_{d}") for f, d in on.items()]
    return fact.join(small(renamed), cond, "left").drop(*(f"__d_{d}" for d in on.values()))


def zero_fill(fact: DataFrame, dim: DataFrame, key: str, periods: list[str], metrics: list[str]) -> DataFrame:
    """Every dimension key for every period of the fact (all period columns together), missing metrics as 0. Fact keys that the
    dimension lacks are left out, as are duplicates of dimension keys. The grid is the result itself: keys times periods."""
    grid = dim.select(key).where(F.col(key).isNotNull()).distinct().crossJoin(small(fact.select(*periods).distinct()))
    return grid.join(fact, [key, *periods], "left").na.fill(0, metrics)


def daily(df: DataFrame, grain: list[str], sums: dict[str, str], counts: dict[str, str] | None = None, distincts: dict[str, str] | None = None) -> DataFrame:
    """One row per grain: name -> column to sum, to count, to count distinct values of."""
    aggs = [F.sum(c).alias(n) for n, c in sums.items()]
    aggs += [F.count(c).alias(n) for n, c in (counts or {}).items()] + [F.countDistinct(c).alias(n) for n, c in (distincts or {}).items()]
    return df.groupBy(*grain).agg(*aggs)


def sum_once(df: DataFrame, grain: list[str], by: list[str], value: str, name: str) -> DataFrame:
    """Sum of a value that is repeated on every row of its grain, counted once per grain."""
    return df.select(*dict.fromkeys([*grain, *by, value])).dropDuplicates(grain).groupBy(*by).agg(F.sum(value).alias(name))
