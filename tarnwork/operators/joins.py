"""Joins beyond the built-in ones: salted, as-of, and on validity periods."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from tarnwork.operators.shaping import dedup_latest


def salted_join(large: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", salt: int = 8) -> DataFrame:
    """Join with the keys of the large side spread over ``salt`` sub-keys. inner, left, left_semi and left_anti only: others
    would repeat unmatched rows of the small side. Try AQE's skew join first. The salt is a hash of the row, so a task that
    runs again gives the same rows. The copies of the small side are shuffled, never broadcast: Catalyst's estimate leaves them
    out, so the driver would build a table of ``salt`` times the rows that it expects."""
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError(f"a salted {how} join would repeat rows")
    a = large.withColumn("__salt", F.pmod(F.xxhash64(*large.columns), F.lit(salt)).cast("int"))
    b = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salt - 1)))).hint("merge")
    return a.join(b, [*keys, "__salt"], how).drop("__salt")


#: Aggregate -> (partial, how partials merge).
_SALTED = {"sum": (F.sum, F.sum), "count": (F.count, F.sum), "min": (F.min, F.min), "max": (F.max, F.max)}


def salted_aggregate(df: DataFrame, keys: list[str], value: str, kind: str, salt: int = 8) -> DataFrame:
    """sum, count, min, max or avg of ``value`` per key in two stages, the first over salted keys; the result is ``<kind>``."""
    s = F.pmod(F.xxhash64(*df.columns), F.lit(salt)).alias("__salt")
    d = df.select(*keys, value, s)
    if kind == "avg":
        part = d.groupBy(*keys, "__salt").agg(F.sum(value).alias("__s"), F.count(value).alias("__n"))
        return part.groupBy(*keys).agg(F.sum("__s").alias("__s"), F.sum("__n").alias("__n")).select(*keys, F.try_divide("__s", "__n").alias("avg"))
    first, merge = _SALTED[kind]
    return d.groupBy(*keys, "__salt").agg(first(value).alias("__p")).groupBy(*keys).agg(merge("__p").alias(kind))


def as_of(left: DataFrame, right: DataFrame, keys: list[str], left_ts: str, right_ts: str, cols: list[str], tie: str | None = None) -> DataFrame:
    """Each left row with ``cols`` of the latest right row of its key at or before its time; null if there is none.

    Both sides are united and sorted once per key, and the last right row is carried on: no pairs are built. Right rows of
    the same time go by ``tie``, the greatest counts; they count for a left row of that very time. Null keys match nothing.
    """
    names = [c for c in left.columns if c not in keys]
    a = left.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(left_ts).alias("__t"), F.lit(1).alias("__side"), F.struct(*names).alias("__l"), F.lit(None).cast(_struct_of(right, cols)).alias("__r"), F.lit(None).cast(right.schema[tie].dataType if tie else "int").alias("__tie"))
    b = right.select(*(F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)), F.col(right_ts).alias("__t"), F.lit(0).alias("__side"), F.lit(None).cast(a.schema["__l"].dataType).alias("__l"), F.struct(*cols).alias("__r"), (F.col(tie) if tie else F.lit(None).cast("int")).alias("__tie"))
    ks = [f"__k{i}" for i in range(len(keys))]
    w = W.partitionBy(*ks).orderBy("__t", "__side", "__tie").rowsBetween(W.unboundedPreceding, 0)
    ok = F.lit(True)
    for k in ks:
        ok = ok & F.col(k).isNotNull()
    u = a.unionByName(b).withColumn("__m", F.when(ok, F.last("__r", ignorenulls=True).over(w))).where("__side = 1")
    out = {k: F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)} | {c: F.col(f"__l.{c}").alias(c) for c in names}
    return u.select(*(out[c] for c in left.columns), *(F.col(f"__m.{c}").alias(c if c not in out else f"{c}_right") for c in cols))


def _struct_of(df: DataFrame, cols: list[str]):
    return StructType([StructField(df.schema[c].name, df.schema[c].dataType) for c in cols])


def valid_at(left: DataFrame, history: DataFrame, key: str, at: str, start: str, end: str, cols: list[str]) -> DataFrame:
    """Each left row with ``cols`` of the version valid at its time: start <= at < end, an end of null being open. Versions of
    a key must not overlap; then this is the as-of version, unless it has ended."""
    h = history.select(key, F.col(start).alias("__start"), F.col(end).alias("__end"), *cols)
    j = as_of(left, h, [key], at, "__start", [*cols, "__end"])
    live = F.col("__end").isNull() | (F.col("__end") > F.col(at))
    return j.select(*left.columns, *(F.when(live, F.col(c)).alias(c) for c in cols))


def lookup_features(labels: DataFrame, features: DataFrame, keys: list[str], names: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """Labels with features by key, unknown keys null. Of repeated feature keys the first in ``order`` counts, by default the
    one with the greatest values."""
    one = dedup_latest(features, keys, order or [F.desc_nulls_last(c) for c in names]).select(*keys, *names)
    return labels.join(one, keys, "left")
