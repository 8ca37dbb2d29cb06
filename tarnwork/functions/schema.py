"""Schema comparison, alignment and casting with error capture."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


def drift_report(source: DataFrame, target: DataFrame) -> DataFrame:
    """(column_name, change, source_type, target_type): new, removed, retyped or same; names are compared without case."""
    s, t = ({f.name.lower(): f.dataType.simpleString() for f in d.schema} for d in (source, target))
    rows = []
    for c in sorted(s.keys() | t.keys()):
        change = "new" if c not in t else "removed" if c not in s else "same" if s[c] == t[c] else "retyped"
        rows.append((c, change, s.get(c), t.get(c)))
    return source.sparkSession.createDataFrame(rows, "column_name string, change string, source_type string, target_type string")


def align_to(df: DataFrame, schema: T.StructType) -> DataFrame:
    """The columns of ``schema`` in its order: missing ones null, surplus ones left out, others cast (null if impossible)."""
    have = {c.lower(): c for c in df.columns}
    return df.select(*((F.col(have[f.name.lower()]).try_cast(f.dataType) if f.name.lower() in have else F.lit(None).cast(f.dataType)).alias(f.name) for f in schema))


def exact_round(c: str | Column, places: int = 2) -> Column:
    """Half-up rounding of a double by its decimal value: 19.275 gives 19.28 everywhere."""
    c = F.col(c) if isinstance(c, str) else c
    return F.round(c.cast("decimal(28,8)"), places).cast("double")


def round_floats(df: DataFrame, places: int = 2) -> DataFrame:
    """All float and double columns rounded, in one projection."""
    return df.select(*(exact_round(f.name, places).alias(f.name) if isinstance(f.dataType, (T.FloatType, T.DoubleType)) else F.col(f.name) for f in df.schema))


def cast_or_divert(df: DataFrame, casts: dict[str, str]) -> tuple[DataFrame, DataFrame]:
    """(good, bad): rows whose columns all take the types of ``casts``, cast; and the rest as they came with ``_errors``, the
    names of the columns that failed. A null is no failure."""
    failed = F.filter(F.array(*(F.when(F.col(c).isNotNull() & F.col(c).try_cast(t).isNull(), F.lit(c)) for c, t in casts.items())), lambda x: x.isNotNull())
    flagged = df.withColumn("_errors", failed)
    good = flagged.where(F.size("_errors") == 0).drop("_errors")
    return good.withColumns({c: F.col(c).try_cast(t) for c, t in casts.items()}), flagged.where(F.size("_errors") > 0)


def error_totals(df: DataFrame, casts: dict[str, str], limit: float) -> DataFrame:
    """(rows, errors, within): is the share of rows that ``cast_or_divert`` would divert at most ``limit``."""
    bad = F.lit(False)
    for c, t in casts.items():
        bad = bad | (F.col(c).isNotNull() & F.col(c).try_cast(t).isNull())
    n = df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(bad).alias("errors"))
    return n.withColumn("within", F.col("errors") <= F.lit(limit) * F.col("rows"))


def composite_id(cols: list[str], sep: str = "|", null: str = "\\N") -> Column:
    """A key of several columns as text; nulls are marked, so ('a', null) and (null, 'a') differ."""
    return F.concat_ws(sep, *(F.coalesce(F.col(c).cast("string"), F.lit(null)) for c in cols))


def feature_type(t: T.DataType) -> str:
    """Integral, Fractional or String of a feature store."""
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "Integral"
    return "Fractional" if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)) else "String"
