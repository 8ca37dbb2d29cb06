"""Data-quality checks of a table, fused into one aggregation."""

from __future__ import annotations

from dataclasses import dataclass, field
from enum import Enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.plans.runtime import ChecksFailed

RESULT = "check_name string, kind string, severity string, status string, metric double, threshold double, message string"


class Severity(str, Enum):
    CRITICAL = "CRITICAL"
    WARNING = "WARNING"
    INFO = "INFO"


@dataclass(frozen=True)
class Check:
    """kind: row_count (min), completeness (column, max share missing), schema (columns), freshness (column, max_age in days
    against as_of, or only non-null), rule (condition that must hold for every row), unique (columns), reconciliation (source
    rows, tolerance)."""

    name: str
    kind: str
    severity: Severity = Severity.CRITICAL
    params: dict = field(default_factory=dict)


def _missing(df: DataFrame, c: str) -> Column:
    blank = F.trim(F.col(c)) == "" if dict(df.dtypes).get(c) == "string" else F.lit(False)
    return F.count_if(F.col(c).isNull() | blank)


def _measure(df: DataFrame, k: Check) -> Column:
    p = k.params
    if k.kind == "row_count":
        return F.count(F.lit(1)).cast("double")
    if k.kind == "completeness":
        return F.try_divide(_missing(df, p["column"]).cast("double"), F.count(F.lit(1)))
    if k.kind == "freshness":
        top = F.max(p["column"])
        return F.datediff(F.lit(p["as_of"]).cast("date"), top.cast("date")).cast("double") if "as_of" in p else F.when(top.isNotNull(), 0.0)
    if k.kind == "rule":
        return F.count_if(~F.coalesce(F.expr(p["condition"]), F.lit(False))).cast("double")
    if k.kind == "reconciliation":
        return F.try_divide(F.abs(F.count(F.lit(1)) - p["source_rows"]).cast("double"), F.lit(float(p["source_rows"])))
    raise ValueError(f"unknown kind of check: {k.kind}")


def _judge(k: Check, m: float | None) -> tuple[str, float | None, str]:
    p = k.params
    if k.kind == "row_count":
        lim, ok = float(p.get("min", 100)), m is not None and m >= p.get("min", 100)
    elif k.kind == "completeness":
        lim, ok = float(p.get("max", 0.5)), m is not None and m <= p.get("max", 0.5)
    elif k.kind == "freshness":
        lim, ok = float(p.get("max_age", 0)), m is not None and ("as_of" not in p or m <= p.get("max_age", 0))
    elif k.kind == "reconciliation":
        lim, ok = float(p.get("tolerance", 0.01)), m is not None and m <= p.get("tolerance", 0.01)
    else:
        lim, ok = 0.0, m == 0
    return ("PASS" if ok else "FAIL"), lim, f"{k.kind} is {m}, limit {lim}"


def run_checks(df: DataFrame, checks: list[Check]) -> DataFrame:
    """One row per check (RESULT). All row-wise measures come from one pass; uniqueness needs one more each. A check that cannot
    be computed has the status ERROR, which is never a pass; an empty table fails completeness and freshness."""
    spark, out = df.sparkSession, {}
    fused: list[tuple[Check, Column]] = []
    for k in checks:
        if k.kind == "schema":
            lost = [c for c in k.params["columns"] if c not in df.columns]
            out[k.name] = ("FAIL" if lost else "PASS", float(len(lost)), 0.0, f"missing columns: {', '.join(lost) or 'none'}")
            continue
        try:
            if k.kind == "unique":
                n = df.groupBy(*k.params["columns"]).agg(F.count(F.lit(1)).alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("d")).first()["d"]
                out[k.name] = ("PASS" if n == 0 else "FAIL", float(n), 0.0, f"{n} surplus rows")
                continue
            m = _measure(df, k).alias(k.name)
            df.agg(m)  # analysis alone: an unknown column must not break the others
            fused.append((k, m))
        except Exception as e:
            out[k.name] = ("ERROR", None, None, str(e).split("\n")[0][:200])
    if fused:
        try:
            row = df.agg(*(m for _, m in fused)).first()
            values = {k.name: row[k.name] for k, _ in fused}
        except Exception:  # a rule that fails on some row: find out which, one by one
            values = {}
            for k, m in fused:
                try:
                    values[k.name] = df.agg(m).first()[0]
                except Exception as e:
                    out[k.name] = ("ERROR", None, None, str(e).split("\n")[0][:200])
        for k, _ in fused:
            if k.name in values:
                s, lim, msg = _judge(k, values[k.name])
                out[k.name] = (s, values[k.name], lim, msg)
    return spark.createDataFrame([(k.name, k.kind, k.severity.value, *out[k.name]) for k in checks], RESULT)


def has_failures(results: DataFrame) -> bool:
    """Does a critical check fail, or could not be computed?"""
    return not results.where("severity = 'CRITICAL' AND status <> 'PASS'").isEmpty()


def bronze_suite(columns: list[str], min_rows: int = 1) -> list[Check]:
    return [Check("rows", "row_count", params={"min": min_rows}), Check("schema", "schema", params={"columns": [*columns, "_ingest_ts", "_source_system"]})]


def silver_suite(keys: list[str], period: str, min_rows: int = 1) -> list[Check]:
    return [Check("rows", "row_count", params={"min": min_rows}), *(Check(f"{k}_filled", "completeness", params={"column": k, "max": 0.0}) for k in keys), Check("unique", "unique", params={"columns": keys}), Check("fresh", "freshness", Severity.WARNING, {"column": period})]


def gold_suite(grain: list[str], metrics: list[str], period: str, min_rows: int = 1) -> list[Check]:
    return [*silver_suite(grain, period, min_rows), *(Check(f"{m}_not_negative", "rule", Severity.WARNING, {"condition": f"`{m}` >= 0"}) for m in metrics)]


def feature_suite(keys: list[str], features: list[str], period: str, min_rows: int = 1, max_null: float = 0.1) -> list[Check]:
    return [*silver_suite(keys, period, min_rows), Check("schema", "schema", params={"columns": [*keys, *features]}), *(Check(f"{f}_filled", "completeness", Severity.WARNING, {"column": f, "max": max_null}) for f in features)]


def require(results: DataFrame) -> None:
    """Raise if a critical check does not pass."""
    if has_failures(results):
        raise ChecksFailed("; ".join(f"{r.check_name}: {r.message}" for r in results.where("severity = 'CRITICAL' AND status <> 'PASS'").collect()))
