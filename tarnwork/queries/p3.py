"""Problem 3: totals over the trailing 7 and 30 days of every site, days without rows included."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.clean import code, day_int, day_of
from tarnwork.operators.rolling import latest_by, trailing_totals
from tarnwork.sources.tables import table


def _totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    mart = table(spark, sf_dir, "sales_mart").select(code("site_code").alias("site_code"), "product", day_of("data_dt").alias("day"), "daily_amount", "load_ts")
    mart = mart.where("site_code IS NOT NULL AND day IS NOT NULL")
    last = latest_by(mart, ["site_code", "product", "day"], "load_ts", "daily_amount")
    cents = last.select("site_code", "day", F.round(F.col("daily_amount") * 100).cast("long").alias("cents"))
    return trailing_totals(cents, "site_code", "day", "cents")


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    quiet = "total_7 = 0 AND total_30 > 0"
    surge = "datediff(day, first_day) >= 29 AND total_7 > 0 AND 5 * total_7 > 3 * total_30"
    return _totals(spark, sf_dir).where(f"({quiet}) OR ({surge})").select("site_code", day_int("day").alias("data_dt"))


def p3_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Averages are over all days of the window; days before the first count as 0."""
    return _totals(spark, sf_dir).select(
        "site_code",
        day_int("day").alias("data_dt"),
        *((F.col(f"total_{w}") / 100).cast("decimal(20,2)").alias(f"amount_{w}d") for w in (7, 30)),
        *((F.col(f"total_{w}") / (100.0 * w)).alias(f"avg_{w}d") for w in (7, 30)),
    )


QUERIES = {"p3_found": p3_found, "p3_rolling": p3_rolling}

_DAYS = """
    WITH m AS (
      SELECT upper(trim(site_code)) AS site_code, product, CASE WHEN data_dt BETWEEN 10101 AND 99991231 THEN CAST(try_strptime(lpad(CAST(data_dt AS VARCHAR), 8, '0'), '%Y%m%d') AS DATE) END AS d, daily_amount, load_ts
      FROM sales_mart WHERE trim(site_code) <> ''),
    last AS (
      SELECT site_code, product, d, CAST(round(coalesce(daily_amount, 0) * 100) AS BIGINT) AS cents FROM m WHERE d IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY site_code, product, d ORDER BY load_ts DESC NULLS LAST, daily_amount DESC NULLS LAST) = 1),
    s AS (SELECT site_code, d, sum(cents) AS a FROM last GROUP BY 1, 2),
    b AS (SELECT site_code, min(d) AS lo, max(d) AS hi FROM s GROUP BY 1),
    g AS (SELECT site_code, lo, unnest(generate_series(lo, hi, INTERVAL 1 DAY))::DATE AS d FROM b),
    f AS (SELECT g.site_code, g.lo, g.d, coalesce(s.a, 0) AS a FROM g LEFT JOIN s ON s.site_code = g.site_code AND s.d = g.d),
    t AS (
      SELECT site_code, lo, d,
             sum(a) OVER (PARTITION BY site_code ORDER BY d ROWS 6 PRECEDING) AS t7,
             sum(a) OVER (PARTITION BY site_code ORDER BY d ROWS 29 PRECEDING) AS t30 FROM f)
"""
ORACLE = {
    "p3_found": _DAYS
    + """
    SELECT site_code, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS data_dt FROM t
    WHERE (t7 = 0 AND t30 > 0) OR (d - lo >= 29 AND t7 > 0 AND 5 * t7 > 3 * t30)""",
    "p3_rolling": _DAYS
    + """
    SELECT site_code, CAST(strftime(d, '%Y%m%d') AS INTEGER) AS data_dt,
           CAST(CAST(t7 AS DECIMAL(22,2)) / 100 AS DECIMAL(20,2)) AS amount_7d, CAST(CAST(t30 AS DECIMAL(22,2)) / 100 AS DECIMAL(20,2)) AS amount_30d,
           CAST(t7 AS DOUBLE) / 700.0 AS avg_7d, CAST(t30 AS DOUBLE) / 3000.0 AS avg_30d FROM t""",
}
