"""Problem 1: a few site codes hold most rows of sales."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.tree_agg import heavy_keys, tree_aggregate
from tarnwork.sources.tables import table

WELL_FORMED_AMOUNT = r"^-?[0-9]+\.[0-9]{2}\z"


def p1_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """site_code (trimmed, upper case; null and blank are the group null), rows, amount (sum of the well-formed ones), days."""
    sales = table(spark, sf_dir, "sales")
    amount = F.when(F.col("amount").rlike(WELL_FORMED_AMOUNT), F.expr("try_cast(amount AS DECIMAL(18,2))"))
    return tree_aggregate(
        sales,
        {"site_code": F.nullif(F.upper(F.trim("site_code")), F.lit(""))},
        {"rows": ("count", F.lit(1)), "amount": ("sum", amount)},
        ("days", F.to_date("record_date")),
    )


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    sales = table(spark, sf_dir, "sales")
    per_site = tree_aggregate(sales, {"site_code": F.upper(F.trim("site_code"))}, {"rows": ("count", F.lit(1))})
    return heavy_keys(per_site, "site_code", "rows", sales.agg(F.count(F.lit(1)).alias("total")), 0.02)


QUERIES = {"p1_found": p1_found, "p1_sites": p1_sites}
ORACLE = {
    "p1_found": """
        SELECT upper(trim(site_code)) AS site_code FROM sales
        WHERE trim(site_code) <> '' GROUP BY 1
        HAVING count(*) >= 0.02 * (SELECT count(*) FROM sales)""",
    "p1_sites": r"""
        SELECT nullif(upper(trim(site_code)), '') AS site_code, CAST(count(*) AS BIGINT) AS rows,
               CAST(sum(CASE WHEN regexp_full_match(amount, '-?[0-9]+\.[0-9]{2}') THEN try_cast(amount AS DECIMAL(18,2)) END) AS DECIMAL(28,2)) AS amount,
               CAST(count(DISTINCT CAST(record_date AS DATE)) AS BIGINT) AS days
        FROM sales GROUP BY 1""",
}
