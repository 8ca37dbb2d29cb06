"""Problem 2: a profile of every load of sales, and what is wrong with it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.two_sample import exact_medians, load_tests
from tarnwork.session import cut, plan_bytes
from tarnwork.sources.tables import table

COLUMNS = ["transaction_id", "amount", "record_date"]
TXN = r"^TXN-[0-9]{8}-[0-9]{10}\z"
AMOUNT = r"^-?[0-9]+\.[0-9]{2}\z"
DAY_US = 86_400_000_000
#: Per-load tables up to this size are broadcast to the scan; larger ones are joined by key.
BROADCAST_BYTES = 32 << 20


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    filled = lambda c: F.col(c).isNotNull() & (F.trim(c) != "")
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    s = table(spark, sf_dir, "sales").where("load_id IS NOT NULL")
    ok = F.coalesce(F.col("amount").rlike(AMOUNT), F.lit(False))
    # cents beyond 18 digits count as the greatest or least value, which is out of bounds and not shown as a bound
    far = F.when(F.col("amount").startswith("-"), F.lit(-(10**18))).otherwise(F.lit(10**18))
    cents = F.coalesce(F.expr("try_cast(replace(amount, '.', '') AS BIGINT)"), far)
    return s.select(
        "load_id",
        "_source_system",
        "transaction_id",
        "amount",
        "record_date",
        filled("transaction_id").alias("f_txn"),
        filled("amount").alias("f_amount"),
        F.coalesce(F.col("transaction_id").rlike(TXN), F.lit(False)).alias("ok_txn"),
        ok.alias("ok_amount"),
        F.when(ok, F.greatest(F.least(cents, F.lit(10**18)), F.lit(-(10**18)))).alias("cents"),
        (us("_ingest_ts") - us("record_date")).alias("age"),
    )


def _log_bin(x: Column, base: float, first: int, top: int) -> Column:
    return (F.lit(first) + F.least(F.floor(F.log1p(x) / F.log(F.lit(base))), F.lit(top - first))).cast("int")


def _bins() -> dict[str, tuple[Column, int]]:
    """Coarse bins for the model of all columns: what is filled, well-formed, and about how large."""
    txn = F.when(F.col("ok_txn"), 2).when(F.col("f_txn"), 1).otherwise(0)
    amount = F.when(~F.col("f_amount") | F.col("f_amount").isNull(), 0).when(F.col("cents").isNull(), 1).when(F.col("cents") < 0, 2).otherwise(_log_bin(F.col("cents") / 100.0, 2.25, 3, 15))
    age = F.when(F.col("age").isNull(), 0).when(F.col("age") < 0, 1).otherwise(_log_bin(F.col("age") / (DAY_US / 4.0), 1.6, 2, 15))
    return {"transaction_id": (txn, 3), "amount": (amount, 16), "record_date": (age, 16)}


def _fine() -> dict[str, Column]:
    """Bins of single columns, narrower than a shift: values of one bin are at most 1.2 times apart, or less than a day."""
    c = F.col("cents")
    size = (F.lit(1) + F.floor(F.log(F.abs(c).cast("double")) / F.log(F.lit(1.2)))).cast("long")
    return {"amount": F.when(c == 0, F.lit(0).cast("long")).when(c > 0, size).when(c < 0, -size), "record_date": F.floor(F.col("age") / F.lit(DAY_US))}


def _tests(rows: DataFrame) -> DataFrame:
    fold = F.pmod(F.xxhash64("transaction_id", "amount", "record_date"), F.lit(2))
    return cut(load_tests(rows, "load_id", "_source_system", _bins(), fold, _fine()), "tests")


def _base(rows: DataFrame) -> DataFrame:
    """Exact counts of each load, in one pass."""
    n = lambda c: F.count_if(c)
    return rows.groupBy(F.col("load_id").alias("load")).agg(
        F.count(F.lit(1)).alias("rows"),
        n("f_txn").alias("f_transaction_id"),
        n("f_amount").alias("f_amount"),
        F.count("record_date").alias("f_record_date"),
        n(F.expr("f_txn AND NOT ok_txn")).alias("ill_transaction_id"),
        n(F.expr("f_amount AND NOT ok_amount")).alias("ill_amount"),
        n("ok_amount").alias("ok_amount"),
        n(F.expr("cents < -1000000 OR cents > 10000000")).alias("out_amount"),
        n(F.col("record_date").isNotNull() & ((F.col("age") < 0) | (F.col("age") > 120 * DAY_US))).alias("out_record_date"),
        F.min(F.when(F.col("f_txn"), F.col("transaction_id"))).alias("min_transaction_id"),
        F.max(F.when(F.col("f_txn"), F.col("transaction_id"))).alias("max_transaction_id"),
        F.min(F.when(F.abs("cents") < 10**18, F.col("cents"))).alias("min_amount"),
        F.max(F.when(F.abs("cents") < 10**18, F.col("cents"))).alias("max_amount"),
        F.min("record_date").alias("min_record_date"),
        F.max("record_date").alias("max_record_date"),
    )


def _values(rows: DataFrame, column: str, filled: str) -> DataFrame:
    """Distinct filled values of a column and the rows of the most frequent one, by load."""
    per = rows.where(filled).groupBy(F.col("load_id").alias("load"), column).agg(F.count(F.lit(1)).alias("c"))
    return per.groupBy("load").agg(F.count(F.lit(1)).alias(f"distinct_{column}"), F.max("c").alias(f"top_{column}"))


def _shifts(rows: DataFrame, tests: DataFrame) -> DataFrame:
    """(load, column): the pairs of loads that the model of the column tells apart, in which the exact median has moved.

    Where the model does not tell them apart, each bin holds the same share of both, the middle values lie in the same bins
    and the median cannot have moved. Below zero a ratio says nothing of a distance, so a middle value there passes too.
    """
    names = list(_fine())
    told = F.array(*(F.when(F.col(f"differs_{c}") | (F.col("lo_amount") < 0 if c == "amount" else F.lit(False)), F.lit(c)) for c in names))
    pairs = tests.where("prev IS NOT NULL").select("load", "prev", F.explode(told).alias("column")).where("column IS NOT NULL")
    ask = pairs.select("load").union(pairs.select("prev")).distinct()
    wanted = tests.join(ask, "load", "left_semi")
    small = plan_bytes(tests) <= BROADCAST_BYTES
    fine = _fine()
    values = rows.select(
        F.col("load_id").alias("load"),
        F.inline(
            F.array(
                F.struct(F.lit("amount").alias("column"), fine["amount"].alias("bin"), F.col("cents").alias("value")),
                F.struct(F.lit("record_date").alias("column"), fine["record_date"].alias("bin"), F.col("age").alias("value")),
            )
        ),
    ).where("value IS NOT NULL")
    med = cut(exact_medians(values, F.broadcast(wanted) if small else wanted, names), "medians")
    two = pairs.join(med, ["load", "column"]).join(med.select(F.col("load").alias("prev"), "column", F.col("twice").alias("old")), ["prev", "column"])
    moved = F.when(F.col("column") == "amount", F.expr("2 * CAST(twice AS DECIMAL(30,0)) > 3 * CAST(old AS DECIMAL(30,0)) OR 3 * CAST(twice AS DECIMAL(30,0)) < 2 * CAST(old AS DECIMAL(30,0))")).otherwise(F.abs(F.col("twice") - F.col("old")) > 4 * DAY_US)
    return two.where(moved).select("load", F.col("column"))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of every load: shifts among the pairs that the classifier tells apart, the rest by exact counts."""
    rows = _rows(spark, sf_dir)
    base = _base(rows).join(_values(rows, "transaction_id", "f_txn"), "load", "left").join(_values(rows, "amount", "f_amount"), "load", "left")
    tests = [(c, "null_rate", f"rows - f_{c} > 0.05 * rows") for c in COLUMNS]
    tests += [(c, "form", f"ill_{c} > 0.01 * f_{c}") for c in COLUMNS[:2]]
    tests += [("amount", "bounds", "out_amount > 0.01 * ok_amount"), ("record_date", "bounds", "out_record_date > 0.01 * f_record_date")]
    tests += [("transaction_id", "repeats", "distinct_transaction_id < 0.98 * f_transaction_id"), ("amount", "repeats", "top_amount > 0.1 * rows")]
    each = F.array(*(F.when(F.expr(x), F.struct(F.lit(c).alias("column_name"), F.lit(f).alias("finding"))) for c, f, x in tests))
    exact = base.select(F.col("load").alias("load_id"), F.explode(F.filter(each, lambda v: v.isNotNull())).alias("x")).select("load_id", "x.column_name", "x.finding")
    shift = _shifts(rows, _tests(rows)).select(F.col("load").alias("load_id"), F.col("column").alias("column_name"), F.lit("shift").alias("finding"))
    return exact.unionByName(shift)


def p2_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per load and column; ``auc_only`` and ``auc_drop`` compare with the load before in the system."""
    rows = _rows(spark, sf_dir)
    t = _tests(rows)
    base = _base(rows).join(t.drop("rows", "system"), "load", "left")
    for c, filled in zip(COLUMNS, ("f_txn", "f_amount", "record_date IS NOT NULL")):
        base = base.join(_values(rows, c, filled), "load", "left")
    lit = F.lit
    none = lit(None).cast("long")
    parts = [
        F.struct(
            lit(c).alias("column_name"),
            (1 - F.col(f"f_{c}") / F.col("rows")).alias("null_rate"),
            F.coalesce(f"distinct_{c}", lit(0)).alias("distinct_values"),
            (F.col("min_amount") / 100 if c == "amount" else F.col(f"min_{c}")).cast("string").alias("low"),
            (F.col("max_amount") / 100 if c == "amount" else F.col(f"max_{c}")).cast("string").alias("high"),
            (none if c == "record_date" else F.col(f"ill_{c}")).alias("ill_formed"),
            (none if c == "transaction_id" else F.col(f"out_{c}")).alias("out_of_bounds"),
            F.col(f"auc_only_{c}").alias("auc_only"),
            F.col(f"auc_drop_{c}").alias("auc_drop"),
        )
        for c in COLUMNS
    ]
    return base.select(F.col("load").alias("load_id"), F.col("prev").alias("load_before"), "rows", "auc", F.explode(F.array(*parts)).alias("x")).select("load_id", "load_before", "rows", "auc", "x.*")


def p2_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The exact part of the profile."""
    return p2_profile(spark, sf_dir).select("load_id", "load_before", "column_name", "rows", "null_rate", "distinct_values", "ill_formed", "out_of_bounds")


QUERIES = {"p2_found": p2_found, "p2_profile": p2_profile, "p2_counts": p2_counts}
_LOADS = r"""
    WITH r AS (
      SELECT *, trim(transaction_id) <> '' AS ft, trim(amount) <> '' AS fa, regexp_full_match(transaction_id, 'TXN-[0-9]{8}-[0-9]{10}') AS okt,
             CASE WHEN regexp_full_match(amount, '-?[0-9]+\.[0-9]{2}') THEN CAST(replace(amount, '.', '') AS BIGINT) END AS cents,
             epoch_us(_ingest_ts) - epoch_us(record_date) AS age
      FROM sales WHERE load_id IS NOT NULL),
    b AS (
      SELECT load_id, min(_source_system) AS sys, count(*) AS n, count(*) FILTER (ft) AS ft, count(*) FILTER (fa) AS fa, count(record_date) AS fd,
             count(*) FILTER (ft AND NOT okt) AS it, count(*) FILTER (fa AND cents IS NULL) AS ia, count(cents) AS ok,
             count(*) FILTER (cents < -1000000 OR cents > 10000000) AS oa, count(*) FILTER (age < 0 OR age > 120 * 86400000000) AS od,
             count(DISTINCT transaction_id) FILTER (ft) AS dt, median(cents::DOUBLE) AS ma, median(age::DOUBLE) AS mg
      FROM r GROUP BY 1),
    t AS (SELECT load_id, max(c) AS top FROM (SELECT load_id, amount, count(*) AS c FROM r WHERE fa GROUP BY 1, 2) GROUP BY 1),
    a AS (
      SELECT b.*, t.top, lag(ma) OVER w AS pa, lag(mg) OVER w AS pg FROM b LEFT JOIN t USING (load_id) WINDOW w AS (PARTITION BY sys ORDER BY b.load_id))
"""
ORACLE = {
    "p2_found": _LOADS + r"""
    SELECT load_id, 'transaction_id' AS column_name, 'null_rate' AS finding FROM a WHERE n - ft > 0.05 * n
    UNION ALL SELECT load_id, 'amount', 'null_rate' FROM a WHERE n - fa > 0.05 * n
    UNION ALL SELECT load_id, 'record_date', 'null_rate' FROM a WHERE n - fd > 0.05 * n
    UNION ALL SELECT load_id, 'transaction_id', 'form' FROM a WHERE it > 0.01 * ft
    UNION ALL SELECT load_id, 'amount', 'form' FROM a WHERE ia > 0.01 * fa
    UNION ALL SELECT load_id, 'amount', 'bounds' FROM a WHERE oa > 0.01 * ok
    UNION ALL SELECT load_id, 'record_date', 'bounds' FROM a WHERE od > 0.01 * fd
    UNION ALL SELECT load_id, 'transaction_id', 'repeats' FROM a WHERE dt < 0.98 * ft
    UNION ALL SELECT load_id, 'amount', 'repeats' FROM a WHERE top > 0.1 * n
    UNION ALL SELECT load_id, 'amount', 'shift' FROM a WHERE 2 * ma > 3 * pa OR 3 * ma < 2 * pa
    UNION ALL SELECT load_id, 'record_date', 'shift' FROM a WHERE abs(mg - pg) > 2 * 86400000000::DOUBLE""",
    "p2_counts": _LOADS.rstrip().replace("b.*, t.top,", "b.*, t.top, CAST(da AS BIGINT) AS da, lag(b.load_id) OVER w AS pl,").replace("max(c) AS top", "max(c) AS top, count(*) AS da") + r""",
    dd AS (SELECT load_id, CAST(count(DISTINCT record_date) AS BIGINT) AS dd FROM r GROUP BY 1)
    SELECT load_id, pl AS load_before, 'transaction_id' AS column_name, CAST(n AS BIGINT) AS rows, 1 - ft / n AS null_rate, CAST(dt AS BIGINT) AS distinct_values, CAST(it AS BIGINT) AS ill_formed, CAST(NULL AS BIGINT) AS out_of_bounds FROM a
    UNION ALL SELECT load_id, pl, 'amount', n, 1 - fa / n, coalesce(da, 0), ia, oa FROM a
    UNION ALL SELECT load_id, pl, 'record_date', n, 1 - fd / n, dd, NULL, od FROM a JOIN dd USING (load_id)""",
}
