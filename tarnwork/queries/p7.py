"""Problem 7: the full history of customers, carried on through all snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.history import apply_snapshots, clean_versions
from tarnwork.operators.snapshots import clean_snapshots
from tarnwork.session import cut, new_dir
from tarnwork.sources.tables import table
from tarnwork.sources.versioned import VersionedTable

COLS = ["name", "address", "tier"]


def _inputs(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    versions = cut(clean_versions(table(spark, sf_dir, "dim_customer"), "id", COLS), "versions")
    raw = table(spark, sf_dir, "dim_customer_snapshot")
    return versions, cut(clean_snapshots(raw, "id", "snapshot_dt", "updated_at", COLS), "snapshots"), raw.select("snapshot_dt").distinct()


def _full(spark: SparkSession, sf_dir: str) -> DataFrame:
    versions, snaps, days = _inputs(spark, sf_dir)
    return apply_snapshots(versions, versions, snaps, days, "id", COLS, days)


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir).select("id", "effective_start", "effective_end")


def p7_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _full(spark, sf_dir).withColumn("is_current", F.col("effective_end") == 0)


def p7_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every second delivery comes late, after a history was built without it: only touched chains are rebuilt, and the
    result is that of p7_history."""
    versions, snaps, days = _inputs(spark, sf_dir)
    late = days.where("snapshot_dt % 2 = 0")
    early = snaps.where("snapshot_dt % 2 <> 0")
    before = cut(apply_snapshots(versions, versions, early, days.where("snapshot_dt % 2 <> 0"), "id", COLS), "history")
    return apply_snapshots(before, versions, snaps, late, "id", COLS, days).withColumn("is_current", F.col("effective_end") == 0)


def p7_committed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The history as a versioned table: deliveries come in two lots, each of which replaces the touched chains in one commit,
    and the second lot holds days before some of the first."""
    versions, snaps, days = _inputs(spark, sf_dir)
    store = VersionedTable(spark, new_dir(spark, "customer_history"))
    store.commit(versions)
    lots = ["snapshot_dt % 3 <> 0", "snapshot_dt % 3 = 0"]
    for i, lot in enumerate(lots):
        known = days.where(" OR ".join(lots[: i + 1]))
        store.commit(apply_snapshots(store.read(), versions, snaps.join(F.broadcast(known), "snapshot_dt", "left_semi"), days.where(lot), "id", COLS, known))
    return store.read().withColumn("is_current", F.col("effective_end") == 0)


QUERIES = {"p7_found": p7_found, "p7_history": p7_history, "p7_late": p7_late, "p7_committed": p7_committed}
_HISTORY = """
    WITH v0 AS (
      SELECT DISTINCT id, nullif(trim(name), '') AS name, nullif(trim(address), '') AS address, nullif(trim(tier), '') AS tier,
             CAST(strftime(effective_start, '%Y%m%d') AS INTEGER) AS s, CAST(strftime(effective_end, '%Y%m%d') AS INTEGER) AS e
      FROM dim_customer WHERE id IS NOT NULL AND effective_start IS NOT NULL),
    v AS (
      SELECT id, name, address, tier, s, coalesce(least(e, lead(s) OVER (PARTITION BY id ORDER BY s, e NULLS LAST, name, address, tier)), 0) AS e FROM v0),
    d AS (
      SELECT snapshot_dt, CAST(row_number() OVER (ORDER BY snapshot_dt) AS INTEGER) AS k, lead(snapshot_dt) OVER (ORDER BY snapshot_dt) AS nxt
      FROM (SELECT DISTINCT snapshot_dt FROM dim_customer_snapshot)),
    sn AS (
      SELECT id, nullif(trim(name), '') AS name, nullif(trim(address), '') AS address, nullif(trim(tier), '') AS tier, snapshot_dt
      FROM dim_customer_snapshot WHERE id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY snapshot_dt, id ORDER BY updated_at DESC NULLS LAST, name DESC NULLS LAST) = 1),
    st AS (
      SELECT id, name, address, tier, k, snapshot_dt AS s, nxt FROM sn JOIN d USING (snapshot_dt)
      UNION ALL SELECT id, name, address, tier, 0, s, (SELECT min(snapshot_dt) FROM d) FROM v WHERE e = 0),
    m AS (
      SELECT *, CASE WHEN lag(k) OVER w = k - 1 AND (lag(name) OVER w, lag(address) OVER w, lag(tier) OVER w) IS NOT DISTINCT FROM (name, address, tier) THEN 0 ELSE 1 END AS n
      FROM st WINDOW w AS (PARTITION BY id ORDER BY k)),
    r AS (SELECT *, sum(n) OVER (PARTITION BY id ORDER BY k) AS run FROM m),
    h AS (
      SELECT id, any_value(name) AS name, any_value(address) AS address, any_value(tier) AS tier, arg_min(s, k) AS effective_start,
             CASE WHEN max(k) = (SELECT max(k) FROM d) THEN 0 ELSE arg_max(nxt, k) END AS effective_end
      FROM r GROUP BY id, run
      UNION ALL SELECT id, name, address, tier, s, e FROM v WHERE e <> 0)
"""
_ALL = _HISTORY + "SELECT id, name, address, tier, effective_start, effective_end, effective_end = 0 AS is_current FROM h"
ORACLE = {"p7_found": _HISTORY + "SELECT id, effective_start, effective_end FROM h", "p7_history": _ALL, "p7_late": _ALL, "p7_committed": _ALL}
