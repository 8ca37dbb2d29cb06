"""Problem 6: customers added, removed and changed between consecutive snapshots."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.operators.ordinals import assign_ordinals
from tarnwork.operators.snapshots import snapshot_changes
from tarnwork.session import cut
from tarnwork.sources.tables import table

COLS = ["name", "address", "tier"]


def _changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return snapshot_changes(table(spark, sf_dir, "dim_customer_snapshot"), "id", "snapshot_dt", "updated_at", COLS)


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _changes(spark, sf_dir).select("id", "snapshot_dt", "change")


def p6_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the values before and after."""
    values = [F.col(f"{side}.{c}").alias(f"{name}_{c}") for side, name in (("before", "old"), ("after", "new")) for c in COLS]
    return _changes(spark, sf_dir).select("id", "snapshot_dt", "change", *values)


def p6_known(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same on ordinals kept from an earlier run, which knew the first half of the deliveries: known keys keep their place,
    new ones are numbered on."""
    snaps = table(spark, sf_dir, "dim_customer_snapshot")
    middle = snaps.agg(F.percentile("snapshot_dt", 0.5)).first()[0] or 0
    known = cut(assign_ordinals(snaps.where(F.col("snapshot_dt") <= middle), "id"), "known")
    return snapshot_changes(snaps, "id", "snapshot_dt", "updated_at", COLS, known).select("id", "snapshot_dt", "change")


QUERIES = {"p6_found": p6_found, "p6_changes": p6_changes, "p6_known": p6_known}
_DIFF = """
    WITH s AS (
      SELECT id, snapshot_dt, nullif(trim(name), '') AS name, nullif(trim(address), '') AS address, nullif(trim(tier), '') AS tier
      FROM dim_customer_snapshot WHERE id IS NOT NULL
      QUALIFY row_number() OVER (PARTITION BY snapshot_dt, id ORDER BY updated_at DESC NULLS LAST, name DESC NULLS LAST) = 1),
    d AS (SELECT snapshot_dt, lag(snapshot_dt) OVER (ORDER BY snapshot_dt) AS prev FROM (SELECT DISTINCT snapshot_dt FROM dim_customer_snapshot)),
    cur AS (SELECT s.*, d.prev FROM s JOIN d USING (snapshot_dt) WHERE d.prev IS NOT NULL),
    old AS (SELECT s.*, d.snapshot_dt AS nxt FROM s JOIN d ON d.prev = s.snapshot_dt),
    f AS (
      SELECT coalesce(cur.id, old.id) AS id, coalesce(cur.snapshot_dt, old.nxt) AS snapshot_dt,
             CASE WHEN old.id IS NULL THEN 'added' WHEN cur.id IS NULL THEN 'removed' ELSE 'changed' END AS change,
             old.name AS old_name, old.address AS old_address, old.tier AS old_tier, cur.name AS new_name, cur.address AS new_address, cur.tier AS new_tier
      FROM cur FULL JOIN old ON cur.id = old.id AND cur.snapshot_dt = old.nxt
      WHERE old.id IS NULL OR cur.id IS NULL OR (old.name, old.address, old.tier) IS DISTINCT FROM (cur.name, cur.address, cur.tier))
"""
ORACLE = {"p6_known": _DIFF + "SELECT id, snapshot_dt, change FROM f", "p6_found": _DIFF + "SELECT id, snapshot_dt, change FROM f", "p6_changes": _DIFF + "SELECT * FROM f"}
