"""Next states of tables under upserts, change sets and versioning: pure functions of DataFrames."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.operators.shaping import dedup_latest


def _same(keys: list[str], a: str, b: str) -> Column:
    """Keys equal, null equal to null."""
    return reduce(lambda x, y: x & y, (F.col(f"{a}.{k}").eqNullSafe(F.col(f"{b}.{k}")) for k in keys))


def differs(cols: list[str], a: str, b: str) -> Column:
    return reduce(lambda x, y: x | y, (~F.col(f"{a}.{c}").eqNullSafe(F.col(f"{b}.{c}")) for c in cols))


def upsert(target: DataFrame, source: DataFrame, keys: list[str], order: list[Column | str] | None = None) -> DataFrame:
    """The target with the source's rows in place of those of equal keys. With ``order`` the first source row per key in that
    order counts, as it must where the source repeats keys. Columns follow the target; a column new in the source is added."""
    s = dedup_latest(source, keys, order) if order else source
    kept = target.alias("t").join(s.select(*keys).alias("s"), _same(keys, "t", "s"), "left_anti")
    return kept.unionByName(s, allowMissingColumns=True)


def apply_changes(target: DataFrame, changes: DataFrame, keys: list[str], op: str, order: list[Column | str]) -> DataFrame:
    """The target after a change set: of each key the first change in ``order`` (the latest) counts; D deletes, I and U replace
    or insert, D of an unknown key does nothing. ``order`` is mandatory: without a stable one the result would be chance."""
    if not order:
        raise ValueError("changes need an order")
    last = dedup_latest(changes, keys, order)
    kept = target.alias("t").join(last.select(*keys).alias("s"), _same(keys, "t", "s"), "left_anti")
    return kept.unionByName(last.where(F.col(op) != "D").select(*target.columns))


def scd2(history: DataFrame, source: DataFrame, keys: list[str], tracked: list[str], as_of: Column, order: list[Column | str] | None = None, close_missing: bool = False) -> DataFrame:
    """One step of a versioned dimension: current rows that differ from the source in a tracked column (null-safe) are closed on
    ``as_of``, and a new version begins; new keys get a first version. ``close_missing``: keys absent from the source are closed.

    ``history`` has keys, tracked, is_current, effective_start, effective_end. One pass: past versions are carried over, the
    current ones meet the source in one full join.
    """
    s = (dedup_latest(source, keys, order) if order else source).select(*keys, *tracked).withColumn("__s", F.lit(True))
    cur = history.where("is_current").withColumn("__c", F.lit(True))
    j = cur.alias("c").join(s.alias("s"), _same(keys, "c", "s"), "full")
    has_c, has_s = F.col("c.__c").isNotNull(), F.col("s.__s").isNotNull()
    changed = has_c & has_s & differs(tracked, "c", "s")
    closing = changed | (has_c & ~has_s) if close_missing else changed
    old = F.struct(*(F.col(f"c.{x}").alias(x) for x in (*keys, *tracked)), (~closing).alias("is_current"), F.col("c.effective_start").alias("effective_start"), F.when(closing, as_of).otherwise(F.col("c.effective_end")).alias("effective_end"))
    new = F.struct(*(F.col(f"s.{x}").alias(x) for x in (*keys, *tracked)), F.lit(True).alias("is_current"), as_of.alias("effective_start"), F.lit(None).cast("date").alias("effective_end"))
    both = F.array(F.when(has_c, old), F.when(changed | ~has_c, new))
    stepped = j.select(F.explode(F.filter(both, lambda x: x.isNotNull())).alias("v")).select("v.*")
    past = history.where("NOT is_current OR is_current IS NULL").select(*stepped.columns)
    return past.unionByName(stepped)


def keep_other_partitions(existing: DataFrame, new: DataFrame, column: str, affected: list) -> DataFrame:
    """The rows of partitions not in ``affected``, and the new rows."""
    return existing.where(~F.coalesce(F.col(column).isin(affected), F.lit(False))).unionByName(new, allowMissingColumns=True)


def replace_window(existing: DataFrame, new: DataFrame, column: str, low, high) -> DataFrame:
    """The existing rows outside [low, high] and the new rows inside, by the existing columns."""
    inside = F.coalesce(F.col(column).between(low, high), F.lit(False))
    return existing.where(~inside).unionByName(new.where(inside).select(*existing.columns))


def snapshot_changes_as_feed(old: DataFrame, new: DataFrame, keys: list[str], cols: list[str], version: int) -> DataFrame:
    """The change feed that leads from one state to the next: insert, update_preimage, update_postimage, delete."""
    j = old.select(*keys, *cols).withColumn("__p", F.lit(1)).alias("o").join(new.select(*keys, *cols).withColumn("__p", F.lit(1)).alias("n"), _same(keys, "o", "n"), "full")
    had, has = F.col("o.__p").isNotNull(), F.col("n.__p").isNotNull()
    row = lambda side, kind: F.struct(*(F.col(f"{side}.{c}").alias(c) for c in (*keys, *cols)), F.lit(kind).alias("_change_type"))
    moved = had & has & differs(cols, "o", "n")
    rows = F.array(F.when(~had, row("n", "insert")), F.when(~has, row("o", "delete")), F.when(moved, row("o", "update_preimage")), F.when(moved, row("n", "update_postimage")))
    return j.select(F.explode(F.filter(rows, lambda x: x.isNotNull())).alias("r")).select("r.*", F.lit(version).cast("long").alias("_commit_version"))
