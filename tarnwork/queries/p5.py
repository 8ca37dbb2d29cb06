"""Problem 5: the customers after a feed of repeated and unordered changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnwork.functions.clean import text
from tarnwork.operators.replay import current, replay, steps
from tarnwork.session import cut
from tarnwork.sources.tables import table

KEYS, SEQ, COLS = ["customer_id"], ["_commit_version", "_commit_timestamp"], ["name", "address", "tier"]


def op_of(op: str = "Op", change_type: str = "_change_type") -> Column:
    """insert, update or delete from either code; without a code an insert; pre-images and unknown codes are null."""
    c = F.lower(F.coalesce(text(op), text(change_type)))
    return (
        F.when(c.isNull() | c.isin("i", "insert"), "insert")
        .when(c.isin("u", "update", "update_postimage"), "update")
        .when(c.isin("d", "delete"), "delete")
    )


def _current(spark: SparkSession, sf_dir: str, cols: list[str]) -> DataFrame:
    return current(replay(steps(table(spark, sf_dir, "changes"), KEYS, SEQ, cols, op_of()), KEYS, SEQ, cols), KEYS, SEQ, cols)


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _current(spark, sf_dir, COLS).select("customer_id", "_commit_version")


def p5_current(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed's updates carry whole rows, so a null sets null."""
    return _current(spark, sf_dir, COLS)


def p5_resumed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed in two lots with a kept state between them. The second lot brings the first again, as redelivery does: what a
    key's state has seen is skipped."""
    feed = table(spark, sf_dir, "changes")
    top = feed.agg(F.max("_commit_version")).first()[0] or 0
    first = replay(steps(feed.where(F.col("_commit_version") <= top // 2), KEYS, SEQ, COLS, op_of()), KEYS, SEQ, COLS)
    state = cut(first, "state")
    return current(replay(steps(feed, KEYS, SEQ, COLS, op_of()), KEYS, SEQ, COLS, state), KEYS, SEQ, COLS)


def p5_partial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feed read as one whose updates hold only the columns that change: a null leaves the value as it was."""
    step = steps(table(spark, sf_dir, "changes"), KEYS, SEQ, COLS, op_of(), F.lit(True))
    return current(replay(step, KEYS, SEQ, COLS), KEYS, SEQ, COLS)


QUERIES = {"p5_found": p5_found, "p5_current": p5_current, "p5_resumed": p5_resumed, "p5_partial": p5_partial}
_LAST = """
    WITH c AS (
      SELECT *, lower(coalesce(nullif(trim(Op), ''), nullif(trim(_change_type), ''), 'i')) AS code FROM changes WHERE customer_id IS NOT NULL),
    l AS (
      SELECT * FROM c WHERE code IN ('i', 'insert', 'u', 'update', 'update_postimage', 'd', 'delete')
      QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY _commit_version DESC, _commit_timestamp DESC, code IN ('d', 'delete') DESC, name DESC NULLS LAST, address DESC NULLS LAST, tier DESC NULLS LAST) = 1)
"""
ORACLE = {
    "p5_found": _LAST + "SELECT customer_id, _commit_version FROM l WHERE code NOT IN ('d', 'delete')",
    "p5_current": _LAST + "SELECT customer_id, name, address, tier, _commit_version, _commit_timestamp FROM l WHERE code NOT IN ('d', 'delete')",
    "p5_resumed": _LAST + "SELECT customer_id, name, address, tier, _commit_version, _commit_timestamp FROM l WHERE code NOT IN ('d', 'delete')",
    # of each key the steps from its last insert or delete on; of steps with one sequence the last
    "p5_partial": _LAST.rstrip() + """,
    s AS (
      SELECT *, CASE WHEN code IN ('d', 'delete') THEN 'd' WHEN code IN ('u', 'update', 'update_postimage') THEN 'u' ELSE 'i' END AS did FROM c
      WHERE code IN ('i', 'insert', 'u', 'update', 'update_postimage', 'd', 'delete')
      QUALIFY row_number() OVER (PARTITION BY customer_id, _commit_version, _commit_timestamp ORDER BY code IN ('d', 'delete') DESC, name DESC NULLS LAST, address DESC NULLS LAST, tier DESC NULLS LAST) = 1),
    n AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY _commit_version, _commit_timestamp) AS k FROM s),
    z AS (SELECT *, coalesce(max(k) FILTER (did <> 'u') OVER (PARTITION BY customer_id), 0) AS r FROM n),
    y AS (SELECT customer_id, arg_max(did, k) AS did, arg_max(_commit_version, k) AS _commit_version, arg_max(_commit_timestamp, k) AS _commit_timestamp,
            arg_max(name, k) FILTER (did <> 'd' AND name IS NOT NULL) AS nv,
            arg_max(address, k) FILTER (did <> 'd' AND address IS NOT NULL) AS av, arg_max(tier, k) FILTER (did <> 'd' AND tier IS NOT NULL) AS tv
          FROM z WHERE k >= r GROUP BY 1)
    SELECT customer_id, nv AS name, av AS address, tv AS tier, _commit_version, _commit_timestamp FROM y WHERE did <> 'd'""",
}
