"""What changed between consecutive full snapshots, on bitmaps of key ordinals.

Each snapshot becomes bitmap words of 64 ordinals (words without keys are not stored) with the column values of the keys as
vectors, in the order of their bits: the place of a key in a vector is the number of set bits below its own. AND-NOT of a
word with that of the snapshot before gives additions and removals; common bits are compared place by place.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.functions.clean import text
from tarnwork.operators.ordinals import assign_ordinals


def clean_snapshots(df: DataFrame, key: str, snapshot: str, order: str, cols: list[str]) -> DataFrame:
    """One row per snapshot and key: that with the latest ``order`` (ties: the greatest values), values trimmed, blank as
    null. Rows without key or snapshot are left out."""
    best = F.max(F.struct(F.col(order).alias("__o"), *(text(c).alias(c) for c in cols))).alias("__b")
    return df.where(F.col(key).isNotNull() & F.col(snapshot).isNotNull()).groupBy(snapshot, key).agg(best).select(snapshot, key, *(F.col("__b")[c].alias(c) for c in cols))


def delivery_calendar(df: DataFrame, snapshot: str) -> DataFrame:
    """(snapshot, k, next): the distinct snapshot days, numbered from 1. As many rows as there were deliveries; it is
    broadcast, being bounded by the number of days in the calendar."""
    run = W.orderBy(snapshot)
    days = df.where(F.col(snapshot).isNotNull()).select(snapshot).distinct()
    return days.select(snapshot, F.row_number().over(run).cast("int").alias("k"), F.lead(snapshot).over(run).alias("next"))


def pack(snapshots: DataFrame, ordinals: DataFrame, key: str, snapshot: str, cols: list[str]) -> DataFrame:
    """(snapshot, word, mask, keys, vals) of clean snapshots; at most 64 keys a row."""
    o = snapshots.join(ordinals, key)
    bit = F.col("ordinal").bitwiseAND(F.lit(63)).cast("int")
    cell = F.struct(bit.alias("bit"), F.col(key).alias("key"), F.struct(*cols).alias("val"))
    g = o.groupBy(snapshot, F.shiftright("ordinal", 6).alias("word")).agg(F.bit_or(F.expr("shiftleft(1L, CAST(ordinal & 63 AS INT))")).alias("mask"), F.sort_array(F.collect_list(cell)).alias("__c"))
    return g.select(snapshot, "word", "mask", F.col("__c.key").alias("keys"), F.col("__c.val").alias("vals"))


def snapshot_changes(df: DataFrame, key: str, snapshot: str, order: str, cols: list[str], known: DataFrame | None = None) -> DataFrame:
    """(key, snapshot, change, before, after): added, removed and changed keys of each snapshot against the one before it.

    ``before`` and ``after`` are structs of ``cols``. The first snapshot gives no rows, an empty table none either. ``known``
    are ordinals of an earlier run; they keep their place.
    """
    clean = clean_snapshots(df, key, snapshot, order, cols)
    words = pack(clean, assign_ordinals(df, key, known), key, snapshot, cols).join(F.broadcast(delivery_calendar(df, snapshot)), snapshot)
    run = W.partitionBy("word").orderBy("k")  # a word has at most one row per delivery
    prev = F.when(F.lag("k").over(run) == F.col("k") - 1, F.lag(F.struct("mask", "keys", "vals")).over(run))
    w = words.select(snapshot, "k", "next", "word", "mask", "keys", "vals", prev.alias("p"), F.lead("k").over(run).alias("__nk"))
    w = w.withColumn("pm", F.coalesce("p.mask", F.lit(0).cast("long")))
    bits = "filter(sequence(0, 63), b -> bit_get({0}, b) = 1)"
    place = "CAST(bit_count({0} & ~shiftleft(-1L, b)) AS INT)"
    old, new = place.format("pm"), place.format("mask")
    none = "CAST(NULL AS STRUCT<" + ", ".join(f"`{c}`: STRING" for c in cols) + ">)"
    here = f"""concat(
        transform({bits.format('mask & ~pm')}, b -> struct(keys[{new}] AS key, 'added' AS change, {none} AS before, vals[{new}] AS after)),
        transform({bits.format('pm & ~mask')}, b -> struct(p.keys[{old}] AS key, 'removed' AS change, p.vals[{old}] AS before, {none} AS after)),
        transform(filter({bits.format('mask & pm')}, b -> NOT (p.vals[{old}] <=> vals[{new}])),
                  b -> struct(keys[{new}] AS key, 'changed' AS change, p.vals[{old}] AS before, vals[{new}] AS after)))"""
    # a word whose keys are all gone has no row in the next snapshot: its removals come from its last row
    gone = f"""IF(next IS NOT NULL AND NOT (__nk <=> k + 1),
        transform(sequence(0, size(keys) - 1), i -> struct(keys[i] AS key, 'removed' AS change, vals[i] AS before, {none} AS after)), NULL)"""
    both = w.select(F.col(snapshot).alias("__s"), "next", F.expr(f"IF(k > 1, {here}, NULL)").alias("here"), F.expr(gone).alias("gone"))
    side = F.explode(F.array(F.struct(F.col("__s").alias("at"), F.col("here").alias("rows")), F.struct(F.col("next").alias("at"), F.col("gone").alias("rows")))).alias("x")
    out = both.select(side).select(F.col("x.at").alias(snapshot), F.explode("x.rows").alias("r"))
    return out.select(F.col("r.key").alias(key), snapshot, F.col("r.change").alias("change"), F.col("r.before").alias("before"), F.col("r.after").alias("after"))
