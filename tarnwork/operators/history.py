"""Version history of entities, rebuilt chain by chain.

Raw input is kept: the versions known at the start and every full snapshot. A batch (new, late or corrected snapshots) touches
the entities whose state in it differs from the version valid on its day. Only their raw rows are read again, all their
intervals are rebuilt, and their chains are replaced as a whole; the chains of all others stay as they are.
"""

from __future__ import annotations

import datetime as dt
from bisect import bisect_left

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.functions.clean import day_int, text
from tarnwork.session import cut

HISTORY = ["effective_start", "effective_end"]


def clean_versions(dim: DataFrame, key: str, cols: list[str]) -> DataFrame:
    """Start versions as (key, cols, effective_start INT, effective_end INT, 0 if open), values trimmed, blank as null.

    Repeated rows count once whatever their ``is_current``; a version ends at the next one's start at the latest, so of an
    entity only the last can be open. Rows without key or start are left out.
    """
    d = dim.where(F.col(key).isNotNull() & F.col("effective_start").isNotNull())
    d = d.select(key, *(text(c).alias(c) for c in cols), day_int("effective_start").alias("__s"), day_int("effective_end").alias("__e")).distinct()
    run = W.partitionBy(key).orderBy("__s", F.col("__e").asc_nulls_last(), *cols)
    end = F.least("__e", F.lead("__s").over(run))
    return d.select(key, *cols, F.col("__s").alias("effective_start"), F.coalesce(end, F.lit(0)).alias("effective_end"))


def _bounds(df: DataFrame, key: str, cols: list[str], k: str) -> DataFrame:
    """``df`` with __first and __last: does the row begin, or end, a stretch of consecutive places with equal values? At most
    one row per entity and place."""
    run = W.partitionBy(key).orderBy(k)
    val = F.struct(*cols)
    joins = lambda near, step: F.coalesce((near(k).over(run) == F.col(k) + step) & near(val).over(run).eqNullSafe(val), F.lit(False))
    return df.withColumns({"__first": ~joins(F.lag, -1), "__last": ~joins(F.lead, 1)})


def build_chains(versions: DataFrame, snapshots: DataFrame, days: list[int], key: str, cols: list[str]) -> DataFrame:
    """All versions of the entities given: closed start versions as they are, the open one carried on through the snapshots.

    ``snapshots`` are clean (one row per key and snapshot_dt), ``days`` are all their deliveries, in order. Equal values in
    consecutive deliveries are one version; it ends with the first delivery that differs or lacks the entity.
    """
    cal = _calendar(versions.sparkSession, days)
    states = snapshots.select("snapshot_dt", key, *cols).join(F.broadcast(cal), "snapshot_dt").select(key, *cols, "__k", F.col("snapshot_dt").alias("__start"), "__next")
    opened = versions.where("effective_end = 0").select(key, *cols, F.lit(0).alias("__k"), F.col("effective_start").alias("__start"), F.lit(days[0] if days else None).cast("int").alias("__next"))
    ends = _bounds(states.unionByName(opened), key, cols, "__k").where("__first OR __last")
    closing = F.when(F.col("__last"), F.col("__next")).otherwise(F.lead("__next").over(W.partitionBy(key).orderBy("__k")))
    built = ends.withColumn("__end", closing).where("__first").select(key, *cols, F.col("__start").alias("effective_start"), F.coalesce("__end", F.lit(0)).alias("effective_end"))
    return versions.where("effective_end <> 0").select(key, *cols, *HISTORY).unionByName(built)


def _calendar(spark: SparkSession, days: list[int]) -> DataFrame:
    """(snapshot_dt, __k, __next): deliveries numbered from 1, with the one behind each."""
    return spark.createDataFrame([(d, i + 1, n) for i, (d, n) in enumerate(zip(days, [*days[1:], None]))], "snapshot_dt int, __k int, __next int")


def _before(spark: SparkSession, days: list[int]) -> DataFrame:
    """(__day, __n): the number of ``days`` before each calendar day between the first and the last of them."""
    if not days:
        return spark.createDataFrame([], "__day int, __n int")
    first, last = (dt.date(min(max(d // 10000, 1), 9998), 1, 1) for d in (days[0], days[-1]))
    every = {d.year * 10000 + d.month * 100 + d.day for d in (first + dt.timedelta(n) for n in range((last - first).days + 366))} | set(days)
    return spark.createDataFrame([(d, bisect_left(days, d)) for d in sorted(every)], "__day int, __n int")


def touched_keys(history: DataFrame, batch: DataFrame, days: list[int], key: str, cols: list[str]) -> DataFrame:
    """The entities whose state in any delivery of ``batch`` is not what ``history`` says for its day. ``days`` are the
    deliveries of the batch, in order.

    Nothing is compared delivery by delivery. A version covers a stretch of the deliveries, whose first and last place follow
    from its days; the batch has stretches of equal values in consecutive deliveries. An entity is untouched if both have the
    same first and last places with the same values. Adjacent versions with equal values differ from one stretch, so such an
    entity is rebuilt without need; nothing else is.
    """
    spark, m = history.sparkSession, len(days)
    if not m:
        return batch.select(key).limit(0)
    table = _before(spark, days)
    place = lambda c, n: F.when(F.col(c) <= days[0], 0).when(F.col(c) > days[-1], m).otherwise(F.col(n))
    h = history.select(key, *cols, *HISTORY)
    for c, n in zip(HISTORY, ("__a", "__b")):
        h = h.join(F.broadcast(table.select(F.col("__day").alias(f"{n}d"), F.col("__n").alias(n))), F.col(c) == F.col(f"{n}d"), "left")
    lo, hi = place("effective_start", "__a") + 1, F.when(F.col("effective_end") == 0, m).otherwise(place("effective_end", "__b"))
    h = h.select(key, *cols, lo.alias("__lo"), hi.alias("__hi")).where("__lo <= __hi OR __lo IS NULL OR __hi IS NULL")
    side = lambda s, k, on=None: F.struct(F.lit(s).alias("__side"), k.alias("__k")) if on is None else F.when(on, F.struct(F.lit(s).alias("__side"), k.alias("__k")))
    expected = h.select(key, *cols, F.lit(1).alias("__d"), F.inline(F.array(side(0, F.col("__lo")), side(1, F.col("__hi")))))
    seen = batch.select("snapshot_dt", key, *cols).join(F.broadcast(_calendar(spark, days)), "snapshot_dt").select(key, *cols, "__k")
    seen = _bounds(seen, key, cols, "__k").where("__first OR __last")
    seen = seen.select(key, *cols, F.lit(-1).alias("__d"), F.inline(F.filter(F.array(side(0, F.col("__k"), F.col("__first")), side(1, F.col("__k"), F.col("__last"))), lambda x: x.isNotNull())))
    per = expected.unionByName(seen).groupBy(key, "__side", "__k", *cols).agg(F.sum("__d").alias("__d"))
    return per.where("__d <> 0").select(key).distinct()


def apply_snapshots(history: DataFrame, versions: DataFrame, snapshots: DataFrame, batch_days: DataFrame, key: str, cols: list[str], all_days: DataFrame | None = None) -> DataFrame:
    """The history after the deliveries of ``batch_days``: touched chains rebuilt from ``versions`` and all ``snapshots``.

    ``history`` may be that of any earlier set of deliveries; the result equals that of building everything anew. Write it
    with ``VersionedTable.commit`` to replace the chains atomically. ``all_days``: (snapshot_dt) of all deliveries so far,
    those without any row included; by default those of ``snapshots`` and ``batch_days``. Days are brought to the driver:
    there are no more of them than days in the calendar.
    """
    of = lambda d: sorted(r[0] for r in d.where("snapshot_dt IS NOT NULL").select("snapshot_dt").distinct().collect())
    days = of(batch_days)
    every = of(all_days if all_days is not None else snapshots.select("snapshot_dt").union(batch_days.select("snapshot_dt")))
    batch = snapshots.where(F.col("snapshot_dt").isin(days)) if len(days) < len(every) else snapshots
    touched = touched_keys(history, batch, days, key, cols)
    if every:
        # a start version that reaches past the first delivery is not what the deliveries would have made
        touched = touched.union(versions.where(F.greatest("effective_start", "effective_end") > every[0]).select(key)).distinct()
    touched = cut(touched, "touched")
    chains = build_chains(versions.join(touched, key, "left_semi"), snapshots.join(touched, key, "left_semi"), every, key, cols)
    return history.join(touched, key, "left_anti").select(key, *cols, *HISTORY).unionByName(chains)
