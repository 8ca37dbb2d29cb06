"""Dense, persistent ordinals for keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from tarnwork.session import cut


def assign_ordinals(keys: DataFrame, key: str, known: DataFrame | None = None) -> DataFrame:
    """(key, ordinal): the pairs of ``known`` unchanged, new distinct keys numbered on densely from its end. Null keys get none.

    New keys are range-partitioned and numbered within their task; only the number of keys per task is summed up in one
    place. The numbering is written to the shared folder, so a lost executor cannot number a key twice.
    """
    new = keys.where(F.col(key).isNotNull()).select(key).distinct()
    if known is not None:
        new = new.join(known, key, "left_anti")
    here = F.monotonically_increasing_id()
    local = cut(new.repartitionByRange(key).select(key, F.shiftright(here, 33).alias("__p"), here.bitwiseAND(F.lit((1 << 33) - 1)).alias("__i")), "ordinals")
    sizes = local.groupBy("__p").agg(F.count(F.lit(1)).alias("__n"))  # one row per task of the numbering
    before = sizes.select("__p", (F.sum("__n").over(W.orderBy("__p")) - F.col("__n")).alias("__off"))
    start = F.lit(0).cast("long")
    if known is not None:
        before = before.crossJoin(F.broadcast(known.agg((F.coalesce(F.max("ordinal"), F.lit(-1)) + 1).alias("__start"))))
        start = F.col("__start")
    fresh = local.join(F.broadcast(before), "__p").select(key, (start + F.col("__off") + F.col("__i")).alias("ordinal"))
    return fresh if known is None else known.select(key, "ordinal").unionByName(fresh)
