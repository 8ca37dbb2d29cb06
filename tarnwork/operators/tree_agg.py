"""Per-key aggregation as a tree of merges, for keys of which a few hold most rows.

The chunks are the splits of the input, of one size (``spark.sql.files.maxPartitionBytes``). A round groups by (node, key,
sub-key): the map side combines a chunk locally, the reduce side merges the states of at most ``fan_in`` nodes of the round before. The
number of nodes falls by ``fan_in`` a round until one is left, so no reducer ever gets all partial states of a hot key.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tarnwork.session import plan_bytes

#: State -> how two states are merged.
_MERGE = {"sum": F.sum, "count": F.sum, "min": F.min, "max": F.max}


def rounds_for(df: DataFrame, fan_in: int, chunk_bytes: int) -> int:
    """Rounds so that every merge has at most about ``fan_in`` inputs. A chunk is what one task reads, so their number is that
    of the splits: Catalyst's size by ``chunk_bytes``, at least the cores; no job is run for it."""
    chunks = max(df.sparkSession.sparkContext.defaultParallelism, math.ceil(plan_bytes(df) / chunk_bytes))
    return max(1, math.ceil(math.log(chunks, fan_in)))


def tree_aggregate(
    df: DataFrame,
    keys: dict[str, Column],
    states: dict[str, tuple[str, Column]],
    sub_key: tuple[str, Column] | None = None,
    fan_in: int = 8,
    chunk_bytes: int = 128 << 20,
    rounds: int | None = None,
) -> DataFrame:
    """One row per key: ``keys`` by name, ``states`` as name -> (sum|count|min|max, expression), and, with ``sub_key``
    (name, expression), the exact number of its distinct non-null values in the column of that name.

    A null key is a group of its own. An empty input gives no rows. ``sub_key`` is part of the grouping until the last
    fold, so states stay of fixed size; the last fold of a key has one row per sub-key value and node, combined on the
    map side. Columns of ``df`` other than those used are not read, so clashing names do no harm.
    """
    n = rounds or rounds_for(df, fan_in, chunk_bytes)
    # node: the low digits of the chunk number to the base fan_in, one fewer in each round
    chunk = F.shiftright(F.monotonically_increasing_id(), 33)  # the number of the task that reads the row
    parts = [c.alias(f"__k{i}") for i, c in enumerate(keys.values())]
    sub = [sub_key[1].alias("__s")] if sub_key else []
    cur = df.select(*parts, *sub, *(e.alias(f"__v{i}") for i, (_, e) in enumerate(states.values())), chunk.cast("long").alias("__c"))
    group = [f"__k{i}" for i in range(len(keys))] + (["__s"] if sub_key else [])
    first = True
    for left in range(n - 1, -1, -1):
        node = F.pmod(F.col("__c"), F.lit(fan_in**left)).alias("__c")
        cur = cur.select(*group, *(f"__v{i}" for i in range(len(states))), node).groupBy("__c", *group).agg(
            *((F.count if first and how == "count" else _MERGE[how])(f"__v{i}").alias(f"__v{i}") for i, (how, _) in enumerate(states.values()))
        )
        first = False
    out = [F.col(f"__k{i}").alias(k) for i, k in enumerate(keys)]
    done = [_MERGE[how](f"__v{i}").alias(s) for i, (s, (how, _)) in enumerate(states.items())]
    if sub_key:
        done.append(F.count("__s").alias(sub_key[0]))
    return cur.groupBy(*group[: len(keys)]).agg(*done).select(*out, *states, *([sub_key[0]] if sub_key else []))


def heavy_keys(per_key: DataFrame, key: str, rows: str, total: DataFrame, share: float) -> DataFrame:
    """The non-blank keys with at least ``share`` of the rows; ``total`` is one row with the column ``total``."""
    return per_key.join(F.broadcast(total)).where(F.col(key).isNotNull() & (F.col(key) != "") & (F.col(rows) >= F.lit(share) * F.col("total"))).select(key)
