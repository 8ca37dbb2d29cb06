"""Ordered replay of a change feed to the current state of a table.

Every change becomes a step: what it does to its key's row. Steps compose, so a stretch of a key's changes folds to one
step. The feed is range-partitioned by (key, sequence): a key with very many changes spreads over several tasks, each
sorted by sequence and folded by a state machine; the few keys cut at a task border have their steps folded once more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _differs(col: pa.ChunkedArray | pa.Array) -> np.ndarray:
    """For each row but the first: is its value another than that of the row before; null equals null."""
    a, b = col.slice(1), col.slice(0, len(col) - 1)
    return np.asarray(pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b))))


def _fold_table(t: pa.Table, keys: list[str], seq: list[str], cols: list[str]) -> pa.Table:
    """One step per key of a table sorted by key and sequence."""
    n = t.num_rows
    at = np.arange(n)
    change = np.ones(n, bool)
    moved = np.zeros(n - 1, bool)
    for k in keys:
        moved |= _differs(t[k])
    change[1:] = moved
    later = moved.copy()
    for s in seq:
        later |= _differs(t[s])
    active = np.ones(n, bool)
    active[:-1] = later  # of steps with the same sequence only the last is applied, the rest are repeats
    starts = np.flatnonzero(change)
    ends = np.append(starts[1:], n) - 1

    def last(flag: np.ndarray) -> np.ndarray:
        return np.maximum.accumulate(np.where(flag & active, at, -1))[ends]

    state = last(np.asarray(t["__state"]))
    reset = last(np.asarray(t["__reset"]))
    reset = np.where(reset >= state, reset, -1)
    out = {name: t[name].take(pa.array(ends)) for name in [*keys, *seq, "__present"]}
    out["__reset"] = pa.array(reset >= starts)
    out["__state"] = pa.array(state >= starts)
    floor = np.maximum(np.maximum(starts, reset), state)  # what stands before a state is in it already
    for c in cols:
        pos = last(np.asarray(t[f"__set_{c}"]))
        ok = pos >= floor
        out[c] = t[c].take(pa.array(np.where(ok, pos, 0), mask=~ok))
        out[f"__set_{c}"] = pa.array(ok)
    return pa.table(out).select(t.column_names)


def _folder(keys: list[str], seq: list[str], cols: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carry = None
        for b in batches:
            if not b.num_rows:
                continue
            t = pa.Table.from_batches([b])
            t = t.cast(pa.schema([pa.field(f.name, f.type) for f in t.schema]))  # flags come as not nullable, the carried row's are
            if carry is not None:
                t = pa.concat_tables([carry, t])
            s = _fold_table(t.combine_chunks(), keys, seq, cols)
            yield from s.slice(0, s.num_rows - 1).to_batches()
            carry = s.slice(s.num_rows - 1)
        if carry is not None:
            yield from carry.to_batches()

    return run


def steps(changes: DataFrame, keys: list[str], seq: list[str], cols: list[str], op: Column, partial: Column | None = None) -> DataFrame:
    """Changes as steps. ``op`` is insert, update or delete; rows with another or a null op, or a null key, are left out.
    Where ``partial`` is true, a null column of an update leaves the value as it was; else it sets null."""
    d = changes.select(*keys, *seq, *cols, op.alias("__op"), (partial if partial is not None else F.lit(False)).alias("__part"))
    d = d.where(F.col("__op").isin("insert", "update", "delete")).dropna(subset=keys)
    part = (F.col("__op") == "update") & F.coalesce(F.col("__part"), F.lit(False))
    gone = F.col("__op") == "delete"
    return d.select(
        *keys,
        *seq,
        (~gone).alias("__present"),
        (~part).alias("__reset"),
        *(F.when(~gone, F.col(c)).alias(c) for c in cols),
        *((~part | F.col(c).isNotNull()).alias(f"__set_{c}") for c in cols),
    )


def replay(step: DataFrame, keys: list[str], seq: list[str], cols: list[str], state: DataFrame | None = None) -> DataFrame:
    """The state after all steps: one step per key, deleted keys included as tombstones (``__present`` false).

    ``state``, the result of an earlier replay: a key's steps up to the sequence of its state count as applied and are
    skipped, whether or not an insert was among them.
    Of rows with equal key and sequence one is applied: present before deleted, then by values, the last in that order.
    A null sequence sorts first. An empty feed gives the state as it was.
    """
    step = step.select(*keys, *seq, "__present", "__reset", *cols, *(f"__set_{c}" for c in cols))
    step = step.withColumn("__state", F.lit(False))
    if state is not None:
        step = step.unionByName(state.select(*keys, *seq, "__present", "__reset", *cols, *(f"__set_{c}" for c in cols), F.lit(True).alias("__state")))
    order = [*keys, *seq, "__state", F.col("__present").desc(), *cols]
    fold = _folder(keys, seq, cols)
    once = step.repartitionByRange(*keys, *seq).sortWithinPartitions(*order).mapInArrow(fold, step.schema)
    return once.repartition(*keys).sortWithinPartitions(*keys, *seq).mapInArrow(fold, step.schema).drop("__state")


def current(state: DataFrame, keys: list[str], seq: list[str], cols: list[str]) -> DataFrame:
    return state.where("__present").select(*keys, *cols, *seq)
