from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators.replay import _folder, current, replay, steps

SCHEMA = "id long, v long, ts long, a string, b string, op string, extra string"
K, S, C = ["id"], ["v", "ts"], ["a", "b"]


def brute(rows, partial):
    state = {}
    for r in sorted({r for r in rows if r[0] is not None and r[5] in ("insert", "update", "delete")}, key=lambda r: (r[0], r[1], r[2], r[5] == "delete", r[3] or "", r[4] or "")):
        old = state.get(r[0])
        if r[5] == "delete":
            state[r[0]] = None
        elif r[5] == "update" and partial:
            a, b = (old or (None, None))[:2]
            state[r[0]] = (r[3] if r[3] is not None else a, r[4] if r[4] is not None else b, r[1], r[2])
        else:
            state[r[0]] = (r[3], r[4], r[1], r[2])
    return {k: s for k, s in state.items() if s}


def run(df, partial, state=None):
    return replay(steps(df, K, S, C, F.col("op"), F.lit(partial)), K, S, C, state)


def as_dict(state):
    return {r.id: (r.a, r.b, r.v, r.ts) for r in current(state, K, S, C).collect()}


@pytest.mark.parametrize("partial", [False, True])
def test_against_brute_force_with_hot_key_and_repeats(spark, partial):
    rnd = random.Random(3)
    rows = []
    for n in range(1500):
        key = 7 if n % 3 else rnd.choice([None, 1, 2, 3, 4, 5, 6])
        rows.append((key, n // 5, n, rnd.choice(["x", "y", None]), rnd.choice(["p", "q", None]), rnd.choice(["insert", "update", "update", "delete", "preimage", None]), "z"))
    rows += rows[::4]
    rnd.shuffle(rows)
    df = spark.createDataFrame(rows, SCHEMA)
    assert as_dict(run(df, partial)) == brute(rows, partial)


def test_applied_sequences_are_skipped_and_tombstones_hold(spark):
    first = spark.createDataFrame([(1, 5, 0, "x", "y", "insert", ""), (2, 6, 0, "x", "y", "delete", "")], SCHEMA)
    state = run(first, True)
    late = spark.createDataFrame([(1, 4, 0, "old", None, "update", ""), (1, 7, 0, None, "new", "update", ""), (2, 3, 0, "o", "o", "insert", ""), (1, 5, 0, "x", "y", "insert", "")], SCHEMA)
    assert as_dict(run(late, True, state)) == {1: ("x", "new", 7, 0)}


def test_a_state_without_insert_skips_late_steps_too(spark):
    feed = [(1, v, v, f"a{v}" if v % 2 else None, f"b{v}" if v % 3 else None, "update", "") for v in range(1, 9)] + [(2, v, v, f"a{v}", None, "insert" if v == 2 else "update", "") for v in range(1, 9)]
    make = lambda rows: spark.createDataFrame(rows, SCHEMA)
    whole = as_dict(run(make(feed), True))
    # what the state has seen comes again, along with a late change that it has not seen and what is new
    state = run(make([r for r in feed if r[1] <= 5 and r[1] != 3]), True)
    late = as_dict(run(make(feed), True, state))
    assert late[2] == whole[2] and late[1] == ("a7", "b8", 8, 8)
    only = run(make([(1, 5, 0, "x", None, "update", "")]), True)
    assert as_dict(run(make([(1, 3, 0, None, "late", "update", "")]), True, only)) == {1: ("x", None, 5, 0)}


def test_empty_feed_and_null_sequence(spark):
    assert run(spark.createDataFrame([], SCHEMA), False).count() == 0
    df = spark.createDataFrame([(1, None, None, "first", None, "insert", ""), (1, 1, None, "second", None, "update", "")], SCHEMA)
    assert as_dict(run(df, False)) == {1: ("second", None, 1, None)}


def test_batches_that_cut_a_key(spark):
    import pyarrow as pa

    cols = {"id": [1, 1, 1, 2], "v": [1, 2, 3, 1], "__present": [True] * 4, "__reset": [True, False, False, True], "__state": [False] * 4, "a": ["x", None, "z", "w"], "__set_a": [True, False, True, True]}
    t = pa.table(cols)
    out = list(_folder(["id"], ["v"], ["a"])(b for b in t.to_batches(max_chunksize=1)))
    assert [(r["id"], r["v"], r["a"], r["__reset"]) for b in out for r in b.to_pylist()] == [(1, 3, "z", True), (2, 1, "w", True)]
