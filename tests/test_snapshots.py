from __future__ import annotations

import datetime as dt
import random

from pyspark.sql import functions as F

from tarnwork.operators.ordinals import assign_ordinals
from tarnwork.operators.snapshots import snapshot_changes

SCHEMA = "id long, name string, tier string, updated_at timestamp, snapshot_dt int, mask string, word long"
T = dt.datetime(2026, 1, 1)


def brute(rows):
    snaps = {}
    for i, n, t, u, s, *_ in rows:
        if i is None or s is None:
            continue
        val = tuple((x or "").strip(" ") or None for x in (n, t))
        old = snaps.setdefault(s, {}).get(i)
        if old is None or (u, *(x or "" for x in val)) > (old[0], *(x or "" for x in old[1])):
            snaps[s][i] = (u, val)
    out = set()
    days = sorted(snaps)
    for a, b in zip(days, days[1:]):
        for i in snaps[a].keys() | snaps[b].keys():
            x, y = snaps[a].get(i), snaps[b].get(i)
            if x is None or y is None or x[1] != y[1]:
                out.add((i, b, "added" if x is None else "removed" if y is None else "changed"))
    return out


def test_against_brute_force(spark):
    rnd = random.Random(5)
    rows = [(rnd.choice([None, *range(-3, 200)]) if s != 3 else rnd.randrange(60, 70), rnd.choice(["a", " a ", "b", " ", None]), rnd.choice(["x", None]), T + dt.timedelta(rnd.randrange(3)), s, "m", 1) for s in (1, 2, 3, 7) for _ in range(300)]
    got = {tuple(r) for r in snapshot_changes(spark.createDataFrame(rows, SCHEMA), "id", "snapshot_dt", "updated_at", ["name", "tier"]).select("id", "snapshot_dt", "change").collect()}
    assert got == brute(rows)


def test_empty_and_single_snapshot(spark):
    for rows in ([], [(1, "a", "b", T, 1, "", 0)]):
        assert snapshot_changes(spark.createDataFrame(rows, SCHEMA), "id", "snapshot_dt", "updated_at", ["name"]).count() == 0


def test_ordinals_are_dense_and_persistent(spark):
    ids = spark.createDataFrame([(i % 57,) for i in range(200)] + [(None,)], "id long")
    first = assign_ordinals(ids, "id")
    known = {r.id: r.ordinal for r in first.collect()}
    assert sorted(known.values()) == list(range(57))
    more = {r.id: r.ordinal for r in assign_ordinals(spark.range(80), "id", first).collect()}
    assert {k: v for k, v in more.items() if k < 57} == known and sorted(more.values()) == list(range(80))
    assert assign_ordinals(ids.where(F.lit(False)), "id").count() == 0
