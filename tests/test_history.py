from __future__ import annotations

import datetime as dt
import random

import pytest

from tarnwork.operators.history import apply_snapshots, clean_versions
from tarnwork.operators.snapshots import clean_snapshots
from tarnwork.sources.versioned import ConcurrentCommit, VersionedTable

D = dt.date
DIM = "id long, name string, is_current boolean, effective_start date, effective_end date, k int"
SNAP = "id long, name string, updated_at timestamp, snapshot_dt int, start string"
DAYS = [20260105, 20260112, 20260130, 20260201]


def brute(dim, snaps):
    """The definition, delivery by delivery."""
    num = lambda d: d.year * 10000 + d.month * 100 + d.day
    clean = lambda x: (x or "").strip(" ") or None
    chains = {}
    for i, n, _, s, e, *_ in dim:
        if i is not None and s is not None:
            chains.setdefault(i, set()).add((num(s), num(e) if e else 99999999, clean(n) or ""))
    hist = {}
    for i, vs in chains.items():
        vs = sorted(vs)
        hist[i] = [[s, min([e, *([vs[k + 1][0]] if k + 1 < len(vs) else [])]), n or None] for k, (s, e, n) in enumerate(vs)]
    for day in sorted({r[3] for r in snaps}):
        now = {}
        for i, n, u, s, *_ in snaps:
            if s == day and i is not None and (i not in now or (u, clean(n) or "") > (now[i][0], now[i][1] or "")):
                now[i] = (u, clean(n))
        for i in hist.keys() | now.keys():
            vs = hist.setdefault(i, [])
            opened = next((v for v in vs if v[1] == 99999999), None)
            if opened and (i not in now or now[i][1] != opened[2]):
                opened[1] = day
                opened = None
            if i in now and not opened:
                vs.append([day, 99999999, now[i][1]])
    return {(i, n, s, 0 if e == 99999999 else e) for i, vs in hist.items() for s, e, n in vs}


def data(seed):
    r = random.Random(seed)
    dim = []
    for i in range(40):
        starts = sorted(r.sample(range(300), r.randrange(0, 4)))
        for k, s in enumerate(starts):
            end = starts[k + 1] if k + 1 < len(starts) and r.random() < 0.7 else None
            row = (i, r.choice(["a", "b ", " ", None]), r.choice([True, False, None]), D(2025, 1, 1) + dt.timedelta(s), end and D(2025, 1, 1) + dt.timedelta(end), 1)
            dim += [row] * r.choice([1, 1, 2])
    dim.append((None, "x", True, D(2025, 1, 1), None, 1))
    snaps = [(i, r.choice(["a", "a", "b", None]), dt.datetime(2026, 1, r.randrange(1, 4)), d, "x") for d in DAYS for i in [*range(50), None] for _ in range(r.choice([0, 1, 1, 1, 2]))]
    return dim, snaps


def keyed(df):
    return {(r.id, r.name, r.effective_start, r.effective_end) for r in df.collect()}


@pytest.mark.parametrize("seed", [1, 2])
def test_full_and_late_deliveries(spark, tmp_path, seed):
    dim, snaps = data(seed)
    versions = clean_versions(spark.createDataFrame(dim, DIM), "id", ["name"])
    raw = spark.createDataFrame(snaps, SNAP)
    clean = clean_snapshots(raw, "id", "snapshot_dt", "updated_at", ["name"])
    days = raw.select("snapshot_dt").distinct()
    assert keyed(apply_snapshots(versions, versions, clean, days, "id", ["name"])) == brute(dim, snaps)
    late = DAYS[seed]
    store = VersionedTable(spark, str(tmp_path / "history"))
    store.commit(apply_snapshots(versions, versions, clean.where(f"snapshot_dt <> {late}"), days.where(f"snapshot_dt <> {late}"), "id", ["name"]))
    assert keyed(store.read()) == brute(dim, [s for s in snaps if s[3] != late])
    store.commit(apply_snapshots(store.read(), versions, clean, days.where(f"snapshot_dt = {late}"), "id", ["name"]))
    assert keyed(store.read()) == brute(dim, snaps)
    assert store.version() == 2 and keyed(store.read(1)) == brute(dim, [s for s in snaps if s[3] != late])
    store.expire(1)
    assert store.read().count() > 0


def test_empty_inputs(spark):
    versions = clean_versions(spark.createDataFrame([], DIM), "id", ["name"])
    raw = spark.createDataFrame([], SNAP)
    out = apply_snapshots(versions, versions, clean_snapshots(raw, "id", "snapshot_dt", "updated_at", ["name"]), raw.select("snapshot_dt"), "id", ["name"])
    assert out.count() == 0


def test_two_commits_from_one_version(spark, tmp_path):
    one = VersionedTable(spark, str(tmp_path / "t"))
    one.commit(spark.range(3))
    other = VersionedTable(spark, str(tmp_path / "t"))
    other.version = lambda: None  # as it was before the first commit
    with pytest.raises(ConcurrentCommit):
        other.commit(spark.range(9))
    assert one.version() == 1 and one.read().count() == 3


def test_adjacent_equal_versions_and_odd_days(spark):
    dim = [(1, "a", True, D(2026, 1, 1), D(2026, 1, 20), 1), (1, "a", True, D(2026, 1, 20), None, 1), (2, "b", True, D(2026, 1, 31), None, 1), (3, "c", True, D(2027, 1, 1), None, 1)]
    snaps = [(i, n, dt.datetime(2026, 1, 1), d, "x") for d in DAYS for i, n in ((1, "a"), (2, "b"))]
    versions = clean_versions(spark.createDataFrame(dim, DIM), "id", ["name"])
    raw = spark.createDataFrame(snaps, SNAP)
    clean = clean_snapshots(raw, "id", "snapshot_dt", "updated_at", ["name"])
    got = keyed(apply_snapshots(versions, versions, clean, raw.select("snapshot_dt"), "id", ["name"]))
    assert {r for r in got if r[0] == 1} == {(1, "a", 20260101, 20260120), (1, "a", 20260120, 0)} and (3, "c", 20270101, DAYS[0]) in got
