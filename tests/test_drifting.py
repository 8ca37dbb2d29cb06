from __future__ import annotations

import datetime as dt
import json
import random

from tarnwork.operators.drifting import canonical_names, file_unions, first_deliveries, nested_alternatives, new_alternatives, one_table, paths_of, rejected_records, schema_changes, valid_records
from tarnwork.queries.p4 import p4_found, p4_table

SCHEMA = "raw string, sys string, file string, ts timestamp, v string, field string"
T = dt.datetime(2026, 1, 1)


def record(r, n):
    """The content of file n: amount becomes total in 2, flag leaves in 3 as note comes, code turns into a number in 4."""
    o = {"id": f"B{r.randrange(10**6):08d}", "total" if n >= 2 else "amount": round(r.lognormvariate(3, 1), 2), "code": r.randrange(900, 999) if n >= 4 else str(r.randrange(900, 999)), "when": "2026-01-0%d" % r.randrange(1, 9)}
    if n < 3:
        o["flag"] = r.random() < 0.5
    else:
        o["note"] = r.choice(["picked up late", "box was open", None])
    if r.random() < 0.05:
        o["id"] = None
    return json.dumps(o)


def planted(seed=2):
    r = random.Random(seed)
    rows = []
    for n in range(6):
        own = [(record(r, n), "s", f"f{n}", T + dt.timedelta(days=n), "x", "y") for _ in range(80)]
        rows += own + own[:3] + [(bad, "s", f"f{n}", T + dt.timedelta(days=n), "x", "y") for bad in ("#EOF", '{"id": 1, "tot', "[1]", "", None, '"a"')]
        if n == 1:
            again = [(*x[:3], T + dt.timedelta(days=4, hours=1), "x", "y") for x in own]
    return rows + again + [('{"id": "z"}', "t", "g0", T, "x", "y"), ('{"id": "z"}', None, "g1", T, "x", "y")]


def run(spark, rows):
    df = spark.createDataFrame(rows, SCHEMA)
    files = first_deliveries(df, "sys", "file", "ts")
    records = valid_records(df, "raw", ["sys", "file", "ts"])
    return records, files, file_unions(records, files, "sys", "file", "ts")


def test_planted_drift(spark):
    rows = planted()
    records, files, unions = run(spark, rows)
    got = {tuple(r) for r in schema_changes(unions, files).collect()}
    assert got == {("f2", "renamed", "amount", "total"), ("f3", "removed", "flag", ""), ("f3", "added", "", "note"), ("f4", "retyped", "code", "code")}
    assert {(r.source_file, r.field, r.type) for r in new_alternatives(unions).collect()} == {("f4", "code", "number")}
    fields = canonical_names(schema_changes(unions, files), unions)
    assert set(fields) == {"id", "total", "code", "when", "flag", "note"} and fields["total"][0] == ["total", "amount"]
    t = one_table(records, fields, ["sys", "file", "ts"])
    types = dict(t.dtypes)
    assert types["when"] == "timestamp" and types["total"] == types["code"] == types["code__number"] == "double" and types["code__string"] == "string" and types["flag"] == "boolean"
    valid = [r for r in rows if r[0] and r[0].startswith("{") and r[0].endswith("}")]
    assert t.count() == len(valid)
    want = sum(json.loads(r[0]).get("amount", 0) + json.loads(r[0]).get("total", 0) for r in valid)
    assert abs(t.agg({"total": "sum"}).first()[0] - want) < 1e-6


def test_empty_and_clashing_names(spark):
    records, files, unions = run(spark, [])
    assert schema_changes(unions, files).count() == 0 and canonical_names(schema_changes(unions, files), unions) == {}
    records, files, unions = run(spark, [('{"file": 1, "v": {"a": 2}}', "s", "f", T, "x", "y")])
    t = one_table(records, canonical_names(schema_changes(unions, files), unions), ["sys", "file", "ts"])
    assert {c: t.first()[c] for c in ("file", "file_2", "v")} == {"file": "f", "file_2": 1.0, "v": '{"a":2}'}


def test_a_rename_holds_in_its_system_and_drops_no_value(spark, tmp_path):
    """In w amount becomes total; in s as well, but amount comes back beside it; in t both stand together; in u one flag gives way
    to another that it stood beside."""
    rows = []
    w, s = [{"amount": 9.25}] * 2 + [{"total": 9.75}] * 4, [{"amount": 9.25}] * 2 + [{"total": 9.75}] * 2 + [{"total": 9.75, "amount": 10.5}] * 2
    t, u = [{"amount": 9.5, "total": 12.5}] * 6, [{"returned": True, "warranty": True}] * 2 + [{"returned": True}] * 2 + [{"warranty": True}] * 2
    for system, records in {"s": s, "t": t, "u": u, "w": w}.items():
        for n, x in enumerate(records):
            rows += [(json.dumps({**x, "id": f"B{i:03d}"}), system, f"{system}{n}", T + dt.timedelta(days=n), dt.date(2026, 1, 1)) for i in range(5)]
    rows.append((json.dumps({"amount": 7.75, "total": 8.75}), "w", "w2", T + dt.timedelta(days=9), dt.date(2026, 1, 1)))
    spark.createDataFrame(rows, "raw_value string, _source_system string, _source_file string, _ingest_ts timestamp, _ingest_date date").write.parquet(str(tmp_path / "bronze_sales.parquet"))
    renamed = {tuple(r) for r in p4_found(spark, str(tmp_path)).where("change = 'renamed'").collect()}
    assert renamed == {("s2", "renamed", "amount", "total"), ("w2", "renamed", "amount", "total"), ("u4", "renamed", "returned", "warranty")}
    table = p4_table(spark, str(tmp_path)).collect()
    assert len(table) == len(rows)
    for r in table:
        n = int(r._source_file[1:])
        have = {c: r[c] for c in ("amount", "total", "returned", "warranty") if r[c] is not None}
        if r.redelivered:
            assert {7.75, 8.75} <= {float(r[c]) for c in table[0].asDict() if r[c] and c.split("__")[0] in ("amount", "total")}
        else:
            assert have == ({"total": next(iter(w[n].values()))} if r._source_system == "w" else {"s": s, "t": t, "u": u}[r._source_system][n])


def test_repeated_keys_odd_names_and_rejected_rows(spark):
    texts = ['{"a": 1, "a": 2}', '{"x\'y": 1, "q?": "t", "": 3, "a": null}', "[1]", "#EOF", None, "  "]
    df = spark.createDataFrame([(t, "s", "f", T, "x", "y") for t in texts], SCHEMA)
    records, files, unions = run(spark, [(t, "s", "f", T, "x", "y") for t in texts])
    t = one_table(records, canonical_names(schema_changes(unions, files), unions), ["sys"])
    assert sorted(((r["a"], r["x'y"], r["q?"], r[""]) for r in t.collect()), key=str) == [(2.0, None, None, None), (None, 1.0, "t", 3.0)]
    assert sorted(r.reason for r in rejected_records(df, "raw", ["file"]).collect()) == ["empty", "empty", "no_object", "no_object"]


def test_alternatives_of_nested_paths(spark):
    assert paths_of("OBJECT<a: BIGINT, `b c`: OBJECT<d: ARRAY<OBJECT<e: DECIMAL(4,2)>>, f: VOID>, g: ARRAY<STRING>>", "r") == [
        ("r.a", "number"), ("r.b c", "object"), ("r.b c.d", "array"), ("r.b c.d[]", "object"), ("r.b c.d[].e", "number"), ("r.g", "array"), ("r.g[]", "string")]
    own = [{"o": {"zip": 1, "l": [1]}}, {"o": {"zip": 2, "l": ["x"]}}, {"o": {"zip": "3", "l": []}}]
    rows = [(json.dumps(o), "s", f"f{n}", T + dt.timedelta(days=n), "x", "y") for n, o in enumerate(own)]
    records, files, _ = run(spark, rows)
    got = {tuple(r) for r in nested_alternatives(records, files, "sys", "file", "ts").collect()}
    assert got == {("f1", "o.l[]", "string", 1), ("f2", "o.zip", "string", 1)}


def test_every_value_of_every_record_is_in_the_table(spark):
    """Each value stands, as text or in its type, in exactly the columns of its field: none is lost, none is made up."""
    r = random.Random(6)
    pool = {"amount": [1.5, "2,75", 3, True], "when": ["2026-01-02", "03.01.2026", "04/01/2026", "20260105", "2026-01-06T07:08:09", "soon"], "flag": [True, False, "yes"], "o": [{"a": 1}, [1, 2], "t"]}
    rows = []
    for n in range(8):
        for i in range(40):
            o = {k: r.choice(v[:-1] if r.random() < 0.9 else v) for k, v in pool.items() if r.random() < 0.8}
            rows.append((json.dumps(o), "s", f"f{n}", T + dt.timedelta(days=n), "x", "y"))
    records, files, unions = run(spark, rows)
    fields = canonical_names(schema_changes(unions, files), unions)
    table = one_table(records, fields, ["file"]).collect()
    assert len(table) == len(rows)
    for k in pool:
        branches = [c for c in table[0].asDict() if c.startswith(f"{k}__")]
        want = sum(1 for x in rows if k in json.loads(x[0]))
        assert sum(any(t[c] is not None for c in [k, *branches]) for t in table) == want
        assert len(branches) == 1 or sum(any(t[c] is not None for c in branches) for t in table) == want
        assert all(sum(t[c] is not None for c in branches) <= 1 for t in table)
    days = {t["when"].day for t in table if t["when"]}
    assert days == {2, 3, 4, 5, 6}
