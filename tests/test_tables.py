from __future__ import annotations

import datetime as dt

import pytest
from pyspark.sql import functions as F

from tarnwork.functions.schema import align_to, cast_or_divert, composite_id, drift_report, exact_round, feature_type
from tarnwork.operators import dml, shaping
from tarnwork.plans import runtime
from tarnwork.sources import scan, sink
from tarnwork.sources.versioned import VersionedTable


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_files_in_every_format_and_mode(spark, tmp_path):
    df = spark.createDataFrame([(1, "a", "20260101"), (2, "b", "20260102")], "id int, name string, day string")
    for fmt in ("parquet", "csv", "json", "orc"):
        sink.write_files(df, f"{tmp_path}/{fmt}", fmt=fmt, **({"header": "true"} if fmt == "csv" else {}))
        assert rows(scan.read_files(spark, f"{tmp_path}/{fmt}", fmt, schema=df.schema)) == rows(df)
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad/x.json").write_text('{"id": 1, "name": "a"}\n{"id": "q"}\n#EOF\n')
    good, bad = scan.split_corrupt(scan.read_files(spark, f"{tmp_path}/bad", "json", "id int, name string", mode="PERMISSIVE").cache())
    assert rows(good) == [(1, "a")] and bad.count() == 2
    assert len(scan.read_files(spark, f"{tmp_path}/bad", "json", "id int, name string", mode="DROPMALFORMED").collect()) == 1
    with pytest.raises(Exception):
        scan.read_files(spark, f"{tmp_path}/bad", "json", "id int, name string", mode="FAILFAST").collect()


def test_partitioned_writes_replace_only_what_they_hold(spark, tmp_path):
    df = spark.createDataFrame([(1, 202601), (2, 202602)], "id int, m int")
    at = f"{tmp_path}/t"
    assert sink.full_load(df, at, ["m"])
    assert sink.full_load(df.where("m = 202602").withColumn("id", F.lit(9)), at, ["m"])
    assert not sink.full_load(df.limit(0), at, ["m"])
    assert rows(spark.read.parquet(at).select("id", "m")) == [(1, 202601), (9, 202602)]
    spark.sql("DROP TABLE IF EXISTS parts")
    sink.sync_catalog(spark, "parts", at, partitioned=True)
    assert [r.value for r in scan.partitions_of(spark, "parts", "m").collect()] == ["202601", "202602"]
    assert [r.value for r in scan.partitions_of(spark, "parts", "m", "202602").collect()] == ["202602"]
    sink.drop_partitions(spark, "parts", "m", [202601])
    sink.add_columns(spark, "parts", {"note": "string", "ID": "int"})
    assert rows(spark.table("parts").select("id", "note")) == [(9, None)]
    spark.sql("DROP TABLE parts")


def test_versioned_merge_and_feature_table(spark, tmp_path):
    t = VersionedTable(spark, f"{tmp_path}/v")
    with pytest.raises(FileNotFoundError):
        t.read()
    sink.merge_upsert(spark.createDataFrame([(1, "a", 1), (1, "b", 2), (2, "c", 1)], "id int, v string, o int"), t, ["id"], [F.desc("o")])
    sink.merge_upsert(spark.createDataFrame([(2, "z", 5), (3, "n", 1)], "id int, v string, o int"), t, ["id"])
    assert rows(t.read()) == [(1, "b", 2), (2, "z", 5), (3, "n", 1)] and t.read(1).count() == 2
    sink.load_window(spark.createDataFrame([(7, "w", 1), (8, "x", 9)], "id int, v string, o int"), t, "o", 1, 2)
    assert rows(t.read()) == [(2, "z", 5), (7, "w", 1)]
    f = sink.FeatureTable(spark, f"{tmp_path}/f", ["id"])
    f.write(spark.createDataFrame([(1, 0.5), (1, 0.5), (None, 1.0)], "id int, x double"))
    f.write(spark.createDataFrame([(1, 0.7), (None, 2.0)], "id int, x double"))
    assert rows(f.read()) == [(1, 0.7), (None, 2.0)]
    f.drop()
    with pytest.raises(FileNotFoundError):
        f.read()


def test_scd2_cases(spark):
    h = "id int, part string, v string, is_current boolean, effective_start date, effective_end date"
    d0, d1 = dt.date(2026, 1, 1), dt.date(2026, 2, 1)
    hist = spark.createDataFrame([(1, "a", "x", True, d0, None), (2, None, "x", True, d0, None), (3, "a", None, True, d0, None), (4, "a", "x", True, d0, None), (1, "a", "w", False, d0, d0)], h)
    src = spark.createDataFrame([(1, "a", "x"), (2, None, "y"), (3, "a", "n"), (5, "a", None), (None, "a", "q")], "id int, part string, v string")
    out = dml.scd2(hist, src, ["id", "part"], ["v"], F.lit("2026-02-01").cast("date"))
    assert rows(out) == sorted([
        (1, "a", "w", False, d0, d0), (1, "a", "x", True, d0, None), (2, None, "x", False, d0, d1), (2, None, "y", True, d1, None), (3, "a", None, False, d0, d1),
        (3, "a", "n", True, d1, None), (4, "a", "x", True, d0, None), (5, "a", None, True, d1, None), (None, "a", "q", True, d1, None)], key=str)
    again = dml.scd2(out, src, ["id", "part"], ["v"], F.lit("2026-03-01").cast("date"))
    assert rows(again) == rows(out)
    closed = dml.scd2(hist, src, ["id", "part"], ["v"], F.lit("2026-02-01").cast("date"), close_missing=True)
    assert (4, "a", "x", False, d0, d1) in rows(closed)


def test_cdc_cases(spark):
    t = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    c = spark.createDataFrame([(1, "i", "I", 1), (1, "u", "U", 2), (1, None, "D", 3), (2, "n", "U", 1), (9, None, "D", 1), (3, "x", "I", 1), (3, "x", "I", 1)], "id int, v string, op string, o int")
    once = dml.apply_changes(t, c, ["id"], "op", [F.desc("o")])
    assert rows(once) == [(2, "n"), (3, "x")] == rows(dml.apply_changes(once, c, ["id"], "op", [F.desc("o")]))
    with pytest.raises(ValueError):
        dml.apply_changes(t, c, ["id"], "op", [])


def test_schema_helpers(spark):
    a, b = spark.createDataFrame([], "id int, x string, n long"), spark.createDataFrame([], "ID long, y string, n long")
    assert {r.column_name: r.change for r in drift_report(a, b).collect()} == {"id": "retyped", "x": "new", "y": "removed", "n": "same"}
    assert align_to(spark.createDataFrame([("5", 1)], "ID string, z int"), b.schema).first().asDict() == {"ID": 5, "y": None, "n": None}
    df = spark.createDataFrame([("a", None), (None, "a")], "p string, q string")
    assert len({r[0] for r in df.select(composite_id(["p", "q"])).collect()}) == 2
    assert spark.range(1).select(exact_round(F.lit(19.275))).first()[0] == 19.28
    good, bad = cast_or_divert(spark.createDataFrame([("1", "x"), ("q", "y"), (None, "z")], "n string, _x string"), {"n": "int"})
    assert rows(good) == [(1, "x"), (None, "z")] and [r["_errors"] for r in bad.collect()] == [["n"]]
    assert [feature_type(f.dataType) for f in spark.createDataFrame([], "a int, b decimal(9,2), c date").schema] == ["Integral", "Fractional", "String"]


def test_rescued_fields(spark):
    df = spark.createDataFrame([('{"id": 1, "more": {"a": 2}}',), ('{"id": "7"}',), ("#EOF",), (None,)], "raw string")
    got = {(r.id, r["_rescued"]) for r in scan.rescued_json(df, "raw", "id string").collect()}
    assert got == {("1", '{"more":{"a":2}}'), ("7", None), (None, "#EOF"), (None, None)}


def test_zero_fill(spark):
    fact = spark.createDataFrame([("s1", 20260131, 202601, 5), ("s2", 20260201, 202602, 1), ("gone", 20260201, 202602, 3)], "site string, day int, m int, n int")
    dim = spark.createDataFrame([("s1",), ("s2",), ("s3",), ("s3",), (None,)], "site string")
    out = shaping.zero_fill(fact, dim, "site", ["day", "m"], ["n"])
    assert rows(out) == sorted([("s1", 20260131, 202601, 5), ("s1", 20260201, 202602, 0), ("s2", 20260131, 202601, 0), ("s2", 20260201, 202602, 1), ("s3", 20260131, 202601, 0), ("s3", 20260201, 202602, 0)], key=str)


def test_state_tables_and_layer_job(spark, tmp_path):
    w = runtime.Watermarks(spark, f"{tmp_path}/w")
    assert w.get("a") is None
    w.set("a", 9, "int")
    w.set("a", 10, "int")
    assert w.get("a") == ("10", "int")
    assert w.is_current("a", spark.sql("SELECT 9 AS m")) and not w.is_current("a", spark.sql("SELECT 11 AS m")) and not w.is_current("b", spark.sql("SELECT 1 AS m"))
    audit = runtime.Audit(spark, f"{tmp_path}/audit", clock=iter([100.0, 101.25]).__next__)
    audit.finish(audit.start("job", "gold", "s", "t"), 5, None, "FAILED", "e" * 2000)
    r = audit.read().first()
    assert (r.duration_sec, r.rows_in, r.rows_out, len(r.error)) == (1.2, 5, None, 1000)
    a, b, none = spark.createDataFrame([(2,)], "d int"), spark.createDataFrame([(1,)], "d int"), spark.createDataFrame([], "d int")
    assert runtime.has_new_data(a, b, "d") and not runtime.has_new_data(b, a, "d") and runtime.has_new_data(a, none, "d") and not runtime.has_new_data(none, a, "d")
    m = spark.createDataFrame([(202511,), (202512,), (202601,), (None,)], "m int")
    assert rows(runtime.months_to_process(m, "m", 1)) == [(202512,), (202601,)] and runtime.months_to_process(m, "m", 0).count() == 3
    out = []
    job = runtime.LayerJob(read=lambda: a, transform=lambda d: d, write=lambda d: out.append(d.count()))
    assert job.run() == "DONE" and out == [1]
    assert runtime.LayerJob(read=lambda: none, transform=None, write=None).run() == "EMPTY"
