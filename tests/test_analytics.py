from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from tarnwork.operators import features, joins, periods, quality, stats, table_profile
from tarnwork.plans import serving


def rows(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_salting_changes_nothing(spark):
    r = random.Random(2)
    a = spark.createDataFrame([(r.choice([1, 1, 1, 2, None]), i) for i in range(300)], "k int, v int")
    b = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z")], "k int, w string")
    for how in ("inner", "left", "left_semi", "left_anti"):
        assert rows(joins.salted_join(a, b, ["k"], how)) == rows(a.join(b, "k", how))
    with pytest.raises(ValueError):
        joins.salted_join(a, b, ["k"], "full")
    for kind, f in (("sum", F.sum), ("count", F.count), ("min", F.min), ("max", F.max), ("avg", F.avg)):
        assert rows(joins.salted_aggregate(a, ["k"], "v", kind)) == rows(a.groupBy("k").agg(f("v")))


def test_salted_copies_are_never_broadcast(spark):
    a = spark.range(200).selectExpr("id % 7 AS k", "id AS v")
    b = spark.range(5).selectExpr("id AS k", "id * 10 AS w")
    for small in (b, F.broadcast(b)):
        for how in ("inner", "left", "left_semi", "left_anti"):
            got = joins.salted_join(a, small, ["k"], how)
            assert rows(got) == rows(a.join(b, "k", how))
            assert "Broadcast" not in got._jdf.queryExecution().executedPlan().toString()


def test_as_of_ties_nulls_and_clashing_names(spark):
    l = spark.createDataFrame([(1, 5, "a"), (1, 3, "b"), (2, 9, "c"), (None, 9, "d")], "k int, t int, v string")
    r = spark.createDataFrame([(1, 3, "r3"), (1, 5, "r5"), (1, 5, "r5b"), (2, 10, "late"), (None, 1, "n")], "k int, t int, v string")
    assert rows(joins.as_of(l, r, ["k"], "t", "t", ["v"], tie="v")) == sorted([(1, 5, "a", "r5b"), (1, 3, "b", "r3"), (2, 9, "c", None), (None, 9, "d", None)], key=str)


def test_period_edges(spark):
    df = spark.createDataFrame([("a", 20251231, 1), ("a", 20260101, 2), ("a", 20260105, 4)], "k string, d int, v int")
    got = {r.d: (r.v_mtd, r.v_ytd, r.v_wtd) for r in periods.running_totals(df, ["v"], ["k"], "d", ("mtd", "ytd", "wtd")).collect()}
    assert got == {20251231: (1, 1, 1), 20260101: (2, 2, 3), 20260105: (6, 6, 4)}
    days = spark.sql("SELECT * FROM VALUES ('a', DATE '2026-01-29', 1), ('a', DATE '2026-02-28', 3), ('a', DATE '2026-03-29', 9), ('a', DATE '2025-02-28', 0) AS t(k, d, v)")
    mom = {str(r.d): r.v_mom_prev for r in periods.compare(days, "v", ["k"], "d", "mom").collect()}
    assert mom["2026-03-29"] is None and mom["2026-02-28"] is None
    yoy = {str(r.d): (r.v_yoy_prev, r.v_yoy_pct) for r in periods.compare(days, "v", ["k"], "d", "yoy").collect()}
    assert yoy["2026-02-28"] == (0, None)


def test_quality_statuses(spark):
    c = quality.Check
    df = spark.createDataFrame([("a", 1), (" ", 2), (None, 3)], "k string, v int")
    checks = [c("few", "row_count"), c("k", "completeness", params={"column": "k", "max": 0.5}), c("none", "completeness", params={"column": "zz"}), c("div", "rule", params={"condition": "1 / (v - 1) > 0"}), c("ok", "rule", params={"condition": "v > 0"}), c("rec", "reconciliation", params={"source_rows": 3}), c("odd", "what")]
    got = {r.check_name: r.status for r in quality.run_checks(df, checks).collect()}
    assert got == {"few": "FAIL", "k": "FAIL", "none": "ERROR", "div": "ERROR", "ok": "PASS", "rec": "PASS", "odd": "ERROR"}
    empty = quality.run_checks(df.limit(0), [c("k", "completeness", params={"column": "k"}), c("f", "freshness", params={"column": "v"})])
    assert [r.status for r in empty.collect()] == ["FAIL", "FAIL"] and quality.has_failures(empty)
    with pytest.raises(Exception, match="few"):
        quality.require(quality.run_checks(df, checks[:1]))
    suite = quality.run_checks(df, quality.gold_suite(["v"], ["v"], "v") + quality.bronze_suite(["k"]))
    assert suite.where("status = 'FAIL'").select("check_name").first()[0] == "schema"


def test_drift_and_scores(spark):
    r = random.Random(7)
    make = lambda m: spark.createDataFrame([(r.gauss(m, 1),) for _ in range(1000)] + [(None,)], "x double")
    a, same, moved = make(0), make(0), make(2)
    rep = lambda b: stats.drift_report(a, b, ["x"]).first()
    assert rep(same).psi < 0.1 and rep(moved).psi > 0.2 and rep(moved).drifted and rep(moved).ks_p < 0.05
    assert rep(a.limit(0)).drifted is False
    s = spark.createDataFrame([(x,) for x in (-0.5, -0.1, 0.2, 0.5, None)], "s double")
    got = {x.s: x.norm_score for x in stats.normalise(s, "s").collect()}
    assert got[-0.5] == 1.0 and got[0.5] == 0.0 and got[None] is None
    assert stats.normalise(spark.createDataFrame([(3.0,), (3.0,)], "s double"), "s").first().norm_score == 0.0
    assert stats.roc_auc(spark.createDataFrame([(1, 0.9), (0, 0.9), (0, 0.1), (1, 0.5)], "t int, s double"), "t", "s").first().auc == pytest.approx(2.5 / 4)


def test_splits_and_features(spark):
    df = spark.range(1000).withColumn("g", (F.col("id") % 7).cast("string"))
    s = features.stratified_split(df, "g", ["id"])
    n = {r.g: (r.all, r.t) for r in s.groupBy("g").agg(F.count("*").alias("all"), F.count_if(F.col("split") == "test").alias("t")).collect()}
    assert all(t == int(a * 0.2) for a, t in n.values()) and s.count() == 1000
    h = features.hash_split(df, ["id"])
    assert 120 < h.where("split = 'test'").count() < 280 and rows(h) == rows(features.hash_split(df.repartition(7), ["id"]))
    z = features.z_scores(spark.createDataFrame([("a", i, 5.0) for i in range(9)], "k string, o int, v double"), ["k"], ["o"], "v")
    assert {r.z_score for r in z.collect()} == {0.0}
    cv = features.rolling(spark.createDataFrame([("a", 1, 0.0), ("a", 2, 0.0)], "k string, o int, v double"), ["k"], ["o"], ["v"], (2,)).collect()
    assert all(r.v_cv_2 is None for r in cv)


def test_profile_of_empty_and_null_keys(spark):
    df = spark.createDataFrame([], "k string, v int")
    assert table_profile.skew(df, ["k"]).first().verdict == "EVEN" and table_profile.duplicates(df, ["k"]).first()["rows"] == 0
    assert {r.severity for r in table_profile.null_shares(df).collect()} == {"OK"}
    nulls = spark.createDataFrame([(None, 1)] * 9 + [("a", 1)], "k string, v int")
    assert table_profile.skew(nulls, ["k"]).first().verdict == "SKEWED"


def test_guard(spark):
    spark.range(50).createOrReplaceTempView("served")
    spark.range(5).createOrReplaceTempView("secret")
    ok = {"served"}
    assert serving.safe_select(spark, "SELECT id AS limit_id FROM served", ok, 7).count() == 7
    assert serving.safe_select(spark, "WITH t AS (SELECT * FROM served WHERE id IN (SELECT id FROM served)) SELECT count(*) FROM t", ok).first()[0] == 50
    for bad in ("DROP TABLE served", "INSERT INTO served SELECT 1", "SELECT * FROM secret", "SELECT 1; SELECT 2", "SELECT * FROM served WHERE id IN (SELECT id FROM secret)", "SELECT (SELECT max(id) FROM secret)", "WITH t AS (SELECT * FROM secret) SELECT * FROM t", "SELECT * FROM parquet.`/tmp`", "SELECT reflect('java.lang.System', 'exit', 0)", "CREATE VIEW v AS SELECT 1", "SET x = 1", "EXPLAIN SELECT 1", "SELECT * FROM served WHERE EXISTS (SELECT 1 FROM secret)"):
        with pytest.raises(serving.UnsafeQueryError):
            serving.safe_select(spark, bad, ok)
    assert [r.id for r in serving.page(spark, "served", ok, ["id DESC"], 2, 3).collect()] == [46, 45]
    for kw in ({"limit": 0}, {"offset": -1}, {"order": []}, {"where": "id IN (SELECT id FROM secret)"}):
        with pytest.raises(serving.UnsafeQueryError):
            serving.page(spark, "served", ok, **({"order": ["id"]} | kw))
    assert [r.id for r in serving.page(spark, "served", ok, ["id % 3 desc nulls last", "id"], 2, 0, "id > 10 AND id <> 11").collect()] == [14, 17]
    assert serving.table_schema(spark, "served").first().type == "bigint" and serving.list_tables(spark, ok).count() == 1


def test_guard_knows_where_a_common_table_expression_is_visible(spark):
    spark.range(50).createOrReplaceTempView("served")
    spark.range(5).createOrReplaceTempView("secret")
    ok = {"served"}
    bad = [
        "WITH secret AS (SELECT * FROM secret) SELECT * FROM secret",
        "SELECT * FROM (WITH secret AS (SELECT 1 AS id) SELECT * FROM secret) CROSS JOIN secret",
        "WITH a AS (SELECT * FROM secret), secret AS (SELECT 1 AS id) SELECT * FROM a",
        "WITH a AS (WITH secret AS (SELECT 1) SELECT * FROM secret) SELECT * FROM secret",
        "WITH RECURSIVE secret AS (SELECT 1 AS id UNION ALL SELECT id FROM secret) SELECT * FROM secret",
        "WITH secret AS (SELECT 1 AS id) SELECT * FROM default.secret",
        "SELECT * FROM IDENTIFIER('secret')",
        "SELECT * FROM secret VERSION AS OF 1",
        "SELECT * FROM served UNION ALL SELECT * FROM secret",
        "FROM secret |> SELECT *",
        "TABLE secret",
        "SELECT * FROM read_files('/tmp')",
    ]
    for sql in bad:
        with pytest.raises(serving.UnsafeQueryError):
            serving.safe_select(spark, sql, ok)
    for sql, n in (("WITH secret AS (SELECT * FROM served) SELECT * FROM secret", 50), ("WITH a AS (SELECT 1 AS x), b AS (SELECT x FROM a) SELECT * FROM b WHERE x IN (SELECT x FROM a)", 1), ("SELECT count(*) AS n, id % 2 FROM served GROUP BY 2 HAVING n > 3 ORDER BY 2", 2), ("SELECT * FROM served s JOIN served t USING (id) WHERE s.id < 3", 3)):
        assert serving.safe_select(spark, sql, ok).count() == n
    for kw in ({"where": "1=1) UNION ALL (SELECT id FROM served"}, {"where": "id > 0 ORDER BY id"}, {"order": ["id LIMIT 1"]}, {"order": ["id", "(SELECT max(id) FROM secret)"]}, {"where": "reflect('java.lang.System', 'exit', 0) = 1"}):
        with pytest.raises(serving.UnsafeQueryError):
            serving.page(spark, "served", ok, **({"order": ["id"]} | kw))
