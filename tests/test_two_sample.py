from __future__ import annotations

import datetime as dt
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tarnwork.operators.two_sample import auc, compare, exact_medians, fit, load_tests, one_column
from tarnwork.queries.p2 import p2_found

SCHEMA = "load long, sys string, x long, y long, n long"
BINS = lambda: {"x": (F.when(F.col("x").isNull(), 0).otherwise(F.least(F.floor(F.col("x") / 10), F.lit(8)) + 1), 10), "y": (F.coalesce(F.pmod("y", F.lit(3)), F.lit(0)), 3)}


def rows(seed=1):
    r = random.Random(seed)
    out = []
    for load in range(1, 7):
        for i in range(301 if load != 4 else 3):
            x = r.randrange(100) if load != 3 else min(99, r.randrange(40, 160))
            out.append((load, "s" if load < 6 else "t", x if r.random() > 0.05 else None, i, 1))
    return out + [(None, "s", 1, 1, 1)]


def prepared(spark, data):
    df = spark.createDataFrame(data, SCHEMA)
    return df, load_tests(df, "load", "sys", BINS(), F.pmod(F.xxhash64("x", "y"), F.lit(2)), {"x": F.floor(F.col("x") / 10)})


def test_shift_is_found_by_the_column_that_moved(spark):
    data = rows()
    df, t = prepared(spark, data)
    got = {r.load: r for r in t.collect()}
    assert [got[i].prev for i in range(1, 7)] == [None, 1, 2, 3, 4, None]
    assert got[3].auc_only_x > 0.7 and got[3].auc_drop_y > 0.7 > 0.6 > got[3].auc_drop_x
    assert got[2].auc_only_x < 0.6 and got[1].auc is None
    values = df.where("x IS NOT NULL").select("load", F.lit("x").alias("column"), F.floor(F.col("x") / 10).alias("bin"), F.col("x").alias("value"))
    med = {r.load: r.twice for r in exact_medians(values, t, ["x"]).collect()}
    want = {i: 2 * float(np.median([x for k, _, x, *_ in data if k == i and x is not None])) for i in range(1, 7)}
    assert med == want


def test_empty_table_and_all_null(spark):
    assert prepared(spark, [])[1].count() == 0
    _, t = prepared(spark, [(1, "s", None, None, 1), (2, "s", None, None, 1)])
    assert {r.load: (r.rows, r.n_x) for r in t.collect()} == {1: (1, 0), 2: (1, 0)}


def test_auc_against_pairs_and_fit_against_closed_form():
    r = np.random.default_rng(0)
    s, a, b = r.integers(0, 5, 40).astype(float), r.integers(0, 4, 40), r.integers(0, 4, 40)
    brute = sum(a[i] * b[j] * ((s[i] > s[j]) + 0.5 * (s[i] == s[j])) for i in range(40) for j in range(40)) / (a.sum() * b.sum())
    assert auc(s, a, b) == pytest.approx(brute)
    c = np.arange(3)
    n1, n0 = np.array([50.0, 20, 5]), np.array([5.0, 20, 50])
    coef = fit([c], [3], n1, n0, l2=1e-6, steps=30)
    assert np.allclose(coef[0] + coef[1:], np.log(n1 / n0), atol=1e-3)
    assert np.isnan(compare(np.array([0]), np.array([3]), np.array([0]), np.array([3]), [2])[0])


def test_medians_that_move_inside_a_bin_are_shifts(spark, tmp_path):
    at = dt.datetime(2026, 5, 1)

    def load(k, n, amount, days):
        return [(k, "s", f"TXN-20260501-{k * 1000 + i:010d}", f"{amount + i % 20}.{i % 100:02d}", at - dt.timedelta(days=days, seconds=i), at) for i in range(n)]

    data = load(1, 500, 300, 12) + load(2, 500, 600, 12) + load(3, 500, 600, 16) + load(4, 500, 620, 15) + load(5, 5, 300, 15)
    df = spark.createDataFrame(data, "load_id long, _source_system string, transaction_id string, amount string, record_date timestamp, _ingest_ts timestamp")
    df.write.parquet(str(tmp_path / "sales.parquet"))
    got = {(r.load_id, r.column_name) for r in p2_found(spark, str(tmp_path)).where("finding = 'shift'").collect()}
    assert got == {(2, "amount"), (3, "record_date"), (5, "amount")}


def sales(tmp_path, spark, loads):
    """loads: lists of (amount text, age in days)."""
    at = dt.datetime(2026, 5, 1)
    data = [(k, "s", f"TXN-20260501-{k * 10**6 + i:010d}", a, None if d is None else at - dt.timedelta(days=d), at) for k, own in enumerate(loads) for i, (a, d) in enumerate(own)]
    df = spark.createDataFrame(data, "load_id long, _source_system string, transaction_id string, amount string, record_date timestamp, _ingest_ts timestamp")
    df.write.parquet(str(tmp_path / "sales.parquet"))
    got = p2_found(spark, str(tmp_path)).where("finding = 'shift'").collect()
    want = set()
    for k in range(1, len(loads)):
        (a0, d0), (a1, d1) = (tuple(np.array([float(x[i]) for x in own if x[i] is not None]) for i in (0, 1)) for own in (loads[k - 1], loads[k]))
        m0, m1 = np.median(a0), np.median(a1)
        want |= {(k, "amount")} if 2 * m1 > 3 * m0 + 1e-9 or 3 * m1 < 2 * m0 - 1e-9 else set()
        want |= {(k, "record_date")} if abs(np.median(d1) - np.median(d0)) > 2 else set()
    assert {(r.load_id, r.column_name) for r in got} == want
    return want


def test_every_shift_is_found_wherever_it_stands_in_a_bin(spark, tmp_path):
    loads = [[(f"{a:.2f}", d)] * 40 for a, d in ((62, 80), (115, 109))]
    x, d = 0.01, 1.0
    while x < 1e7:  # just within and just beyond the limits, all along the scale
        loads.append([(f"{x:.2f}", d)] * 30 + [(f"{x * 1.1:.2f}", d)])
        x, d = x * (1.49 if len(loads) % 2 else 1.52) + 0.01, d + (2.5 if len(loads) % 3 else 1.5)
    assert len(sales(tmp_path, spark, loads)) > 40


def test_shifts_by_one_row_and_below_zero(spark, tmp_path):
    half = lambda n, m: [("1.00", 1)] * n + [("900.00", 90)] * m
    loads = [half(501, 500), half(500, 501), half(500, 500), half(1000, 1000), half(1, 0), half(0, 1), [("-5.00", 3)] * 9, [("-5.00", 3)] * 9, [("-100.00", 3), ("110.00", 3)], [("-105.00", 3), ("106.00", 3)], [("0.00", 3)] * 2, [("0.00", 3)] * 3]
    want = sales(tmp_path, spark, loads)
    assert {(1, "amount"), (1, "record_date"), (7, "amount"), (9, "amount")} <= want and (3, "amount") not in want and (11, "amount") not in want


def test_the_model_of_one_column_says_nothing_only_of_equal_shares():
    codes = np.array([0, 1, 4, 5])
    assert one_column(codes, np.array([3, 3, 1, 1]), codes, np.array([6, 6, 2, 2])) == (pytest.approx(0.5), False)
    big = 10**12
    assert one_column(codes, np.array([big, big, 1, 1]), codes, np.array([big, big, 2, 1]))[1]
