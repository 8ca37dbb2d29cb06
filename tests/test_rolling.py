from __future__ import annotations

import datetime as dt
import random

from tarnwork.operators.rolling import latest_by, trailing_totals

SCHEMA = "site string, day date, amount long, total_7 string"


def test_against_brute_force(spark):
    rnd = random.Random(1)
    d0 = dt.date(2026, 2, 20)
    rows = [(rnd.choice(["hot", "hot", "a", "b", None]), d0 + dt.timedelta(rnd.randrange(70)) if rnd.random() < 0.95 else None, rnd.choice([None, -5, 0, 7, 100]), "x") for _ in range(400)]
    got = {(r.site, r.day): (r.first_day, r.total_7, r.total_30) for r in trailing_totals(spark.createDataFrame(rows, SCHEMA), "site", "day", "amount").collect()}
    want = {}
    for s in {"hot", "a", "b"}:
        own = [(d, a or 0) for k, d, a, _ in rows if k == s and d]
        lo, hi = min(d for d, _ in own), max(d for d, _ in own)
        for i in range((hi - lo).days + 1):
            day = lo + dt.timedelta(i)
            want[s, day] = (lo, *(sum(a for d, a in own if day - dt.timedelta(w) < d <= day) for w in (7, 30)))
    assert got == want


def test_empty_and_single_row(spark):
    assert trailing_totals(spark.createDataFrame([], SCHEMA), "site", "day", "amount").count() == 0
    one = trailing_totals(spark.createDataFrame([("a", dt.date(2026, 1, 1), 3, "")], SCHEMA), "site", "day", "amount").collect()
    assert [(r.day, r.total_7) for r in one] == [(dt.date(2026, 1, 1), 3)]


def test_latest_by_ties_and_nulls(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, None), ("a", 2, 7), ("b", None, 4), ("a", 2, 7)], "k string, o int, v int")
    assert {r.k: r.v for r in latest_by(df, ["k"], "o", "v").collect()} == {"a": 7, "b": 4}
