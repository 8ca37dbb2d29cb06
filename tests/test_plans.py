from __future__ import annotations

import pytest

from tarnwork.operators.stats import ks_p_value, passes_gate, promote
from tarnwork.operators.table_profile import quality_score
from tarnwork.plans import runtime, sizing
from tarnwork.sources.scan import day_back, month_back
from tarnwork.sources.sink import output_files, writer


def test_period_arithmetic_crosses_years():
    assert month_back(202601, 1) == 202512 and month_back(202603, 14) == 202501 and month_back(202612, 0) == 202612
    assert day_back(20260301, 1) == 20260228 and day_back(20260105, 10) == 20251226
    assert sizing.analysis_window(202601) == [202511, 202512, 202601] and sizing.analysis_window(202601, 9) == [202511, 202512, 202601]


def test_partition_grain():
    assert sizing.partition_grain(["202601", "202602"]) == "monthly"
    assert sizing.partition_grain(["20260101", "2026-01-02"]) == "daily"
    assert sizing.partition_grain(["202601", "x"]) == sizing.partition_grain([]) == "unknown"


def test_classes_and_resources():
    assert [sizing.size_class(g) for g in (1, 50, 500, 5000, 50000)] == ["SMALL", "MEDIUM", "LARGE", "VERY_LARGE", "MASSIVE"]
    assert [sizing.skew_class(r) for r in (1, 2.5, 5, 50, 500)] == ["NONE", "LOW", "MODERATE", "HIGH", "EXTREME"]
    small, big = sizing.resources(1), sizing.resources(50_000, 200, joins=True)
    assert small.workers == 2 and big.workers == 200 and small.minutes == 5.0
    for r in (small, big, sizing.resources(700, 12, unions=True, worker=sizing.LARGE)):
        cores = r.workers * r.worker.cores
        assert 2 * cores <= r.shuffle_partitions <= 8 * cores and r.largest_partition_gb > 0
    assert sizing.spark_conf(big, 200)["spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes"] == "64m"
    s = sizing.scenarios(100)
    assert s["light"].workers <= s["expected"].workers <= s["peak"].workers <= s["backfill"].workers
    assert sizing.scaling_factor(12, 3) == 4.0 and sizing.scaling_factor(3, 0) == 1.0
    assert sizing.join_strategy(500, 0.05) == "broadcast" and sizing.join_strategy(500, 5) == "sort_merge"
    assert sizing.cache_advice([{"name": "d", "reads": 2, "size_gb": 1}, {"name": "f", "reads": 2, "size_gb": 50}]) == ["d"]
    assert sizing.quality_gates(1, 0, quality_score(1, 2)) == {"duplicates": True, "key_nulls": True, "score": True}
    assert quality_score(50, 50) == 40.0 and len(sizing.warnings(20, 20, 50, 2000)) == 4


def test_retry_backs_off_and_gives_up():
    waits, calls = [], []

    def fails():
        calls.append(1)
        raise OSError("no")

    with pytest.raises(OSError):
        runtime.retry(fails, 3, 2.0, sleep=waits.append)
    assert waits == [2.0, 4.0] and len(calls) == 3
    assert runtime.retry(lambda: 5) == 5


def test_config_and_pipeline():
    c = runtime.Config.load(["--ENVIRONMENT", "qa", "--LOOKBACK", "2", "--TABLE", "t"], ("TABLE",))
    assert (c.environment, c.lookback, c.extra) == ("qa", 2, {"TABLE": "t"})
    with pytest.raises(runtime.BadArguments):
        runtime.Config.load([], ("TABLE",))
    seen = []
    steps = [runtime.Step("a", lambda d: 1), runtime.Step("b", lambda d: 1 / 0, may_fail=True), runtime.Step("c", lambda d: d["a"] + 1), runtime.Step("off", lambda d: 9, enabled=False)]
    assert runtime.run_pipeline(steps, lambda n, e: seen.append(n)) == {"a": 1, "b": None, "c": 2} and seen == ["b"]
    with pytest.raises(ZeroDivisionError):
        runtime.run_pipeline([runtime.Step("x", lambda d: 1 / 0)])


def test_small_decisions():
    assert passes_gate({"f1": 0.8}, {"f1": 0.8}) and not passes_gate({}, {"f1": 0.1})
    assert promote(None, 0.1) and promote(0.5, 0.6) and not promote(0.5, 0.5)
    assert ks_p_value(0.0, 100, 100) == 1.0 and ks_p_value(0.5, 100, 100) < 1e-6 and 0.6 < ks_p_value(0.1, 100, 100) < 0.72
    assert output_files(1000, 100.0, 1000) == 100 and output_files(0, 1) == 1
    with pytest.raises(ValueError):
        writer("clay tablet")
