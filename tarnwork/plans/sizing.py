"""Advice for a job from the profile of its sources: pure functions, no cloud calls."""

from __future__ import annotations

import math
import re
from dataclasses import dataclass

from tarnwork.sources.scan import month_back


@dataclass(frozen=True)
class Worker:
    """``simple``, ``complex``, ``extreme``: GB of input one such worker takes."""

    name: str
    cores: int
    memory_gb: float
    simple: float
    complex: float
    extreme: float
    price_hour: float


# Capacities and prices of the two kinds of worker.
STANDARD = Worker("standard", 4, 16, 6.0, 3.0, 1.5, 0.44)
LARGE = Worker("large", 4, 30.5, 14.0, 7.0, 3.5, 0.40)
#: GB a worker gets through in a minute.
THROUGHPUT = {"simple": 2.0, "moderate": 1.0, "complex": 0.5, "extreme": 0.25}
MIN_WORKERS, MAX_WORKERS = 2, 200


def analysis_window(end_month: int, months: int = 3) -> list[int]:
    """The months to analyse, at most three, up to ``end_month``."""
    return [month_back(end_month, k) for k in range(min(max(months, 1), 3) - 1, -1, -1)]


def partition_grain(values: list[str]) -> str:
    """monthly (6 digits), daily (8 digits or yyyy-MM-dd) or unknown, by the shape of every value."""
    shapes = {"monthly" if re.fullmatch(r"\d{6}", v) else "daily" if re.fullmatch(r"\d{8}|\d{4}-\d{2}-\d{2}", v) else "unknown" for v in values}
    return shapes.pop() if len(shapes) == 1 else "unknown"


def scaling_factor(total_partitions: int, analysed: int) -> float:
    return max(1.0, total_partitions / analysed) if analysed else 1.0


def size_class(gb: float) -> str:
    return next((name for top, name in ((10, "SMALL"), (100, "MEDIUM"), (1000, "LARGE"), (10_000, "VERY_LARGE")) if gb < top), "MASSIVE")


def skew_class(ratio: float) -> str:
    return next((name for top, name in ((2, "NONE"), (3, "LOW"), (10, "MODERATE"), (100, "HIGH")) if ratio < top), "EXTREME")


def complexity(gb: float, skew_ratio: float, joins: bool, unions: bool) -> str:
    if skew_ratio >= 100:
        return "extreme"
    if skew_ratio >= 10 or (joins and gb >= 1000):
        return "complex"
    return "moderate" if joins or unions or skew_ratio >= 3 else "simple"


def skew_factor(ratio: float) -> tuple[float, float]:
    """(times workers, times duration)."""
    return (1.5, 3.0) if ratio > 100 else (1.2, 2.0) if ratio > 10 else (1.0, 1.5) if ratio > 3 else (1.0, 1.0)


@dataclass(frozen=True)
class Resources:
    workers: int
    worker: Worker
    shuffle_partitions: int
    minutes: float
    cost: float
    largest_partition_gb: float


def resources(gb: float, skew_ratio: float = 1.0, joins: bool = False, unions: bool = False, worker: Worker = STANDARD, shuffle_share: float = 0.5) -> Resources:
    """Workers for ``gb`` of input, shuffle partitions of 128 MB (2 to 8 per core), duration and cost."""
    kind = complexity(gb, skew_ratio, joins, unions)
    per = {"simple": worker.simple, "moderate": worker.complex, "complex": worker.complex, "extreme": worker.extreme}[kind]
    more, slower = skew_factor(skew_ratio)
    n = min(MAX_WORKERS, max(MIN_WORKERS, math.ceil(gb / per * more)))
    cores = n * worker.cores
    parts = min(8 * cores, max(2 * cores, math.ceil(gb * shuffle_share * 1024 / 128)))
    minutes = max(5.0, gb / (THROUGHPUT[kind] * n) * slower + (3 if gb < 10 else 5))
    return Resources(n, worker, parts, round(minutes, 1), round(n * worker.price_hour * minutes / 60, 2), round(gb * shuffle_share / parts * max(skew_ratio, 1.0), 3))


def scenarios(gb: float, skew_ratio: float = 1.0, joins: bool = False, unions: bool = False, worker: Worker = STANDARD) -> dict[str, Resources]:
    """The input at a half, once, twice and five times its size."""
    return {name: resources(gb * k, skew_ratio, joins, unions, worker) for name, k in (("light", 0.5), ("expected", 1.0), ("peak", 2.0), ("backfill", 5.0))}


def spark_conf(r: Resources, skew_ratio: float = 1.0, broadcast_mb: int = 100) -> dict[str, str]:
    """Settings for a job: adaptive execution, partition counts, skew handling by class."""
    factor, threshold = {"NONE": (5, 256), "LOW": (5, 256), "MODERATE": (3, 128), "HIGH": (2, 64), "EXTREME": (2, 64)}[skew_class(skew_ratio)]
    return {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": str(factor),
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{threshold}m",
        "spark.sql.shuffle.partitions": str(r.shuffle_partitions),
        "spark.sql.autoBroadcastJoinThreshold": f"{broadcast_mb}m",
        "spark.sql.files.maxPartitionBytes": "128m",
        "spark.executor.instances": str(r.workers),
        "spark.executor.cores": str(r.worker.cores),
    }


def cache_advice(sources: list[dict]) -> list[str]:
    """Names of dimensions read more than once that are below 10,000 MB."""
    return [s["name"] for s in sources if s.get("reads", 1) > 1 and s["size_gb"] * 1000 < 10_000]


def join_strategy(left_gb: float, right_gb: float, broadcast_mb: float = 100) -> str:
    return "broadcast" if min(left_gb, right_gb) * 1000 <= broadcast_mb else "sort_merge"


def warnings(skew_ratio: float, null_pct: float, quality: float, gb: float) -> list[str]:
    out = []
    if skew_ratio >= 10:
        out.append("a few keys hold most rows: aggregate in a tree, or salt the join")
    if null_pct > 10:
        out.append("many keys are null: filter them before joining")
    if quality < 70:
        out.append("low quality score: deduplicate and cleanse first")
    if gb >= 1000:
        out.append("more than 1 TB: read a look-back only")
    return out


def quality_gates(duplicate_pct: float, key_null_pct: float, quality: float) -> dict[str, bool]:
    """The null gate looks at the primary key."""
    return {"duplicates": duplicate_pct <= 5.0, "key_nulls": key_null_pct == 0.0, "score": quality >= 70.0}
