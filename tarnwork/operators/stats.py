"""Drift, anomaly scores and model metrics as aggregates."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

PSI_DRIFT, KS_DRIFT = 0.2, 0.05
EPS = 1e-6


def psi(baseline: DataFrame, current: DataFrame, col: str, bins: int = 10) -> DataFrame:
    """(psi): population stability index over equal-width bins between the baseline's least and greatest value, the last one
    closed. Current values outside fall into no bin but count in the total. Nulls are dropped; an empty side gives null."""
    v = F.col(col).cast("double")
    lim = baseline.agg(F.min(v).alias("__lo"), F.max(v).alias("__hi"))
    both = baseline.select(v.alias("__v"), F.lit(0).alias("__c")).unionByName(current.select(v.alias("__v"), F.lit(1).alias("__c"))).where("__v IS NOT NULL")
    width = (F.col("__hi") - F.col("__lo")) / F.lit(bins)
    at = F.when(F.col("__v").between(F.col("__lo"), F.col("__hi")), F.least(F.when(width > 0, F.floor((F.col("__v") - F.col("__lo")) / width)).otherwise(F.lit(0)), F.lit(bins - 1)))
    per = both.crossJoin(F.broadcast(lim)).groupBy(at.alias("bin")).agg(F.count_if(F.col("__c") == 0).alias("b"), F.count_if(F.col("__c") == 1).alias("c"))
    whole = per.agg(F.sum("b").alias("nb"), F.sum("c").alias("nc"), F.collect_list(F.when(F.col("bin").isNotNull(), F.struct("bin", "b", "c"))).alias("x"))
    term = lambda b, c: (c - b) * F.log(c / b)
    share = lambda n, total: n / total + F.lit(EPS)
    used = F.aggregate("x", F.lit(0.0), lambda a, r: a + term(share(r["b"], F.col("nb")), share(r["c"], F.col("nc"))))
    return whole.select(F.when((F.col("nb") > 0) & (F.col("nc") > 0), used).alias("psi"))  # bins empty on both sides add 0


def ks(baseline: DataFrame, current: DataFrame, col: str) -> DataFrame:
    """(d, n1, n2): the two-sample Kolmogorov-Smirnov statistic. Equal values are counted first; the cumulative shares run over
    value ranges in parallel: each range's offset is the sum of those before it."""
    v = F.col(col).cast("double")
    both = baseline.select(v.alias("v"), F.lit(1).alias("a"), F.lit(0).alias("b")).unionByName(current.select(v.alias("v"), F.lit(0).alias("a"), F.lit(1).alias("b"))).where("v IS NOT NULL")
    per = both.groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    # ranges of values by their leading digits keep the order: buckets of the value between the least and the greatest
    lim = per.agg(F.min("v").alias("lo"), F.max("v").alias("hi"), F.sum("a").alias("n1"), F.sum("b").alias("n2"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024)).otherwise(F.lit(0))
    d = per.crossJoin(F.broadcast(lim)).withColumn("k", bucket)
    off = d.groupBy("k").agg(F.sum("a").alias("ka"), F.sum("b").alias("kb"))
    run = W.orderBy("k")  # at most 1025 buckets
    off = off.select(F.col("k").alias("__k"), (F.sum("ka").over(run) - F.col("ka")).alias("oa"), (F.sum("kb").over(run) - F.col("kb")).alias("ob"))
    w = W.partitionBy("k").orderBy("v").rowsBetween(W.unboundedPreceding, 0)
    cum = d.join(F.broadcast(off), F.col("k") == F.col("__k")).select("n1", "n2", (F.col("oa") + F.sum("a").over(w)).alias("ca"), (F.col("ob") + F.sum("b").over(w)).alias("cb"))
    gap = F.abs(F.try_divide(F.col("ca").cast("double"), F.col("n1")) - F.try_divide(F.col("cb").cast("double"), F.col("n2")))
    return cum.agg(F.max(gap).alias("d"), F.max("n1").alias("n1"), F.max("n2").alias("n2"))


def ks_p_value(d: float, n1: int, n2: int) -> float:
    """Asymptotic p-value of a two-sample statistic."""
    en = math.sqrt(n1 * n2 / (n1 + n2))
    x = (en + 0.12 + 0.11 / en) * d
    if x < 0.2:
        return 1.0
    return max(0.0, min(1.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * k * k * x * x) for k in range(1, 101))))


def drift_report(baseline: DataFrame, current: DataFrame, cols: list[str]) -> DataFrame:
    """(feature, psi, ks_stat, ks_p, drifted) per column, rounded to 4 places; an empty side is not drifted."""
    rows = []
    for c in cols:
        p, k = psi(baseline, current, c).first()["psi"], ks(baseline, current, c).first()
        if p is None or not k["n1"] or not k["n2"]:
            rows.append((c, None, None, None, False))
        else:
            pv = ks_p_value(k["d"], k["n1"], k["n2"])
            rows.append((c, round(p, 4), round(k["d"], 4), round(pv, 4), p > PSI_DRIFT or pv < KS_DRIFT))
    return baseline.sparkSession.createDataFrame(rows, "feature string, psi double, ks_stat double, ks_p double, drifted boolean")


def normalise(df: DataFrame, score: str, keys: list[str] = (), name: str = "norm_score") -> DataFrame:
    """Inverted min-max score in [0, 1] (the lowest raw score is 1), overall or per key; constant scores give 0. Limits are
    aggregated and joined back, so no key's rows meet in one task."""
    lo, hi = F.min(score).alias("__lo"), F.max(score).alias("__hi")
    if keys:
        lim = df.groupBy(*keys).agg(lo, hi)
        j = df.alias("a").join(lim.withColumnsRenamed({k: f"__{k}" for k in keys}), [F.col(f"a.{k}").eqNullSafe(F.col(f"__{k}")) for k in keys])
    else:
        j = df.alias("a").crossJoin(F.broadcast(df.agg(lo, hi)))
    v = F.coalesce(F.try_divide(F.col("__hi") - F.col(score), F.col("__hi") - F.col("__lo")), F.when(F.col(score).isNotNull(), F.lit(0.0)))
    return j.select("a.*", F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))).alias(name))


def two_levels(df: DataFrame, anomaly: str, score: str) -> DataFrame:
    """``level``: of anomalies HIGH from the mean score of the anomalies on, else LOW; null for the rest."""
    mean = df.where(anomaly).agg(F.avg(score).alias("__m"))
    return df.crossJoin(F.broadcast(mean)).withColumn("level", F.when(F.expr(anomaly), F.when(F.col(score) >= F.col("__m"), "HIGH").otherwise("LOW"))).drop("__m")


def severity(df: DataFrame, score: str, sensitivity: float = 0.1) -> DataFrame:
    """``severity`` by the cuts 0.7, 0.85 and 0.95, and ``is_anomaly``: a score above 1 - sensitivity."""
    s = F.col(score)
    return df.withColumns({"severity": F.when(s >= 0.95, "CRITICAL").when(s >= 0.85, "HIGH").when(s >= 0.7, "MEDIUM").otherwise("LOW"), "is_anomaly": s > 1 - sensitivity})


def forecast_metrics(df: DataFrame, truth: str, forecast: str) -> DataFrame:
    """mape (rows of truth 0 left out), smape, rmse."""
    t, f = F.col(truth).cast("double"), F.col(forecast).cast("double")
    return df.agg(
        (F.avg(F.when(t != 0, F.abs((t - f) / t))) * 100).alias("mape"),
        (F.avg(2 * F.abs(f - t) / (F.abs(t) + F.abs(f) + 1e-8)) * 100).alias("smape"),
        F.sqrt(F.avg((t - f) * (t - f))).alias("rmse"),
    )


def regression_metrics(df: DataFrame, truth: str, forecast: str) -> DataFrame:
    """rmse, mae, r2, mape."""
    t, f = F.col(truth).cast("double"), F.col(forecast).cast("double")
    sse = F.sum((t - f) * (t - f))
    return df.agg(F.sqrt(F.avg((t - f) * (t - f))).alias("rmse"), F.avg(F.abs(t - f)).alias("mae"), (1 - F.try_divide(sse, F.var_pop(t) * F.count(t))).alias("r2"), (F.avg(F.when(t != 0, F.abs((t - f) / t))) * 100).alias("mape"))


def classification_metrics(df: DataFrame, truth: str, predicted: str) -> DataFrame:
    """accuracy and support-weighted precision, recall and f1, from confusion counts; null labels are left out."""
    c = df.where(F.col(truth).isNotNull() & F.col(predicted).isNotNull()).groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count(F.lit(1)).alias("n"))
    side = F.explode(F.array(F.struct(F.col("t").alias("k"), F.col("n").alias("truth"), F.lit(0).cast("long").alias("said")), F.struct(F.col("p").alias("k"), F.lit(0).cast("long").alias("truth"), F.col("n").alias("said")))).alias("s")
    hit = F.when(F.col("t") == F.col("p"), F.col("n")).otherwise(0)
    k = c.select(side, hit.alias("hit")).groupBy("s.k").agg(F.sum("s.truth").alias("truth"), F.sum("s.said").alias("said"), (F.sum("hit") / 2).alias("hit"))
    p, r = F.coalesce(F.try_divide("hit", "said"), F.lit(0.0)), F.coalesce(F.try_divide("hit", "truth"), F.lit(0.0))
    f1 = F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0))
    avg = lambda x: F.try_divide(F.sum(F.col("truth") * x), F.sum("truth"))
    return k.agg(F.try_divide(F.sum("hit"), F.sum("truth")).alias("accuracy"), avg(p).alias("precision"), avg(r).alias("recall"), avg(f1).alias("f1"))


def roc_auc(df: DataFrame, truth: str, score: str) -> DataFrame:
    """(auc) of a 0/1 truth, ties counting half. Equal scores are counted first; ranks run over value buckets as in ``ks``."""
    per = df.where(F.col(truth).isNotNull() & F.col(score).isNotNull()).groupBy(F.col(score).cast("double").alias("v")).agg(F.count_if(F.col(truth) == 1).alias("a"), F.count_if(F.col(truth) == 0).alias("b"))
    lim = per.agg(F.min("v").alias("lo"), F.max("v").alias("hi"))
    bucket = F.when(F.col("hi") > F.col("lo"), F.floor((F.col("v") - F.col("lo")) / (F.col("hi") - F.col("lo")) * 1024)).otherwise(F.lit(0))
    d = per.crossJoin(F.broadcast(lim)).withColumn("k", bucket)
    off = d.groupBy("k").agg(F.sum("b").alias("kb")).select(F.col("k").alias("__k"), (F.sum("kb").over(W.orderBy("k")) - F.col("kb")).alias("ob"))
    below = F.col("ob") + F.sum("b").over(W.partitionBy("k").orderBy("v").rowsBetween(W.unboundedPreceding, 0)) - F.col("b")
    s = d.join(F.broadcast(off), F.col("k") == F.col("__k")).select("a", "b", below.alias("below"))
    return s.agg(F.try_divide(F.sum(F.col("a") * (F.col("below") + F.col("b") / 2)), F.sum("a").cast("double") * F.sum("b")).alias("auc"))


def leaderboard(metrics: DataFrame, by: str, ascending: bool = True) -> DataFrame:
    """Models in the order of a metric, with their rank; one row per model, so a handful."""
    o = F.col(by).asc_nulls_last() if ascending else F.col(by).desc_nulls_last()
    return metrics.withColumn("rank", F.row_number().over(W.orderBy(o, *[c for c in metrics.columns if c != by])))


def best(metrics: DataFrame, by: str, name: str, ascending: bool = False) -> DataFrame:
    """(name, value) of the best run."""
    pick = F.min_by if ascending else F.max_by
    return metrics.agg(pick(name, by).alias(name), (F.min if ascending else F.max)(by).alias(by))


def passes_gate(metrics: dict[str, float], limits: dict[str, float]) -> bool:
    """Every named metric is there and at least its limit."""
    return all(k in metrics and metrics[k] >= v for k, v in limits.items())


def promote(champion: float | None, challenger: float) -> bool:
    """Strictly better than the champion, or the first."""
    return champion is None or challenger > champion
