"""Distribution changes between consecutive loads by a classifier two-sample test.

For each load and the one before it a logistic regression is trained to tell their rows apart. Every column enters as
one-hot bins, so a load is exactly described by the counts of its bin combinations: rows are reduced to these cells with
map-side combine, and the models of all pairs are trained in parallel on cells, whose number is bounded by the bins, not by
the rows. Discrimination (AUC) is cross-fitted over two folds.

Ablation tells which column carries a change. Leaving one column out asks whether it is needed; leaving out all others gives
a model of one column, which has fine bins of its own. Its maximum-likelihood fit is known in closed form (the log odds of
each bin) and tells the loads apart at all if and only if the shares of some bin differ, which is asked of whole numbers. So
a pair is passed over only if every bin holds the same share of both loads: then their medians lie in the same bins, and
bins narrower than the change looked for make that change impossible. Nothing is lost to a threshold of the AUC.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def fit(cols: list[np.ndarray], sizes: list[int], n1: np.ndarray, n0: np.ndarray, l2: float = 1.0, steps: int = 8) -> np.ndarray:
    """Coefficients (intercept first) of a logistic regression on one-hot columns; ``n1`` and ``n0`` count both labels per cell."""
    at = np.cumsum([1, *sizes])
    total = int(at[-1])
    b, n = np.zeros(total), n1 + n0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(_score(b, cols, sizes), -30, 30)))
        r, w = n1 - n * p, n * p * (1 - p)
        g, h = np.zeros(total), np.zeros((total, total))
        g[0], h[0, 0] = r.sum(), w.sum() + 1e-6
        for i, (c, k) in enumerate(zip(cols, sizes)):
            own = slice(at[i], at[i] + k)
            g[own] = np.bincount(c, r, k) - l2 * b[own]
            d = np.bincount(c, w, k)
            h[0, own] = h[own, 0] = d
            h[own, own] = np.diag(d + l2)
            for j in range(i):
                x = np.bincount(c * sizes[j] + cols[j], w, k * sizes[j]).reshape(k, sizes[j])
                other = slice(at[j], at[j] + sizes[j])
                h[own, other], h[other, own] = x, x.T
        step = np.linalg.solve(h, g)
        b += step
        if np.abs(step).max() < 1e-3:
            break
    return b


def _score(b: np.ndarray, cols: list[np.ndarray], sizes: list[int]) -> np.ndarray:
    s, at = np.full(len(cols[0]) if cols else 0, b[0]), 1
    for c, k in zip(cols, sizes):
        s = s + b[at + c]
        at += k
    return s


def auc(score: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> float:
    """Area under the ROC curve of weighted cells; ties count half. NaN if a label is missing."""
    t1, t0 = n1.sum(), n0.sum()
    if not t1 or not t0:
        return float("nan")
    _, g = np.unique(np.round(score, 9), return_inverse=True)
    a, b = np.bincount(g, n1), np.bincount(g, n0)
    return float((a * (np.cumsum(b) - b / 2)).sum() / (t1 * t0))


def _cells(codes: np.ndarray, sizes: list[int]) -> tuple[np.ndarray, list[np.ndarray]]:
    fold, rest, cols = codes & 1, codes >> 1, []
    for k in sizes:
        cols.append(rest % k)
        rest = rest // k
    return fold, cols


def compare(codes1: np.ndarray, n1: np.ndarray, codes0: np.ndarray, n0: np.ndarray, sizes: list[int]) -> tuple[float, list[float], list[float]]:
    """Cross-fitted AUC of all columns, without each, with each alone."""
    codes, inv = np.unique(np.concatenate([codes1, codes0]), return_inverse=True)
    a = np.bincount(inv[: len(codes1)], n1, len(codes))
    b = np.bincount(inv[len(codes1) :], n0, len(codes))
    fold, cols = _cells(codes, sizes)
    k = len(sizes)

    def crossed(use: list[int]) -> float:
        got = []
        for f in (0, 1):
            tr, te = fold != f, fold == f
            if not use or not tr.any() or not te.any():
                return float("nan")
            s = [sizes[i] for i in use]
            coef = fit([cols[i][tr] for i in use], s, a[tr], b[tr])
            got.append(auc(_score(coef, [cols[i][te] for i in use], s), a[te], b[te]))
        return float(np.mean(got))

    return crossed([*range(k)]), [crossed([j for j in range(k) if j != i]) for i in range(k)], [crossed([i]) for i in range(k)]


def one_column(codes1: np.ndarray, n1: np.ndarray, codes0: np.ndarray, n0: np.ndarray) -> tuple[float, bool]:
    """Cross-fitted AUC of the model of one column, codes being 2 * bin + fold, and whether the model fitted to all rows
    discriminates at all: do the shares of any bin differ, in exact arithmetic."""
    codes, inv = np.unique(np.concatenate([codes1, codes0]), return_inverse=True)
    a = np.bincount(inv[: len(codes1)], n1, len(codes))
    b = np.bincount(inv[len(codes1) :], n0, len(codes))
    bins, at = np.unique(codes >> 1, return_inverse=True)
    whole = [[int(x) for x in np.bincount(at, n, len(bins))] for n in (a, b)]
    t1, t0 = sum(whole[0]), sum(whole[1])
    differs = any(x * t0 != y * t1 for x, y in zip(*whole))
    got = []
    for f in (0, 1):
        tr, te = (codes & 1) != f, (codes & 1) == f
        p, q = np.bincount(at[tr], a[tr], len(bins)), np.bincount(at[tr], b[tr], len(bins))
        score = np.log((p + 0.5) / (q + 0.5))[at[te]]  # half a row each way: bins not seen in training say nothing
        got.append(auc(score, a[te], b[te]))
    return float(np.mean(got)), differs


def _middle(bins: np.ndarray, n: np.ndarray) -> tuple[int, int, int, int]:
    """Number of values, the bins of their two middle ones, and the values in the bins before the first of these. Bins in any
    order, with repeats."""
    total = int(n.sum())
    if not total:
        return 0, 0, 0, 0
    own, at = np.unique(bins, return_inverse=True)
    per = np.bincount(at, n, len(own)).astype(np.int64)
    cum = np.cumsum(per)
    lo, hi = (int(np.searchsorted(cum, r, side="right")) for r in ((total - 1) // 2, total // 2))
    return total, int(own[lo]), int(own[hi]), int(cum[lo] - per[lo])


def load_tests(rows: DataFrame, load: str, system: str, bins: dict[str, tuple[Column, int]], fold: Column, fine: dict[str, Column]) -> DataFrame:
    """One row per load: system, prev (the load before it in the system, or null), rows, auc; per column of ``bins``
    ``auc_only_<c>`` and ``auc_drop_<c>``; per column of ``fine`` ``differs_<c>`` and ``n_<c>``, ``lo_<c>``, ``hi_<c>``,
    ``before_<c>`` (count and place of the middle values).

    ``bins``: column -> (bin number, number of bins), for the model of all columns. ``fine``: column -> bin of its values in
    rising order, null for what is no value, for the model of this column alone; other columns use ``bins`` there too.
    ``fold``: 0 or 1. Rows without load are left out; an empty table gives no rows; a load without one before it, or with
    rows in one fold only, has null AUCs; ``differs_<c>`` is null without a load before.
    """
    names, narrow = list(bins), list(fine)
    sizes = [bins[c][1] for c in names]
    code, unit = fold.cast("long"), 2
    for c in names:
        code, unit = code + bins[c][0].cast("long") * unit, unit * bins[c][1]
    # one pass: a row counts in its cell and in its bin of each single column
    kinds = [F.struct(F.lit(-1).alias("kind"), code.alias("code"))]
    kinds += [F.struct(F.lit(i).alias("kind"), (fine[c].cast("long") * 2 + fold.cast("long")).alias("code")) for i, c in enumerate(narrow)]
    cells = rows.where(F.col(load).isNotNull()).select(F.col(load).alias("load"), F.col(system).alias("system"), F.inline(F.array(*kinds)))
    cells = cells.where("code IS NOT NULL").groupBy("load", "kind", "code").agg(F.count(F.lit(1)).alias("n"), F.min("system").alias("system"))
    packed = cells.groupBy("load").agg(F.min("system").alias("system"), F.collect_list("kind").alias("kinds"), F.collect_list("code").alias("codes"), F.collect_list("n").alias("ns"))
    run = W.partitionBy("system").orderBy("load")
    pairs = packed.select("load", "system", "kinds", "codes", "ns", *(F.lag(c).over(run).alias(f"p_{c}") for c in ("load", "kinds", "codes", "ns")))
    per = [f"auc_only_{c} double, auc_drop_{c} double" for c in names] + [f"differs_{c} boolean, n_{c} long, lo_{c} long, hi_{c} long, before_{c} long" for c in narrow]
    schema = f"load {dict(cells.dtypes)['load']}, system {dict(cells.dtypes)['system']}, prev {dict(cells.dtypes)['load']}, rows long, auc double, " + ", ".join(per)

    def run_batch(it: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in it:
            out = []
            for r in pdf.itertuples(index=False):
                now, before = (_by_kind(*x, len(narrow)) for x in ((r.kinds, r.codes, r.ns), (r.p_kinds, r.p_codes, r.p_ns)))
                full, drop, only, differs = float("nan"), [float("nan")] * len(names), [float("nan")] * len(names), [None] * len(narrow)
                if before is not None:
                    full, drop, only = compare(*now[-1], *before[-1], sizes)
                    for i, c in enumerate(narrow):
                        only[names.index(c)], differs[i] = one_column(*now[i], *before[i])
                row = [r.load, r.system, r.p_load, int(now[-1][1].sum()), full]
                for i in range(len(names)):
                    row += [only[i], drop[i]]
                for i in range(len(narrow)):
                    row += [differs[i], *_middle(now[i][0] >> 1, now[i][1])]
                out.append(row)
            frame = pd.DataFrame(out, columns=[f.split()[0] for f in schema.split(", ")])
            frame["prev"] = frame["prev"].astype("Int64") if pd.api.types.is_numeric_dtype(frame["load"]) else frame["prev"]
            floats = frame.select_dtypes("float").columns
            frame[floats] = frame[floats].astype(object).where(frame[floats].notna(), None)
            yield frame

    # a row is a whole model: spread them by number, small as they are in bytes
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return pairs.repartition(parts, "load").mapInPandas(run_batch, schema)


def _by_kind(kinds, codes, ns, columns: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
    """(codes, counts) of each single column, and last of the cells of all; None without a load."""
    if kinds is None:
        return None
    kinds, codes, ns = (np.asarray(x, np.int64) for x in (kinds, codes, ns))
    return [(codes[kinds == i], ns[kinds == i]) for i in [*range(columns), -1]]


def exact_medians(values: DataFrame, tests: DataFrame, columns: list[str]) -> DataFrame:
    """(load, column, twice): twice the exact median of each column's values, from ``values`` (load, column, bin, value).

    ``tests``: of ``load_tests``, or its rows for the loads wanted. Only values of the middle bins are looked at; equal ones
    are counted first, so what is sorted per load is the distinct values of at most two bins.
    """
    long = tests.select("load", F.explode(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"n_{c}").alias("n"), F.col(f"lo_{c}").alias("lo"), F.col(f"hi_{c}").alias("hi"), F.col(f"before_{c}").alias("before")) for c in columns))).alias("m")).select("load", "m.*")
    near = values.join(long, ["load", "column"]).where((F.col("bin") == F.col("lo")) | (F.col("bin") == F.col("hi")))
    per = near.groupBy("load", "column", "value", "n", "before").agg(F.count(F.lit(1)).alias("__c"))
    upto = per.withColumn("__u", F.col("before") + F.sum("__c").over(W.partitionBy("load", "column").orderBy("value").rowsBetween(W.unboundedPreceding, 0)))
    from_ = F.col("__u") - F.col("__c")
    lo, hi = F.floor((F.col("n") - 1) / 2), F.floor(F.col("n") / 2)
    hit = lambda r: F.when((from_ <= r) & (r < F.col("__u")), F.col("value"))
    return upto.select("load", "column", hit(lo).alias("a"), hit(hi).alias("b")).groupBy("load", "column").agg((F.max("a") + F.max("b")).alias("twice"))
