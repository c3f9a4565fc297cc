"""Score models: per-date normalisation, feature expansion and filters, walk-forward linear models."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.functions.crosssection import Section
from loomspan.functions.numeric import fin


def robust_z(df: DataFrame, cols: Sequence[str], date: str = "date", group: str | None = None, clip: float = 3.0) -> DataFrame:
    """Each column as (x - median) / (1.4826 MAD) of its date (and group), clipped; 0 where missing or constant."""
    s = Section(F.col(date), *([F.col(group)] if group else []))
    dev = df.withColumns({f"_d_{c}": fin(F.col(c)) - s.q(fin(F.col(c)), 0.5) for c in cols})
    out = {}
    for c in cols:
        d = F.col(f"_d_{c}")
        mad = s.q(F.abs(d), 0.5) * 1.4826
        out[c] = F.coalesce(F.greatest(F.least(F.when(mad > 0, d / mad), F.lit(clip)), F.lit(-clip)), F.lit(0.0))
    return dev.withColumns(out).drop(*[f"_d_{c}" for c in cols])


def expand(df: DataFrame, cols: Sequence[str], squares: bool = True, products: bool = True, logs: bool = False) -> tuple[DataFrame, list[str]]:
    """Adds squares, pairwise products and signed logs; returns the frame and all feature names."""
    new = {}
    if squares:
        new |= {f"{c}__sq": F.col(c) * F.col(c) for c in cols}
    if products:
        new |= {f"{a}__x__{b}": F.col(a) * F.col(b) for i, a in enumerate(cols) for b in cols[i + 1 :]}
    if logs:
        new |= {f"{c}__log": F.signum(c) * F.log1p(F.abs(c)) for c in cols}
    return df.withColumns(new), [*cols, *new]


def moment_sums(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str]) -> DataFrame:
    """Per group n, X'X, X'y, sums: all that linear models need, combined map-side; one array a group."""
    z = [F.lit(1.0), *[F.coalesce(fin(F.col(f)), F.lit(0.0)) for f in features], fin(F.col(label))]
    pairs = [F.sum(z[i] * z[j]) for i in range(len(z)) for j in range(i, len(z))]
    return df.where(fin(F.col(label)).isNotNull()).groupBy(*by).agg(F.array(*pairs).alias("m"))


def gram(m: Sequence[float], k: int) -> np.ndarray:
    """The symmetric matrix of moment_sums."""
    g = np.zeros((k, k))
    g[np.triu_indices(k)] = m
    return g + np.triu(g, 1).T


def ridge(g: np.ndarray, alpha: float = 1.0) -> np.ndarray:
    """Weights (intercept first) from the Gram matrix of (1, x, y)."""
    k = len(g) - 1
    p = alpha * np.eye(k)
    p[0, 0] = 0
    return np.linalg.solve(g[:k, :k] + p + 1e-12 * np.eye(k), g[:k, k])


def elastic_net(g: np.ndarray, alpha: float = 0.01, l1: float = 0.5, rounds: int = 500) -> np.ndarray:
    """Coordinate descent on the Gram matrix."""
    k = len(g) - 1
    n = g[0, 0]
    a, b = g[:k, :k] / n, g[:k, k] / n
    w = np.zeros(k)
    for _ in range(rounds):
        old = w.copy()
        for j in range(k):
            r = b[j] - a[j] @ w + a[j, j] * w[j]
            w[j] = r / a[j, j] if j == 0 else np.sign(r) * max(abs(r) - alpha * l1, 0) / (a[j, j] + alpha * (1 - l1)) if a[j, j] > 0 else 0.0
        if np.abs(w - old).max() < 1e-10:
            break
    return w


def pls(g: np.ndarray, parts: int = 2) -> np.ndarray:
    """Partial least squares of one label, from the centred Gram matrix (Krylov form)."""
    k = len(g) - 1
    n = g[0, 0]
    mean = g[0, 1:k] / n
    c = g[1:k, 1:k] - n * np.outer(mean, mean)
    s = g[1:k, k] - mean * g[0, k]
    basis = [s]
    for _ in range(parts - 1):
        basis.append(c @ basis[-1])
    q = np.linalg.qr(np.column_stack(basis))[0]
    w = q @ np.linalg.lstsq(q.T @ c @ q, q.T @ s, rcond=None)[0]
    return np.r_[g[0, k] / n - mean @ w, w]


MODELS = {"ridge": ridge, "elastic_net": elastic_net, "pls": pls}


def feature_filter(df: DataFrame, features: Sequence[str], label: str, least: float = 0.01, alike: float = 0.95) -> list[str]:
    """Features that correlate with the label by at least `least` and with no better one by more than `alike`."""
    g = gram(moment_sums(df, features, label, []).first()["m"], len(features) + 2)
    n = g[0, 0]
    c = g[1:, 1:] - np.outer(g[0, 1:], g[0, 1:]) / n
    sd = np.sqrt(np.maximum(np.diag(c), 1e-300))
    r = c / np.outer(sd, sd)
    keep: list[int] = []
    for j in sorted(range(len(features)), key=lambda j: -abs(r[j, -1])):
        if abs(r[j, -1]) >= least and c[j, j] > 1e-12 and all(abs(r[j, i]) <= alike for i in keep):
            keep.append(j)
    return [features[j] for j in sorted(keep)]


def walk_forward(df: DataFrame, features: Sequence[str], label: str, period: str = "quarter", train: int = 4, gap_days: int = 0, model: str = "ridge", date: str = "date", code: str = "code", **params) -> DataFrame:
    """Signal of each period from a model trained on the `train` periods before it: (date, code, signal).

    Moment sums per period are computed once and added up per fold, so the data are read
    once to train all folds; labels within `gap_days` of a period's end are left out, as they reach into the next.
    """
    d = df.withColumn("_p", F.date_trunc(period, date))
    end = F.add_months(F.col("_p"), {"month": 1, "quarter": 3, "year": 12}[period])
    sums = moment_sums(d.where(F.datediff(end, F.col(date)) > gap_days), features, label, ["_p"])
    # one small matrix a period
    got = sorted((r["_p"], gram(r["m"], len(features) + 2)) for r in sums.collect())
    periods = [r["_p"] for r in d.select("_p").distinct().orderBy("_p").collect()]
    by = dict(got)
    folds = []
    for i, p in enumerate(periods):
        past = [by[q] for q in periods[max(0, i - train) : i] if q in by]
        if len(past) == train:
            g = sum(past[1:], past[0])
            folds.append((p, [float(x) for x in MODELS[model](g, **params)]))
    if not folds:
        return d.select(date, code, F.lit(0.0).alias("signal")).limit(0)
    w = df.sparkSession.createDataFrame(folds, "_p timestamp, _w array<double>")
    x = F.array(F.lit(1.0), *[F.coalesce(fin(F.col(f)), F.lit(0.0)) for f in features])
    score = F.aggregate(F.zip_with(x, F.col("_w"), lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)
    return d.join(F.broadcast(w), "_p").select(date, code, score.alias("signal"))


def huber(df: DataFrame, features: Sequence[str], label: str, by: str, delta: float = 1.35, alpha: float = 1.0, rounds: int = 5) -> DataFrame:
    """Huber ridge weights per group by iterated reweighting: (by, w). Each round is one pass of weighted moment sums."""
    k = len(features) + 1
    x = [F.lit(1.0), *[F.coalesce(fin(F.col(f)), F.lit(0.0)) for f in features]]
    y = fin(F.col(label))
    d = df.where(y.isNotNull()).withColumn("_x", F.array(*x)).withColumn("_y", y)
    spark, groups = df.sparkSession, dict(df.select(by).dtypes)[by]
    w: DataFrame | None = None
    for _ in range(rounds):
        if w is None:
            e = d.withColumn("_h", F.lit(1.0))
        else:
            j = d.join(w, by)
            res = F.abs(F.col("_y") - F.aggregate(F.zip_with("_x", "w", lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v))
            j = j.withColumn("_r", res)
            scale = j.groupBy(by).agg((1.4826 * F.percentile_approx("_r", F.lit(0.5), 1000)).alias("_s"))
            e = j.join(scale, by).withColumn("_h", F.when(F.col("_r") <= delta * F.col("_s"), 1.0).otherwise(delta * F.col("_s") / F.col("_r"))).drop("w")
        z = [F.col("_x")[i] for i in range(k)] + [F.col("_y")]
        sums = e.groupBy(by).agg(F.array(*[F.sum(F.col("_h") * z[i] * z[j]) for i in range(k + 1) for j in range(i, k + 1)]).alias("m")).collect()
        w = spark.createDataFrame([(r[by], [float(v) for v in ridge(gram(r["m"], k + 1), alpha)]) for r in sums], f"{by} {groups}, w array<double>")
    return w


def screen_features(df: DataFrame, code: str = "code", date: str = "date", n: int = 120) -> DataFrame:
    """Per code features of its last n rows: returns over 5/20/60, volatility, drawdown, volume trend, up share, range position."""

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values("d")
        c, v = g["c"].to_numpy(float), g["v"].to_numpy(float)
        ret = np.diff(np.log(c)) if len(c) > 1 else np.zeros(0)
        back = lambda k: c[-1] / c[-1 - k] - 1 if len(c) > k else np.nan
        peak = np.maximum.accumulate(c)
        return pd.DataFrame([(g["k"].iloc[0], back(5), back(20), back(60), ret.std(ddof=1) if len(ret) > 1 else np.nan, (c / peak - 1).min(), v[-5:].mean() / v.mean() if v.mean() > 0 else np.nan, (ret > 0).mean() if len(ret) else np.nan, (c[-1] - c.min()) / (c.max() - c.min()) if c.max() > c.min() else 0.5)], columns=["k", "r5", "r20", "r60", "vol", "dd", "vtrend", "up", "pos"])

    from pyspark.sql import Window

    w = Window.partitionBy(code).orderBy(F.col(date).desc())
    d = df.where("close > 0").withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    d = d.select(F.col(code).cast("string").alias("k"), F.col(date).alias("d"), F.col("close").alias("c"), F.coalesce("volume", F.lit(0.0)).alias("v"))
    return d.groupBy("k").applyInPandas(one, "k string, r5 double, r20 double, r60 double, vol double, dd double, vtrend double, up double, pos double").withColumnRenamed("k", code)


def score_rank(df: DataFrame, weights: dict[str, float], code: str = "code", top: int = 300) -> DataFrame:
    """Weighted sum of percentage ranks, the best `top` codes."""
    from loomspan.functions.numeric import average_rank

    g = df.withColumn("_g", F.lit(1))
    terms = [w * F.coalesce(average_rank(fin(F.col(c)), [F.col("_g")]) / F.nullif(F.sum(F.when(fin(F.col(c)).isNotNull(), 1)).over(_all()), F.lit(0)), F.lit(0.0)) for c, w in weights.items()]
    out = terms[0]
    for t in terms[1:]:
        out = out + t
    return g.withColumn("score", out).drop("_g").orderBy(F.desc("score"), code).limit(top)


def _all():
    from pyspark.sql import Window

    return Window.partitionBy("_g")
