"""Factor evaluation: rank correlation, buckets, layered returns, turnover, correlation between factors."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.crosssection import decile
from loomspan.functions.numeric import average_rank, fdiv, fin

KERNEL_MIN, SERIES_MIN, PAIR_MIN = 2, 3, 30


def valid(df: DataFrame, signal: str, label: str) -> DataFrame:
    return df.withColumn("_s", fin(F.col(signal))).withColumn("_f", fin(F.col(label))).where("_s is not null and _f is not null")


def ic_series(df: DataFrame, signal: str = "signal", label: str = "forward_return_5d", date: str = "date", least: int = SERIES_MIN) -> DataFrame:
    """Rank and Pearson correlation of signal and label per date with at least `least` names."""
    d = valid(df, signal, label)
    keys = [F.col(date)]
    d = d.withColumn("_rs", average_rank(F.col("_s"), keys)).withColumn("_rf", average_rank(F.col("_f"), keys))
    g = d.groupBy(date).agg(F.count(F.lit(1)).alias("n"), F.corr("_rs", "_rf").alias("rank_ic"), F.corr("_s", "_f").alias("ic"))
    return g.where(F.col("n") >= least).withColumns({c: fin(F.col(c)) for c in ("rank_ic", "ic")})


def ic_summary(ic: DataFrame, recent: int = 26, date: str = "date") -> DataFrame:
    """mean, std, ir, t of the rank IC, of its latest `recent` dates too, and the share of positive dates."""
    w = Window.orderBy(F.col(date).desc())  # one row a date
    d = ic.where("rank_ic is not null").withColumn("_k", F.row_number().over(w))
    late = F.when(F.col("_k") <= recent, F.col("rank_ic"))
    g = d.agg(F.count(F.lit(1)).alias("n_dates"), F.avg("rank_ic").alias("ic_mean"), F.stddev_samp("rank_ic").alias("ic_std"), F.avg(late).alias("ic_recent"), F.avg((F.col("rank_ic") > 0).cast("double")).alias("positive_share"))
    return g.withColumn("ic_ir", fin(fdiv(F.col("ic_mean"), F.col("ic_std")))).withColumn("ic_t", F.col("ic_ir") * F.sqrt("n_dates"))


def newey_west_t(x: Sequence[float], lags: int | None = None) -> float:
    """t of the mean with Bartlett weights; lags default to 4 (n / 100)^(2/9). NaN below two values."""
    v = np.asarray([a for a in x if a is not None and math.isfinite(a)], float)
    n = len(v)
    if n < 2:
        return math.nan
    lags = int(4 * (n / 100) ** (2 / 9)) if lags is None else lags
    e = v - v.mean()
    s = e @ e / n
    for k in range(1, min(lags, n - 1) + 1):
        s += 2 * (1 - k / (lags + 1)) * (e[k:] @ e[:-k]) / n
    return float(v.mean() / math.sqrt(s / n)) if s > 0 else math.nan


def ic_decay(df: DataFrame, signal: str = "signal", horizons: Sequence[int] = (1, 5, 10, 20), date: str = "date") -> DataFrame:
    """Mean, std and count of the rank IC per horizon, from columns forward_return_<h>d."""
    out = None
    for h in horizons:
        s = ic_series(df, signal, f"forward_return_{h}d", date).agg(F.lit(h).alias("horizon"), F.avg("rank_ic").alias("ic_mean"), F.stddev_samp("rank_ic").alias("ic_std"), F.count("rank_ic").alias("n_dates"))
        out = s if out is None else out.unionByName(s)
    return out


def bucket_returns(df: DataFrame, signal: str = "signal", label: str = "forward_return_5d", groups: int = 10, date: str = "date", weight: str | None = None) -> DataFrame:
    """Mean (or weighted mean) label and size of each bucket of each date."""
    d = valid(df, signal, label)
    d = d.withColumn("bucket", decile(F.col("_s"), [F.col(date)], groups))
    mean = F.avg("_f") if weight is None else F.sum(F.col("_f") * F.col(weight)) / F.nullif(F.sum(F.when(F.col("_f").isNotNull(), F.col(weight))), F.lit(0.0))
    return d.groupBy(date, "bucket").agg(mean.alias("ret"), F.count(F.lit(1)).alias("n"))


def spread(buckets: DataFrame, groups: int = 10, direction: int = 1, date: str = "date") -> DataFrame:
    """(top - bottom) x direction per date."""
    g = buckets.groupBy(date).agg(F.max(F.when(F.col("bucket") == groups - 1, F.col("ret"))).alias("_t"), F.max(F.when(F.col("bucket") == 0, F.col("ret"))).alias("_b"))
    return g.select(date, ((F.col("_t") - F.col("_b")) * direction).alias("spread"))


def monotonicity(buckets: DataFrame) -> DataFrame:
    """Rank correlation of bucket number and mean return."""
    m = buckets.groupBy("bucket").agg(F.avg("ret").alias("m")).withColumn("_g", F.lit(1))
    m = m.withColumn("_r", average_rank(F.col("m"), [F.col("_g")])).withColumn("_b", average_rank(F.col("bucket").cast("double"), [F.col("_g")]))
    return m.agg(F.corr("_r", "_b").alias("monotonic"))


def bucket_turnover(df: DataFrame, signal: str = "signal", groups: int = 10, period: str = "week", date: str = "date", code: str = "code") -> DataFrame:
    """Share of codes whose last bucket of a period differs from that of the period before."""
    d = df.withColumn("_s", fin(F.col(signal))).where("_s is not null")
    d = d.withColumn("_b", decile(F.col("_s"), [F.col(date)], groups)).withColumn("_p", F.date_trunc(period, date))
    last = d.groupBy(code, "_p").agg(F.max_by("_b", date).alias("_b"))
    # a period's number is its place among the periods there are
    idx = last.select("_p").distinct().withColumn("_i", F.row_number().over(Window.orderBy("_p")))
    last = last.join(F.broadcast(idx), "_p")
    w = Window.partitionBy(code).orderBy("_i")
    prev = F.when(F.lag("_i").over(w) == F.col("_i") - 1, F.lag("_b").over(w))
    return last.withColumn("_prev", prev).where("_prev is not null").groupBy(F.col("_p").cast("date").alias("period")).agg(F.avg((F.col("_b") != F.col("_prev")).cast("double")).alias("turnover"), F.count(F.lit(1)).alias("n"))


def layered(df: DataFrame, signal: str = "signal", label: str = "forward_return_5d", groups: int = 5, cost: float = 0.0, date: str = "date", code: str = "code") -> DataFrame:
    """Equal-weight groups by signal: (date, bucket, ret, turnover, net, nav).

    turnover: half the sum of absolute changes of weights from the date before; the first date's is 1. nav compounds net returns.
    """
    d = valid(df, signal, label).withColumn("bucket", decile(F.col("_s"), [F.col(date)], groups))
    d = d.withColumn("_w", 1.0 / F.count(F.lit(1)).over(Window.partitionBy(date, "bucket")))
    days = d.select(date).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))
    d = d.join(F.broadcast(days), date)
    own = d.select("bucket", code, "_i", F.col("_w").alias("_now"), F.lit(0.0).alias("_before"))
    next_ = d.select("bucket", code, (F.col("_i") + 1).alias("_i"), F.lit(0.0).alias("_now"), F.col("_w").alias("_before"))
    moved = own.unionByName(next_).groupBy("bucket", code, "_i").agg(F.abs(F.sum("_now") - F.sum("_before")).alias("_ch")).groupBy("bucket", "_i").agg(F.sum("_ch").alias("_ch"))
    ret = d.groupBy(date, "bucket", "_i").agg(F.avg("_f").alias("ret"))
    out = ret.join(moved, ["bucket", "_i"]).withColumn("turnover", F.when(F.col("_i") == 1, 1.0).otherwise(F.col("_ch") / 2))
    out = out.withColumn("net", F.col("ret") - F.col("turnover") * cost)
    w = Window.partitionBy("bucket").orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    return out.withColumn("nav", F.product(1 + F.col("net")).over(w)).select(date, "bucket", "ret", "turnover", "net", "nav")


def nav_summary(nav: DataFrame, by: Sequence[str] = ("bucket",), date: str = "date", per_year: float = 252.0) -> DataFrame:
    """Total and annual return, volatility, Sharpe ratio, greatest drawdown, hit rate."""
    w = Window.partitionBy(*by).orderBy(date).rowsBetween(Window.unboundedPreceding, 0)
    d = nav.withColumn("_dd", F.col("nav") / F.greatest(F.max("nav").over(w), F.lit(1.0)) - 1)
    g = d.groupBy(*by).agg(F.max_by("nav", date).alias("nav"), F.count(F.lit(1)).alias("n"), F.avg("net").alias("_m"), F.stddev_samp("net").alias("_s"), F.min("_dd").alias("max_drawdown"), F.avg((F.col("net") > 0).cast("double")).alias("hit_rate"))
    return g.select(*by, (F.col("nav") - 1).alias("total_return"), (F.pow("nav", F.lit(per_year) / F.col("n")) - 1).alias("annual_return"), (F.col("_s") * math.sqrt(per_year)).alias("volatility"), (fin(fdiv(F.col("_m"), F.col("_s"))) * math.sqrt(per_year)).alias("sharpe"), "max_drawdown", "hit_rate")


def coverage(df: DataFrame, signal: str = "signal", date: str = "date", dead: float = 0.99) -> DataFrame:
    """Rows, valid rows, invalid share and whether the signal is dead, per date."""
    g = df.groupBy(date).agg(F.count(F.lit(1)).alias("n"), F.count(fin(F.col(signal))).alias("n_valid"))
    return g.withColumn("invalid_share", 1 - F.col("n_valid") / F.col("n")).withColumn("dead", F.col("invalid_share") >= dead)


def factor_correlation(wide: DataFrame, factors: Sequence[str], date: str = "date", least: int = PAIR_MIN) -> DataFrame:
    """Mean per-date rank and Pearson correlation of each pair of factors, dates with more than `least` common names."""
    out = None
    for i, a in enumerate(factors):
        for b in factors[i + 1 :]:
            s = ic_series(wide, a, b, date, least + 1).agg(F.lit(a).alias("a"), F.lit(b).alias("b"), F.avg("rank_ic").alias("rank_corr"), F.avg("ic").alias("corr"), F.count(F.lit(1)).alias("n_dates"))
            out = s if out is None else out.unionByName(s)
    return out


def factor_svd(wide: DataFrame, factors: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
    """Singular values and vectors of the factors' correlation matrix, from one pass of moment sums."""
    fs = [fin(F.col(f)) for f in factors]
    ok = fs[0].isNotNull()
    for f in fs[1:]:
        ok = ok & f.isNotNull()
    sums = wide.where(ok).agg(*[F.corr(fs[i], fs[j]).alias(f"c{i}_{j}") for i in range(len(fs)) for j in range(i)]).first()
    c = np.eye(len(fs))
    for i in range(len(fs)):
        for j in range(i):
            c[i, j] = c[j, i] = sums[f"c{i}_{j}"]
    u, s, _ = np.linalg.svd(c)
    return s, u


def residual_ic(df: DataFrame, signal: str, others: Sequence[str], label: str, date: str = "date") -> DataFrame:
    """Rank IC of the signal and of its residual on other factors, per date, and the R2 of that regression."""
    from loomspan.functions.crosssection import Section, residual

    xs = [fin(F.col(o)) for o in others]
    d = df.withColumn("_y", fin(F.col(signal))).withColumn("_r", residual(Section(F.col(date)), fin(F.col(signal)), xs))
    r2 = d.where("_r is not null").groupBy(date).agg((1 - F.var_pop("_r") / F.nullif(F.var_pop("_y"), F.lit(0.0))).alias("r2"))
    raw = ic_series(d, signal, label, date).select(date, F.col("rank_ic").alias("raw_ic"))
    res = ic_series(d, "_r", label, date).select(date, F.col("rank_ic").alias("residual_ic"))
    return raw.join(res, date).join(r2, date)


def composite(members: dict[str, DataFrame], weights: dict[str, float] | None = None, rank: bool = False, date: str = "date", code: str = "code") -> DataFrame:
    """Weighted mean of member signals, raw or as per-date ranks, over the keys that all members share."""
    out = None
    for name, m in members.items():
        x = fin(F.col("signal"))
        m = m.select(date, code, (average_rank(x, [F.col(date)]) / F.count(x).over(Window.partitionBy(date)) if rank else x).alias(name)).where(F.col(name).isNotNull())
        out = m if out is None else out.join(m, [date, code])
    w = weights or {n: 1.0 for n in members}
    total = sum(w.values())
    expr = None
    for n in members:
        t = F.col(f"`{n}`") * (w[n] / total)
        expr = t if expr is None else expr + t
    return out.select(date, code, expr.alias("signal"))


def composite_apply(members: dict[str, DataFrame], compute: Callable[[pd.DataFrame, dict], Sequence[float]], params: dict | None = None, date: str = "date", code: str = "code") -> DataFrame:
    """A composite by a user's own function: compute(X, params) -> one value a row, for each date's cross-section.

    X: the members' signals by name, over the keys that all share, indexed by code in order; non-finite signals are NaN. A result
    of another length is an error; non-finite results are null. One date is one task's work: a cross-section is as long as there are codes.
    """
    wide = None
    for name, m in members.items():
        m = m.select(date, F.col(code).cast("string").alias(code), fin(F.col("signal")).alias(name))
        wide = m if wide is None else wide.join(m, [date, code])
    names, kw = list(members), dict(params or {})

    def one(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(code)
        got = np.asarray(compute(g.set_index(code)[names].astype(float), kw), float)
        if got.shape != (len(g),):
            raise ValueError(f"compute gave {got.shape} for {len(g)} rows")
        return pd.DataFrame({date: g[date].to_numpy(), code: g[code].to_numpy(), "signal": np.where(np.isfinite(got), got, np.nan)})

    out = wide.groupBy(date).applyInPandas(one, f"`{date}` {dict(wide.dtypes)[date]}, `{code}` string, signal double")
    return out.withColumn("signal", fin(F.col("signal")))


def composite_report(composite_signal: DataFrame, members: dict[str, DataFrame], labels: DataFrame, label: str, date: str = "date", code: str = "code") -> DataFrame:
    """(name, ic_mean, ic_ir, n_dates, lift_best, lift_equal) of the composite, each member and the equal-weight mean of their ranks.

    lift_best and lift_equal: mean rank IC less that of the best member (by absolute mean) and of the equal-weight mean.
    """
    frames = {"composite": composite_signal, "equal": composite(members, rank=True, date=date, code=code), **members}
    out = None
    for name, f in frames.items():
        ic = ic_series(f.select(date, code, "signal").join(labels.select(date, code, label), [date, code]), "signal", label, date)
        g = ic.agg(F.lit(name).alias("name"), F.avg("rank_ic").alias("ic_mean"), fin(fdiv(F.avg("rank_ic"), F.stddev_samp("rank_ic"))).alias("ic_ir"), F.count("rank_ic").alias("n_dates"))
        out = g if out is None else out.unionByName(g)
    best = F.max_by(F.when(~F.col("name").isin("composite", "equal"), F.col("ic_mean")), F.when(~F.col("name").isin("composite", "equal"), F.abs("ic_mean"))).over(Window.partitionBy(F.lit(1)))
    equal = F.max(F.when(F.col("name") == "equal", F.col("ic_mean"))).over(Window.partitionBy(F.lit(1)))
    return out.select("*", (F.col("ic_mean") - best).alias("lift_best"), (F.col("ic_mean") - equal).alias("lift_equal"))
