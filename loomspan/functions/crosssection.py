"""Cross-sectional (cs) and grouped (gp) operators: one section is one date, or one (date, key)."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomspan.functions.numeric import average_rank, col, dbl, fdiv, fin
from loomspan.functions.registry import Context, factor_op


def cs(name: str, least: int = 1, most: int | None = -1, masked: tuple[int, ...] = (0,), aliases: tuple[str, ...] = ()):
    return factor_op(name, "cs", least, most, masked=masked, aliases=aliases)


class Section:
    """Aggregates over the rows of a section; observations are finite values.

    hold: keeps a value as a column, so that what names it again does not compute it again.
    """

    def __init__(self, *keys: Column, hold: Callable[[Column], Column] = lambda c: c):
        self.keys = list(keys)
        self.w = Window.partitionBy(*keys)
        self.hold = hold

    def over(self, agg: Column) -> Column:
        return self.hold(agg.over(self.w))

    def mean(self, x: Column) -> Column:
        return self.over(F.avg(x))

    def std(self, x: Column) -> Column:
        return self.over(F.stddev_samp(x))

    def q(self, x: Column, p: float) -> Column:
        return self.over(F.percentile(x, float(p)))

    def zscore(self, x: Column) -> Column:
        x = self.hold(x)
        s = self.std(x)
        return F.when(s > 0, (x - self.mean(x)) / s)

    def clip(self, x: Column, lo: Column, hi: Column) -> Column:
        return F.when(x < lo, lo).when(x > hi, hi).otherwise(x)

    def ols(self, y: Column, x: Column) -> Column:
        """Fitted value of y on x with intercept, over rows where both are present."""
        both = x.isNotNull() & y.isNotNull()
        x2, y2 = F.when(both, x), F.when(both, y)
        slope = self.over(F.covar_samp(y2, x2)) / F.nullif(self.over(F.var_samp(x2)), F.lit(0.0))
        slope = F.coalesce(slope, F.lit(0.0))
        return F.when(both, self.mean(y2) + slope * (x2 - self.mean(x2)))


def sec(ctx: Context) -> Section:
    return Section(*ctx.cs, hold=ctx.hold)


cs("cs_mean")(lambda c, x: sec(c).mean(fin(x)))
cs("cs_demean")(lambda c, x: fin(x) - sec(c).mean(fin(x)))
cs("cs_zscore", 1, 2)(lambda c, x, ddof=1: sec(c).zscore(fin(x)) if int(ddof) == 1 else F.when(F.stddev_pop(fin(x)).over(sec(c).w) > 0, (fin(x) - sec(c).mean(fin(x))) / F.stddev_pop(fin(x)).over(sec(c).w)))
cs("cs_3sigma", 1, 2)(lambda c, x, n=3.0: sec(c).clip(fin(x), sec(c).mean(fin(x)) - float(n) * sec(c).std(fin(x)), sec(c).mean(fin(x)) + float(n) * sec(c).std(fin(x))))
cs("cs_fill_except_all_null", 1, 2)(lambda c, x, v=0.0: F.when(F.count(fin(x)).over(sec(c).w) > 0, F.coalesce(fin(x), dbl(v))))
cs("cs_fill_max")(lambda c, x: F.coalesce(fin(x), F.max(fin(x)).over(sec(c).w)))
cs("cs_fill_min")(lambda c, x: F.coalesce(fin(x), F.min(fin(x)).over(sec(c).w)))
cs("cs_fill_mean")(lambda c, x: F.coalesce(fin(x), sec(c).mean(fin(x))))
cs("cs_fill_null", 1, 2)(lambda c, x, v=0.0: F.coalesce(fin(x), dbl(v)))


def mad_clip(s: Section, x: Column, n: float = 3.0, k: float = 1.4826) -> Column:
    """x within median +- n * k * MAD of its section."""
    x = s.hold(x)
    med = s.q(x, 0.5)
    mad = s.q(F.abs(x - med), 0.5)
    return s.clip(x, med - n * k * mad, med + n * k * mad)


cs("cs_mad", 1, 3)(lambda c, x, n=3.0, k=1.4826: mad_clip(sec(c), fin(x), float(n), float(k)))
cs("cs_mad_zscore")(lambda c, x: sec(c).zscore(mad_clip(sec(c), fin(x))))


def swept(s: Section, y: Column, b: Column) -> Column:
    """y without its part along b; all of it where b has no length."""
    return s.hold(y - F.coalesce(s.over(F.sum(y * b)) / F.nullif(s.over(F.sum(b * b)), F.lit(0.0)), F.lit(0.0)) * b)


def residual(s: Section, y: Column, xs: list[Column]) -> Column:
    """Least-squares residual with intercept on any number of regressors, by successive orthogonalisation:

    each regressor is replaced by its residual on those before it, and y is
    swept by each in turn, so only one-regressor section sums are needed and
    the plan stays in the JVM. Rows with anything missing are left out. A
    regressor that is constant given the others sweeps nothing.
    """
    y, xs = s.hold(y), [s.hold(x) for x in xs]
    present = s.hold(reduce(lambda a, b: a & b, [v.isNotNull() for v in [y, *xs]]))
    y, xs = s.hold(F.when(present, y)), [s.hold(F.when(present, v)) for v in xs]
    basis: list[Column] = []
    for x in xs:
        centred = r = s.hold(x - s.mean(x))
        for b in basis:
            r = swept(s, r, b)
        basis.append(s.hold(F.when(s.over(F.sum(r * r)) > 1e-18 * s.over(F.sum(centred * centred)), r).otherwise(F.when(present, 0.0))))
    out = s.hold(y - s.mean(y))
    for b in basis:
        out = swept(s, out, b)
    return out


def weighted_residual(s: Section, w: Column, y: Column, xs: list[Column]) -> Column:
    """Residual of weighted least squares: the plain one of rows scaled by sqrt(w), intercept included, scaled back."""
    w, y, xs = s.hold(w), s.hold(y), [s.hold(x) for x in xs]
    present = s.hold(reduce(lambda a, b: a & b, [v.isNotNull() for v in [w, y, *xs]]) & (w > 0))
    r = s.hold(F.when(present, F.sqrt(w)))
    basis: list[Column] = []
    for x in [r, *[s.hold(F.when(present, x) * r) for x in xs]]:
        for b in basis:
            x = swept(s, x, b)
        basis.append(x)
    out = s.hold(F.when(present, y) * r)
    for b in basis:
        out = swept(s, out, b)
    return out / r


_f = lambda xs: [fin(x) for x in xs]
cs("cs_resid", 1, None, (0, 1))(lambda c, y, *xs: residual(sec(c), fin(y), _f(xs)))
cs("cs_resid_zscore", 1, None, (0, 1))(lambda c, y, *xs: sec(c).zscore(residual(sec(c), fin(y), _f(xs))))
cs("cs_zscore_resid", 1, None, (0, 1))(lambda c, y, *xs: residual(sec(c), sec(c).zscore(fin(y)), _f(xs)))
cs("cs_mad_zscore_resid", 1, None, (0, 1))(lambda c, y, *xs: residual(sec(c), sec(c).zscore(mad_clip(sec(c), fin(y))), _f(xs)))
cs("cs_mad_zscore_resid_zscore", 1, None, (0,))(lambda c, y, *xs: sec(c).zscore(residual(sec(c), sec(c).zscore(mad_clip(sec(c), fin(y))), _f(xs))))
cs("cs_resid_w", 2, None, (0, 1))(lambda c, w, y, *xs: weighted_residual(sec(c), fin(w), fin(y), _f(xs)))
cs("cs_regression_neut", 2, 2, (0, 1), ("cs_regression_resid",))(lambda c, y, x: fin(y) - sec(c).ols(fin(y), fin(x)))
cs("cs_regression_proj", 2, 2, (0, 1))(lambda c, y, x: sec(c).ols(fin(y), fin(x)))
cs("cs_minmax")(lambda c, x: fdiv(fin(x) - F.min(fin(x)).over(sec(c).w), F.max(fin(x)).over(sec(c).w) - F.min(fin(x)).over(sec(c).w)))
cs("cs_one_side", 1, 2)(lambda c, x, long=True: fin(x) - (F.min(fin(x)) if long in (True, 1) else F.max(fin(x))).over(sec(c).w))


def decile(x: Column, keys: list[Column], groups: int) -> Column:
    """0-based bucket by average rank: floor((2 r - 1) G / (2 n)), within 0..G-1."""
    n = F.count(x).over(Window.partitionBy(*keys))
    b = F.floor((2 * average_rank(x, keys) - 1) * groups / (2.0 * n))
    return F.greatest(F.lit(0), F.least(F.lit(groups - 1), b)).cast("int")


cs("cs_qcut", 1, 2)(lambda c, x, q=10: F.when(fin(x).isNotNull(), decile(fin(x), c.cs, int(q))).cast("double"))
cs("cs_quantile", 1, 3)(lambda c, x, lo=0.025, hi=0.975: sec(c).clip(fin(x), sec(c).q(fin(x), lo), sec(c).q(fin(x), hi)))
cs("cs_quantile_zscore", 1, 3)(lambda c, x, lo=0.025, hi=0.975: sec(c).zscore(sec(c).clip(fin(x), sec(c).q(fin(x), lo), sec(c).q(fin(x), hi))))
cs("cs_robust_scale")(lambda c, x: fdiv(fin(x) - sec(c).q(fin(x), 0.5), sec(c).q(fin(x), 0.75) - sec(c).q(fin(x), 0.25)))
cs("cs_scale_down", 1, 2)(lambda c, x, k=0.0: fdiv(fin(x) - F.min(fin(x)).over(sec(c).w), F.max(fin(x)).over(sec(c).w) - F.min(fin(x)).over(sec(c).w)) - float(k))
cs("cs_truncate", 1, 2)(lambda c, x, p=0.01: F.least(fin(x), float(p) * F.sum(fin(x)).over(sec(c).w)))


def cs_scale(c: Context, x, a=1.0, long=None, short=None) -> Column:
    """x so that the sum of its absolute values is a; with long / short, each side to its own sum."""
    x, w = fin(x), sec(c).w
    if long is None and short is None:
        return x * float(a) / F.nullif(F.sum(F.abs(x)).over(w), F.lit(0.0))
    up, down = F.when(x > 0, x), F.when(x < 0, -x)
    return F.when(x > 0, x * float(long or a) / F.sum(up).over(w)).when(x < 0, x * float(short or a) / F.sum(down).over(w)).otherwise(x)


cs("cs_scale", 1, 4)(cs_scale)


def cs_top_bottom(c: Context, x, k=10) -> Column:
    """1 for the k highest, -1 for the k lowest, else 0; ties by entity; a row in both is on top."""
    x = fin(x)
    part = [*c.cs, x.isNull()]
    hi = F.row_number().over(Window.partitionBy(*part).orderBy(x.desc(), F.col(c.code)))
    lo = F.row_number().over(Window.partitionBy(*part).orderBy(x.asc(), F.col(c.code)))
    return F.when(x.isNotNull(), F.when(hi <= int(k), 1.0).when(lo <= int(k), -1.0).otherwise(0.0))


cs("cs_top_bottom", 1, 2)(cs_top_bottom)


def dense_pct(x: Column, keys: list[Column], pct: bool = True) -> Column:
    """Dense rank from 0; pct: over the greatest level, at least 1. Null, NaN and infinities give null."""
    w = Window.partitionBy(*keys, x.isNull()).orderBy(x)
    level = F.dense_rank().over(w) - 1
    if not pct:
        return F.when(x.isNotNull(), level.cast("double"))
    top = F.max(level).over(Window.partitionBy(*keys, x.isNull()))
    return F.when(x.isNotNull(), level / F.greatest(top, F.lit(1)))


def stable_rank(c: Context, x, pct=True, tie_ulps=4) -> Column:
    """Dense rank with near-ties: a value within tie_ulps representable doubles of its group's lowest value joins that group.

    Sorted values are compared with their predecessor first: only chains of
    near neighbours need the anchor rule, and within such a chain (some ULPs
    wide) the anchor of a value is found by a running fold over the chain's values.
    """
    x = fin(x)
    if int(tie_ulps) <= 0:
        return dense_pct(x, c.cs, bool(pct))
    part = [*c.cs, x.isNull()]
    w = Window.partitionBy(*part).orderBy(x)
    prev = F.lag(x).over(w)

    def step(v: Column) -> Column:
        """One ULP: 2^(exponent - 52), at least the subnormal step. The logarithm may be a power off beside a power of two, so it is set right by comparison."""
        a = F.greatest(F.abs(v), F.lit(2.3e-308))
        p = F.pow(F.lit(2.0), F.floor(F.log2(a)))
        p = F.when(p > a, p / 2).when(p <= a / 2, p * 2).otherwise(p)
        return F.greatest(p * 2.0**-52, F.lit(4.9e-324))

    near = F.coalesce(x - prev <= int(tie_ulps) * step(prev), F.lit(False))
    chain = F.sum(F.when(near, 0).otherwise(1)).over(w.rowsBetween(Window.unboundedPreceding, 0))
    cw = Window.partitionBy(*part, chain)
    values = F.array_sort(F.collect_set(x).over(cw))
    lim = lambda a: a + int(tie_ulps) * step(a)
    start = F.struct(F.lit(None).cast("double").alias("a"), F.lit(-1).alias("k"))
    grown = lambda acc, v: F.when(acc["a"].isNotNull() & (v <= lim(acc["a"])), F.struct(acc["a"].alias("a"), acc["k"].alias("k"))).otherwise(F.struct(v.alias("a"), (acc["k"] + 1).alias("k")))
    sub = F.aggregate(F.filter(values, lambda v: v <= x), start, grown)["k"]
    level = F.dense_rank().over(Window.partitionBy(*part).orderBy(chain, sub)) - 1
    if not pct:
        return F.when(x.isNotNull(), level.cast("double"))
    return F.when(x.isNotNull(), level / F.greatest(F.max(level).over(Window.partitionBy(*part)), F.lit(1)))


cs("cs_rank", 1, 3, aliases=("cs_stable_rank",))(stable_rank)
cs("cs_rank_if", 2, 3, (0, 1))(lambda c, cond, x, pct=True: F.when(col(cond).cast("boolean"), dense_pct(F.when(col(cond).cast("boolean"), fin(x)), [*c.cs, F.coalesce(col(cond).cast("boolean"), F.lit(False))], bool(pct))))

factor_op("gp_rank", "gp", 2, 2, masked=(1,))(lambda c, k, x: average_rank(fin(x), [*c.cs, col(k)]))
factor_op("gp_mean", "gp", 2, 2, masked=(1,))(lambda c, k, x: Section(*c.cs, col(k)).mean(fin(x)))
factor_op("gp_demean", "gp", 2, 2, masked=(1,))(lambda c, k, x: fin(x) - Section(*c.cs, col(k)).mean(fin(x)))
factor_op("gp_zscore", "gp", 2, 2, masked=(1,))(lambda c, k, x: Section(*c.cs, col(k)).zscore(fin(x)))
