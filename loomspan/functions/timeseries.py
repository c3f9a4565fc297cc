"""Rolling, cumulative and pattern operators per entity (kind ts) that are plain window expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomspan.functions.numeric import NAN, col, dbl, fdiv, flog, full, rows, running
from loomspan.functions.registry import Context, factor_op


def ts(names: str, least: int = 1, most: int | None = -1, window: int | str | None = 1, returns: str = "scalar"):
    first, *rest = names.split()
    return factor_op(first, "ts", least, most, window, (), returns, tuple(rest))


def lag(c: Context, x, d: int = 1) -> Column:
    d = int(d)
    return col(x) if d == 0 else F.lag(col(x), d).over(c.ts)


def over(c: Context, agg: Column, x, d: int, least=None) -> Column:
    """agg over the last d rows, null until they hold d (or `least`) observations."""
    return full(dbl(x), c.ts, int(d), agg.over(rows(c.ts, int(d))), None if least is None else int(least))


def avg(c, x, d, least=None):
    return over(c, F.avg(dbl(x)), x, d, least)


def total(c, x, d, least=None):
    return over(c, F.sum(dbl(x)), x, d, least)


def high(c, x, d, least=None):
    return over(c, F.max(dbl(x)), x, d, least)


def low(c, x, d, least=None):
    return over(c, F.min(dbl(x)), x, d, least)


def std(c, x, d, ddof=1, least=None):
    return over(c, (F.stddev_pop if int(ddof) == 0 else F.stddev_samp)(dbl(x)), x, d, least)


def var(c, x, d, ddof=1, least=None):
    return over(c, (F.var_pop if int(ddof) == 0 else F.var_samp)(dbl(x)), x, d, least)


def flag(c) -> Column:
    return F.coalesce(col(c).cast("boolean"), F.lit(False)).cast("int")


def count_true(c, x, d) -> Column:
    d = int(d)
    v = F.sum(flag(x)).over(rows(c.ts, d))
    return F.when(F.count(F.lit(1)).over(rows(c.ts, d)) >= d, v.cast("double"))


def every(c, x, d) -> Column:
    return count_true(c, x, d) == int(d)


def exist(c, x, d) -> Column:
    return count_true(c, x, d) > 0


def between(c, x, a, b, agg) -> Column:
    """agg of the condition over the rows a to b ago (a >= b)."""
    a, b = max(int(a), int(b)), min(int(a), int(b))
    return agg(flag(x)).over(c.ts.rowsBetween(-a, -b)) == 1


def rn(c: Context) -> Column:
    return F.row_number().over(c.ts)


ts("ts_delay ts_REF", 1, 3)(lambda c, x, d=1, fill=None: lag(c, x, d) if fill is None else F.coalesce(lag(c, x, d), col(fill)))
ts("ts_REFX", 1, 2)(lambda c, x, d=1: F.lead(col(x), int(d)).over(c.ts))
ts("ts_delta ts_DIFF ts_MOM ts_MTM", 1, 2)(lambda c, x, d=1: col(x) - lag(c, x, d))
ts("ts_returns ts_ROCP", 1, 2)(lambda c, x, d=1: fdiv(x, lag(c, x, d)) - 1)
ts("ts_ROC", 1, 2)(lambda c, x, d=10: (fdiv(x, lag(c, x, d)) - 1) * 100)
ts("ts_ROCR", 1, 2)(lambda c, x, d=10: fdiv(x, lag(c, x, d)))
ts("ts_ROCR100", 1, 2)(lambda c, x, d=10: fdiv(x, lag(c, x, d)) * 100)
ts("ts_log_diff", 1, 2)(lambda c, x, d=1: flog(x) - flog(lag(c, x, d)))
ts("ts_mean ts_MA ts_SMA", 1, 3)(lambda c, x, d=5, least=None: avg(c, x, d, least))
ts("ts_BOLL_M", 1, 3)(lambda c, x, d=20, k=2: avg(c, x, d))
ts("ts_sum ts_SUM", 1, 3)(lambda c, x, d=5, least=None: total(c, x, d, least))
ts("ts_max ts_MAX ts_HHV", 1, 3)(lambda c, x, d=5, least=None: high(c, x, d, least))
ts("ts_min ts_MIN ts_LLV", 1, 3)(lambda c, x, d=5, least=None: low(c, x, d, least))
ts("ts_product ts_MULAR", 1, 3)(lambda c, x, d=5, least=None: over(c, F.product(dbl(x)), x, d, least))
ts("ts_std_dev", 1, 4)(lambda c, x, d=5, ddof=1, least=None: std(c, x, d, ddof, least))
ts("ts_STD", 1, 2)(lambda c, x, d=10: std(c, x, d, 1))
ts("ts_STDDEV", 1, 3)(lambda c, x, d=5, nb=1.0: std(c, x, d, 0) * float(nb))
ts("ts_STDP", 1, 2)(lambda c, x, d=10: std(c, x, d, 0))
ts("ts_VAR", 1, 3)(lambda c, x, d=5, ddof=1: var(c, x, d, ddof))
ts("ts_VARP", 1, 2)(lambda c, x, d=10: var(c, x, d, 0))
ts("ts_median", 1, 3)(lambda c, x, d=5, least=None: over(c, F.percentile(dbl(x), 0.5), x, d, least))
ts("ts_percentage", 2, 4)(lambda c, x, d, p=0.5, least=None: over(c, F.percentile(dbl(x), float(p)), x, d, least))
ts("ts_skewness", 1, 4)(lambda c, x, d=5, bias=True, least=None: _bias(c, x, d, F.skewness(dbl(x)), bias, 3, least))
ts("ts_kurtosis", 1, 4)(lambda c, x, d=5, bias=True, least=None: _bias(c, x, d, F.kurtosis(dbl(x)), bias, 4, least))


def _bias(c, x, d, agg, bias, moment, least):
    v = over(c, agg, x, d, least)
    if bias in (True, 1):
        return v
    n = F.count(dbl(x)).over(rows(c.ts, int(d))).cast("double")
    if moment == 3:
        return F.when(n > 2, v * F.sqrt(n * (n - 1)) / (n - 2))
    return F.when(n > 3, ((n + 1) * v + 6) * (n - 1) / ((n - 2) * (n - 3)))


def moments(c: Context, d: int, least=None, **xs) -> dict[str, Column]:
    """Means over the last d rows of named products, where every factor is present."""
    return {k: F.avg(v).over(rows(c.ts, d)) for k, v in xs.items()}


def pairs(*xs) -> tuple[list[Column], Column]:
    ok = reduce(lambda a, b: a & b, [dbl(x).isNotNull() for x in xs])
    return [F.when(ok, dbl(x)) for x in xs], ok


def over_spread(a: Column, b: Column) -> Column:
    """A window's co-movement a over its spread b: 0 / 0, so NaN, where nothing moves. ANSI division, that of F.corr too, raises there."""
    return F.coalesce(F.try_divide(a, b), F.lit(NAN))


def corr(c, x, y, d) -> Column:
    (x, y), _ = pairs(x, y)
    w = rows(c.ts, int(d))
    return full(x, c.ts, int(d), over_spread(F.covar_pop(x, y).over(w), F.stddev_pop(x).over(w) * F.stddev_pop(y).over(w)))


def cov(c, x, y, d, ddof=1) -> Column:
    (x, y), _ = pairs(x, y)
    return full(x, c.ts, int(d), (F.covar_pop if int(ddof) == 0 else F.covar_samp)(x, y).over(rows(c.ts, int(d))))


ts("ts_corr ts_CORREL ts_RELATE", 2, 5, 2)(lambda c, x, y, d=5, *_: corr(c, x, y, d))
ts("ts_covariance ts_COVAR", 2, 5, 2)(lambda c, x, y, d=5, ddof=1, *_: cov(c, x, y, d, ddof))


def central(c, xs, d, powers) -> Column:
    """Mean over the last d rows of the product of centred series to powers; the window's own means."""
    vs, ok = pairs(*xs)
    d = int(d)
    # held once for all powers: the window's list and the mean of each series over it
    arr = c.hold(F.collect_list(F.when(ok, F.struct(*[v.alias(f"v{i}") for i, v in enumerate(vs)]))).over(rows(c.ts, d)))
    n = F.nullif(F.size(arr), F.lit(0))

    def mean_of(i: int) -> Column:
        return c.hold(F.aggregate(arr, F.lit(0.0), lambda a, s: a + s[f"v{i}"]) / n)

    mean = [mean_of(i) for i in range(len(vs))]
    prod = lambda s: reduce(lambda a, b: a * b, [F.pow(s[f"v{i}"] - mean[i], F.lit(float(p))) for i, p in enumerate(powers)])
    return c.hold(full(vs[0], c.ts, d, F.aggregate(arr, F.lit(0.0), lambda a, s: a + prod(s)) / n))


ts("ts_moment", 2, 4)(lambda c, x, d, k=2, *_: central(c, [x], d, [k]))
ts("ts_co_skewness", 2, 5, 2)(lambda c, x, y, d=10, *_: fdiv(central(c, [x, y], d, [1, 2]), F.sqrt(central(c, [x], d, [2])) * central(c, [y], d, [2])))
ts("ts_co_kurtosis", 2, 5, 2)(lambda c, x, y, d=10, *_: fdiv(central(c, [x, y], d, [1, 3]), F.sqrt(central(c, [x], d, [2])) * F.pow(central(c, [y], d, [2]), 1.5)))
ts("ts_triple_corr", 4, 5, 3)(lambda c, x, y, z, d, *_: fdiv(central(c, [x, y, z], d, [1, 1, 1]), F.sqrt(central(c, [x], d, [2]) * central(c, [y], d, [2]) * central(c, [z], d, [2]))))


def partial_corr(c, x, y, z, d, *_) -> Column:
    xy, xz, yz = (c.hold(corr(c, a, b, d)) for a, b in ((x, y), (x, z), (y, z)))
    return fdiv(xy - xz * yz, F.sqrt((1 - xz * xz) * (1 - yz * yz)))


ts("ts_partial_corr", 4, 5, 3)(partial_corr)


def slope(c, y, x, d) -> tuple[Column, Column]:
    (y, x), _ = pairs(y, x)
    w = rows(c.ts, int(d))
    s = c.hold(full(x, c.ts, int(d), over_spread(F.covar_pop(y, x).over(w), F.var_pop(x).over(w))))
    return s, F.avg(y).over(w) - s * F.avg(x).over(w)


ts("ts_regression_slope", 3, 4, 2)(lambda c, y, x, d, *_: slope(c, y, x, d)[0])
ts("ts_regression_intercept", 3, 4, 2)(lambda c, y, x, d, *_: slope(c, y, x, d)[1])
ts("ts_regression_pred", 3, 4, 2)(lambda c, y, x, d, *_: slope(c, y, x, d)[0] * dbl(x) + slope(c, y, x, d)[1])
ts("ts_regression_resid", 3, 4, 2)(lambda c, y, x, d, *_: dbl(y) - (slope(c, y, x, d)[0] * dbl(x) + slope(c, y, x, d)[1]))


def window_list(c, x, d) -> Column:
    """The observations of the last d rows, oldest first."""
    return F.collect_list(dbl(x)).over(rows(c.ts, int(d)))


def ts_rank(c, x, d=5, least=None) -> Column:
    """Average rank of the current value in its window, scaled to [0, 1]."""
    x = dbl(x)
    w = window_list(c, x, d)
    below, same = F.size(F.filter(w, lambda v: v < x)), F.size(F.filter(w, lambda v: v == x))
    n = F.size(w)
    r = below + (same - 1) / 2.0
    return F.when(x.isNotNull(), full(x, c.ts, int(d), F.when(n > 1, r / (n - 1)).otherwise(0.5), least))


ts("ts_rank", 1, 3)(ts_rank)
ts("ts_HOD", 1, 2)(lambda c, x, d=5: full(dbl(x), c.ts, int(d), (F.size(F.filter(window_list(c, x, d), lambda v: v > dbl(x))) + 1).cast("double")))
ts("ts_LOD", 1, 2)(lambda c, x, d=5: full(dbl(x), c.ts, int(d), (F.size(F.filter(window_list(c, x, d), lambda v: v < dbl(x))) + 1).cast("double")))


def bars_since(c, x, d, best, least=None) -> Column:
    """Rows since the window's extreme; the latest of equals."""
    x = dbl(x)
    at = F.struct((x if best == "max" else -x).alias("v"), rn(c).alias("k"))
    top = F.max(F.when(x.isNotNull(), at)).over(rows(c.ts, int(d)))
    return full(x, c.ts, int(d), (rn(c) - top["k"]).cast("double"), least)


ts("ts_arg_max ts_HHVBARS", 1, 4)(lambda c, x, d=5, *_: bars_since(c, x, d, "max"))
ts("ts_arg_min ts_LLVBARS", 1, 4)(lambda c, x, d=5, *_: bars_since(c, x, d, "min"))
ts("ts_MAXINDEX", 1, 2)(lambda c, x, d=30: rn(c) - 1 - bars_since(c, x, d, "max"))
ts("ts_MININDEX", 1, 2)(lambda c, x, d=30: rn(c) - 1 - bars_since(c, x, d, "min"))
ts("ts_zscore", 1, 3)(lambda c, x, d=5, least=None: F.when(std(c, x, d, 1, least) > 0, (dbl(x) - avg(c, x, d, least)) / std(c, x, d, 1, least)))
ts("ts_ir", 1, 3)(lambda c, x, d=5, least=None: fdiv(avg(c, x, d, least), std(c, x, d, 1, least)))
ts("ts_l2_norm", 1, 3)(lambda c, x, d=5, least=None: F.sqrt(total(c, dbl(x) * dbl(x), d, least)))
ts("ts_max_diff", 1, 3)(lambda c, x, d=5, least=None: dbl(x) - high(c, x, d, least))
ts("ts_min_diff", 1, 3)(lambda c, x, d=5, least=None: dbl(x) - low(c, x, d, least))
ts("ts_min_max_cps", 2, 4)(lambda c, x, d, f=2.0, *_: low(c, x, d) + high(c, x, d) - float(f) * dbl(x))
ts("ts_min_max_diff", 2, 4)(lambda c, x, d, f=0.5, *_: dbl(x) - float(f) * (low(c, x, d) + high(c, x, d)))
ts("ts_scale", 1, 3)(lambda c, x, d=5, k=0.0: fdiv(dbl(x) - low(c, x, d), high(c, x, d) - low(c, x, d)) + float(k))
ts("ts_realized_volatility", 1, 3)(lambda c, x, d=5, *_: F.sqrt(total(c, (flog(x) - flog(lag(c, x))) * (flog(x) - flog(lag(c, x))), d)))
ts("ts_fill_null", 1, 2)(lambda c, x, d=None: F.last(col(x), ignorenulls=True).over(running(c.ts) if d is None else rows(c.ts, int(d) + 1)))
ts("ts_weighted_decay", 1, 3, "2")(lambda c, x, k=0.5, *_: (1 - float(k)) * lag(c, dbl(x)) + float(k) * dbl(x))
ts("ts_weighted_sum", 3, 4, 2)(lambda c, x, w, d, *_: total(c, dbl(x) * dbl(w), d))
ts("ts_weighted_mean", 3, 4, 2)(lambda c, x, w, d, *_: fdiv(total(c, dbl(x) * dbl(w), d), total(c, F.when(dbl(x).isNotNull(), dbl(w)), d)))


def weighted(c, x, ws: list[float]) -> Column:
    """Sum of ws[i] * value i rows ago; null until all are there."""
    x = dbl(x)
    if len(ws) <= 64:
        return reduce(lambda a, b: a + b, [w * lag(c, x, i) for i, w in enumerate(ws)])
    d = len(ws)
    arr = window_list(c, x, d)
    return full(x, c.ts, d, F.aggregate(F.zip_with(arr, F.array(*[F.lit(w) for w in reversed(ws)]), lambda v, w: v * w), F.lit(0.0), lambda a, v: a + v))


def linear(c, x, d=5, *_) -> Column:
    d = int(d)
    s = d * (d + 1) / 2
    return weighted(c, x, [(d - i) / s for i in range(d)])


ts("ts_decay_linear ts_WMA", 1, 3)(linear)


def decay_exp(c, x, d=30, f=0.5, *_) -> Column:
    ws = [float(f) ** i for i in range(int(d))]
    return weighted(c, x, [w / sum(ws) for w in ws])


ts("ts_decay_exp_window", 1, 4)(decay_exp)

# counts
ts("ts_count ts_COUNT", 1, 3)(lambda c, x, d=30, *_: count_true(c, (dbl(x) != 0) if not _boolish(x) else x, d))


def _boolish(x) -> bool:
    return "=" in str(x) or ">" in str(x) or "<" in str(x) or " AND " in str(x) or " OR " in str(x) or "NOT " in str(x)


ts("ts_count_eq", 1, 4)(lambda c, x, d=30, v=1, *_: count_true(c, dbl(x) == float(v), d))
ts("ts_count_ge", 1, 4)(lambda c, x, d=30, v=1, *_: count_true(c, dbl(x) >= float(v), d))
ts("ts_count_nans", 1, 3)(lambda c, x, d=5, *_: count_true(c, F.isnan(dbl(x)), d))
ts("ts_count_nulls", 1, 3)(lambda c, x, d=5, *_: count_true(c, col(x).isNull(), d))

# cumulative
_cum = {"ts_cum_sum ts_CUMSUM": F.sum, "ts_cum_max": F.max, "ts_cum_min": F.min, "ts_cum_prod": F.product, "ts_cum_count": F.count}
for _n, _a in _cum.items():
    ts(_n, 1, 1, "unbounded")(lambda c, x, _a=_a: _a(dbl(x)).over(running(c.ts)).cast("double"))
_reset = lambda c, v: F.sum(F.when(dbl(v).isNull() | (dbl(v) == 0), 1).otherwise(0)).over(running(c.ts))


def _grouped(c, g) -> Window:
    return Window.partitionBy(c.code, g).orderBy(c.date).rowsBetween(Window.unboundedPreceding, 0)


ts("ts_cum_prod_by", 2, 2, "unbounded")(lambda c, r, v: F.when(dbl(v) != 0, F.product(1 + F.coalesce(dbl(r), F.lit(0.0))).over(_grouped(c, _reset(c, v)))).otherwise(1.0))
ts("ts_cum_sum_by", 2, 2, "unbounded")(lambda c, r, v: F.when(dbl(v) != 0, F.sum(F.when(dbl(v) != 0, dbl(r))).over(_grouped(c, _reset(c, v)))).otherwise(0.0))


def cum_sum_reset(c, x) -> Column:
    """Running sum within runs of one sign; 0 or a change of sign starts anew."""
    s = F.signum(F.coalesce(dbl(x), F.lit(0.0)))
    new = F.when(s.eqNullSafe(F.lag(s).over(c.ts)), 0).otherwise(1)
    return F.sum(F.coalesce(dbl(x), F.lit(0.0))).over(_grouped(c, F.sum(new).over(running(c.ts))))


ts("ts_cum_sum_reset", 1, 1, "unbounded")(cum_sum_reset)

# conditions
ts("ts_ALL ts_EVERY", 2)(every)
ts("ts_ANY ts_EXIST", 2)(exist)
ts("ts_EXISTR", 3)(lambda c, x, a, b: between(c, x, a, b, F.max))
ts("ts_LAST", 3)(lambda c, x, a, b: between(c, x, a, b, F.min))
ts("ts_BARSLAST", 1, 1, "unbounded")(lambda c, x: (rn(c) - F.last(F.when(flag(x) == 1, rn(c)), ignorenulls=True).over(running(c.ts))).cast("double"))
ts("ts_BARSSINCE", 1, 1, "unbounded")(lambda c, x: (rn(c) - F.min(F.when(flag(x) == 1, rn(c))).over(running(c.ts))).cast("double"))
ts("ts_BARSSINCEN", 1, 2)(lambda c, x, d=10: (rn(c) - F.min(F.when(flag(x) == 1, rn(c))).over(rows(c.ts, int(d)))).cast("double"))


def streak(c, x) -> Column:
    """Length of the run of true that ends here; 0 where false."""
    last_false = F.max(F.when(flag(x) == 0, rn(c)).otherwise(0)).over(running(c.ts))
    return (rn(c) - last_false).cast("double")


ts("ts_BARSLASTCOUNT", 1, 1, "unbounded")(streak)
ts("ts_VALUEWHEN", 2, 2, "unbounded")(lambda c, cond, x: F.last(F.when(flag(cond) == 1, col(x)), ignorenulls=True).over(running(c.ts)))
ts("ts_CROSS", 2, 2, "2")(lambda c, a, b: (dbl(a) > dbl(b)) & (lag(c, dbl(a)) <= lag(c, dbl(b))))
ts("ts_LONGCROSS", 3, 3, 2)(lambda c, a, b, d: (dbl(a) > dbl(b)) & lag(c, every(c, dbl(a) < dbl(b), d)))
ts("ts_UPNDAY", 2)(lambda c, x, d: every(c, dbl(x) > lag(c, dbl(x)), d))
ts("ts_DOWNNDAY", 2)(lambda c, x, d: every(c, dbl(x) < lag(c, dbl(x)), d))
ts("ts_NDAY", 3, 3, 2)(lambda c, a, b, d: every(c, dbl(a) > dbl(b), d))
ts("ts_SUMIF", 2, 3, 2)(lambda c, cond, x, d=30: F.sum(F.when(flag(cond) == 1, dbl(x)).otherwise(0.0)).over(rows(c.ts, int(d))))
ts("ROUND2", 1, 2)(lambda c, x, n=2: F.round(dbl(x), int(n)))
ts("FROMOPEN_1", 2)(lambda c, x, k: F.greatest(F.lit(0.0), F.least(F.hour(x) * 60 + F.minute(x) - 570, F.lit(120))) + F.greatest(F.lit(0.0), F.least(F.hour(x) * 60 + F.minute(x) - 780, F.lit(120))) + float(k))


# rows of the window with the highest / lowest key
def high_low(c, x, key, d, k, agg: str) -> Column:
    """Aggregate of x over the k (k < 0: |k| lowest) rows of the window ranked by key; ties by recency."""
    d = int(d)
    arr = F.collect_list(F.when(dbl(x).isNotNull() & dbl(key).isNotNull(), F.struct(dbl(key).alias("k"), rn(c).alias("n"), dbl(x).alias("v")))).over(rows(c.ts, d))
    s = F.sort_array(arr, asc=int(k) < 0)
    top = F.transform(F.slice(s, 1, abs(int(k))), lambda e: e["v"])
    n = F.size(top)
    tot = F.aggregate(top, F.lit(0.0), lambda a, v: a + v)
    mean = tot / F.nullif(n, F.lit(0))
    sq = F.aggregate(top, F.lit(0.0), lambda a, v: a + (v - mean) * (v - mean))
    out = {"sum": tot, "mean": mean, "var": F.when(n > 1, sq / (n - 1)), "std": F.when(n > 1, F.sqrt(sq / (n - 1)))}[agg]
    return full(dbl(x), c.ts, d, out)


for _agg in ("mean", "std", "sum", "var"):
    # args: x, window, signed count; x is its own key
    ts(f"ts_{_agg}_hl", 3)(lambda c, x, d, k, _agg=_agg: high_low(c, x, x, d, k, _agg))
ts("ts_sum_split_by", 2, 4, 2, "struct")(lambda c, x, by, d=30, k=10: F.struct(high_low(c, x, by, d, int(k), "sum").alias("high"), high_low(c, x, by, d, -int(k), "sum").alias("low")))
