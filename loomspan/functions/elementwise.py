"""Element-wise operators (kind el)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomspan.functions.numeric import INF, NAN, col, dbl, fdiv, finite, flog
from loomspan.functions.registry import factor_op


def el(names: str, least: int = 1, most: int | None = -1):
    first, *rest = names.split()

    def add(fn):
        return factor_op(first, "el", least, most, aliases=tuple(rest))(lambda ctx, *a: fn(*a))

    return add


UNARY = {
    "ABS abs abs_": F.abs,
    "ACOS arc_cos": F.acos,
    "ASIN arc_sin": F.asin,
    "ATAN arc_tan": F.atan,
    "CEIL CEILING ceiling": lambda x: F.ceil(x).cast("double"),
    "COS cos": F.cos,
    "COSH cosh": F.cosh,
    "EXP exp": F.exp,
    "FLOOR floor": lambda x: F.floor(x).cast("double"),
    "FRACPART fraction": lambda x: x - F.when(x < 0, F.ceil(x)).otherwise(F.floor(x)),
    "LN log": flog,
    "LOG LOG10 log10": lambda x: flog(x, 10),
    "log2": lambda x: flog(x, 2),
    "log1p": lambda x: F.when(dbl(x) == -1, -INF).when(dbl(x) < -1, NAN).otherwise(F.log1p(dbl(x))),
    "NOT not_": lambda x: ~x.cast("boolean"),
    "REVERSE reverse negate": lambda x: -x,
    "SGN SIGN sign": F.signum,
    "SIN sin": F.sin,
    "SINH sinh": F.sinh,
    "SQRT sqrt": F.sqrt,
    "TAN tan": F.tan,
    "TANH tanh": F.tanh,
    "bool_": lambda x: x.cast("boolean"),
    "cbrt": F.cbrt,
    "cot": F.cot,
    "cube": lambda x: x * x * x,
    "square": lambda x: x * x,
    "degrees": F.degrees,
    "radians": F.radians,
    "expm1": F.expm1,
    "float_": lambda x: x.cast("double"),
    "int_": lambda x: x.cast("long"),
    "inverse": lambda x: fdiv(1.0, x),
    "is_finite": finite,
    "is_not_finite": lambda x: ~finite(x),
    "is_nan": lambda x: F.when(x.isNotNull(), F.isnan(dbl(x))),
    "is_not_nan": lambda x: F.when(x.isNotNull(), ~F.isnan(dbl(x))),
    "is_null": lambda x: x.isNull(),
    "is_not_null": lambda x: x.isNotNull(),
    "logit": lambda x: flog(fdiv(x, 1 - x)),
    "nop": lambda x: x,
    "lit_": col,
    "purify": lambda x: F.when(finite(x), x),
    "s_log_1p": lambda x: F.signum(x) * F.log1p(F.abs(x)),
    "sigmoid": lambda x: 1 / (1 + F.exp(-x)),
    "softsign": lambda x: x / (1 + F.abs(x)),
    "fill_nan": lambda x: F.when(~F.isnan(x), x),
}
for _names, _fn in UNARY.items():
    el(_names)(lambda x, _f=_fn: _f(dbl(x) if _f in (F.abs, F.signum, F.exp, F.sqrt) else col(x)))


def rowwise(xs: list) -> list[Column]:
    return [dbl(x) for x in xs]


el("ADD add", 2, None)(lambda *x: reduce(lambda a, b: a + b, map(col, x)))
el("MUL multiply", 2, None)(lambda *x: reduce(lambda a, b: a * b, map(col, x)))
el("SUB subtract", 2)(lambda a, b: col(a) - col(b))
el("DIV div divide", 2)(fdiv)
el("MOD mod", 2)(lambda a, b: F.when(dbl(b) == 0, NAN).otherwise(dbl(a) - F.floor(F.try_divide(dbl(a), dbl(b))) * dbl(b)))
el("POW power", 2)(lambda a, b: F.pow(dbl(a), dbl(b)))
el("signed_power", 2)(lambda a, b: F.signum(dbl(a)) * F.pow(F.abs(dbl(a)), dbl(b)))
el("arc_tan2", 2)(lambda a, b: F.atan2(dbl(a), dbl(b)))
el("and_", 1, None)(lambda *x: reduce(lambda a, b: a & b, [col(v).cast("boolean") for v in x]))
el("or_", 1, None)(lambda *x: reduce(lambda a, b: a | b, [col(v).cast("boolean") for v in x]))
el("xor", 2)(lambda a, b: col(a).cast("boolean") != col(b).cast("boolean"))
el("equal", 2)(lambda a, b: col(a) == col(b))
el("less", 2)(lambda a, b: col(a) < col(b))
# row-wise extremes skip nulls; a NaN counts as missing here, as it does in the aggregates' valid observations
_valid = lambda x: F.when(~F.isnan(dbl(x)), dbl(x))
el("MAX max_", 2, None)(lambda *x: F.greatest(*[_valid(v) for v in x]))
el("MIN min_", 2, None)(lambda *x: F.least(*[_valid(v) for v in x]))


def _count(xs: list) -> Column:
    return reduce(lambda a, b: a + b, [F.when(dbl(x).isNotNull(), 1).otherwise(0) for x in xs])


def _total(xs: list) -> Column:
    return reduce(lambda a, b: a + b, [F.coalesce(dbl(x), F.lit(0.0)) for x in xs])


def row_mean(*x) -> Column:
    """Mean of the columns that are present."""
    return F.when(_count(x) > 0, _total(x) / _count(x))


def row_var(*x, ddof: int = 1) -> Column:
    m = row_mean(*x)
    n = _count(x)
    return F.when(n > ddof, _total([(dbl(v) - m) * (dbl(v) - m) for v in x]) / (n - ddof))


el("mean", 2, None)(row_mean)
el("var", 2, None)(row_var)
el("std", 2, None)(lambda *x: F.sqrt(row_var(*x)))

el("AVGPRICE", 4)(lambda o, h, l, c: (col(o) + col(h) + col(l) + col(c)) / 4)
el("MEDPRICE", 2)(lambda h, l: (col(h) + col(l)) / 2)
el("TYPPRICE", 3)(lambda h, l, c: (col(h) + col(l) + col(c)) / 3)
el("WCLPRICE", 3)(lambda h, l, c: (col(h) + col(l) + 2 * col(c)) / 4)
el("BETWEEN", 3)(lambda x, a, b: col(x).between(F.least(col(a), col(b)), F.greatest(col(a), col(b))))
el("RANGE", 3)(lambda x, a, b: (col(x) > F.least(col(a), col(b))) & (col(x) < F.greatest(col(a), col(b))))
el("IF IFF if_else", 2, 3)(lambda c, a, b=None: F.when(col(c).cast("boolean"), col(a)).otherwise(col(b) if b is not None else F.lit(None)))
el("IFN", 3)(lambda c, a, b: F.when(~col(c).cast("boolean"), col(a)).otherwise(col(b)))
el("ROUND round_", 1, 2)(lambda x, n=0: F.round(dbl(x), int(n)))
el("round_down", 1, 2)(lambda x, n=0: F.floor(dbl(x) * 10.0 ** int(n)) / 10.0 ** int(n))


def from_open(ts: Column) -> Column:
    """Trading minutes since 09:30 of a timestamp, the break from 11:30 to 13:00 left out; 0..240."""
    m = F.hour(ts) * 60 + F.minute(ts)
    am = F.greatest(F.lit(0), F.least(m - 570, F.lit(120)))
    pm = F.greatest(F.lit(0), F.least(m - 780, F.lit(120)))
    return (am + pm).cast("double")


el("FROMOPEN", 1)(from_open)


def clamp(x, lo=None, hi=None, lo_to=None, hi_to=None) -> Column:
    """x within [lo, hi]; outside the bound, or lo_to / hi_to where given. null stays null."""
    x = dbl(x)
    out = x
    if hi is not None:
        out = F.when(x > col(hi), dbl(hi if hi_to is None else hi_to)).otherwise(out)
    if lo is not None:
        out = F.when(x < col(lo), dbl(lo if lo_to is None else lo_to)).otherwise(out)
    return out


el("clamp", 1, 5)(clamp)
el("left_tail", 1, 2)(lambda x, hi=0.0: F.when(col(x) <= col(hi), col(x)))
el("right_tail", 1, 2)(lambda x, lo=0.0: F.when(col(x) >= col(lo), col(x)))
el("tail", 1, 4)(lambda x, lo=-1.0, hi=1.0, to=None: F.when(col(x).between(col(lo), col(hi)), dbl(to) if to is not None else F.lit(None).cast("double")).otherwise(dbl(x)))
el("fill_null", 1, 2)(lambda x, v=0.0: F.coalesce(col(x), col(v)))


def cut(x, *breaks) -> Column:
    """0-based bucket of x among ascending break points, each the closed right end of its bucket."""
    x = dbl(x)
    out = F.lit(float(len(breaks)))
    for i in range(len(breaks) - 1, -1, -1):
        out = F.when(x <= dbl(breaks[i]), float(i)).otherwise(out)
    return F.when(x.isNotNull(), out)


el("cut", 2, None)(cut)


def fold(acc, fn, xs) -> Column:
    """Folds a list of columns with fn(acc, x) while the plan is built."""
    return reduce(fn, xs if isinstance(xs, (list, tuple)) else [xs], col(acc))


el("fold", 3)(fold)

# list-valued columns
_add = lambda a, b: a + b


def _vsum(v: Column) -> Column:
    return F.aggregate(F.filter(v, lambda x: x.isNotNull()), F.lit(0.0), lambda a, x: a + x)


def _vn(v: Column) -> Column:
    return F.size(F.filter(v, lambda x: x.isNotNull()))


def _vavg(v: Column) -> Column:
    return F.when(_vn(v) > 0, _vsum(v) / _vn(v))


def _vmoment(v: Column, k: int) -> Column:
    m = _vavg(v)
    return _vavg(F.transform(v, lambda x: F.pow(x - m, float(k))))


def _vquantile(v: Column, q: float) -> Column:
    s = F.array_sort(F.filter(v, lambda x: x.isNotNull()))
    n = F.size(s)
    h = (n - 1) * float(q)
    lo, hi = F.floor(h).cast("int"), F.ceil(h).cast("int")
    a, b = F.element_at(s, lo + 1), F.element_at(s, hi + 1)
    return F.when(n > 0, a + (b - a) * (h - lo))


def _vstd(v: Column) -> Column:
    m = _vavg(v)
    return F.when(_vn(v) > 1, F.sqrt(_vsum(F.transform(v, lambda x: (x - m) * (x - m))) / (_vn(v) - 1)))


el("vec_avg")(_vavg)
el("vec_sum")(_vsum)
el("vec_count")(lambda v: F.size(v).cast("double"))
el("vec_max")(F.array_max)
el("vec_min")(F.array_min)
el("vec_range")(lambda v: F.array_max(v) - F.array_min(v))
el("vec_median")(lambda v: _vquantile(v, 0.5))
el("vec_percentage", 1, 2)(lambda v, p=0.5: _vquantile(v, p))
el("vec_choose", 2)(lambda v, k: F.try_element_at(v, F.lit(int(k) + 1)))
el("vec_stddev")(_vstd)
el("vec_ir")(lambda v: fdiv(_vavg(v), _vstd(v)))
el("vec_l2_norm")(lambda v: F.sqrt(_vsum(F.transform(v, lambda x: x * x))))
el("vec_norm")(lambda v: _vsum(F.transform(v, F.abs)))
el("vec_powersum", 1, 2)(lambda v, k=2: _vsum(F.transform(v, lambda x: F.pow(x, float(k)))))
el("vec_skewness")(lambda v: fdiv(_vmoment(v, 3), F.pow(_vmoment(v, 2), 1.5)))
el("vec_kurtosis")(lambda v: fdiv(_vmoment(v, 4), F.pow(_vmoment(v, 2), 2.0)) - 3)
