"""Intraday operators (im: rolling inside one day; day: one value per entity and day)."""

from __future__ import annotations

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomspan.functions.numeric import dbl, full, rows
from loomspan.functions.registry import Context, factor_op


def _im(agg):
    return lambda c, x, n: full(dbl(x), c.im, int(n), agg(dbl(x)).over(rows(c.im, int(n))))


for _n, _a in {"mean": F.avg, "sum": F.sum, "std": F.stddev_samp, "max": F.max, "min": F.min, "median": lambda x: F.percentile(x, 0.5)}.items():
    factor_op(f"im_{_n}", "im", 2, 2, 1)(_im(_a))
factor_op("im_cummax", "im", 1)(lambda c, x: F.max(dbl(x)).over(c.im.rowsBetween(Window.unboundedPreceding, 0)))
factor_op("im_delay", "im", 2, 2, 1)(lambda c, x, k: F.lag(dbl(x), int(k)).over(c.im))


DAY = {
    "day_sum": lambda x, m: F.sum(x),
    "day_mean": lambda x, m: F.avg(x),
    "day_max": lambda x, m: F.max(x),
    "day_min": lambda x, m: F.min(x),
    "day_first": F.min_by,
    "day_last": F.max_by,
}
for _n, _a in DAY.items():
    factor_op(_n, "day", 1)(lambda c, x, _a=_a: c.day_value(_a, dbl(x)))


def at_minute(c: Context, x, k) -> Column:
    if int(k) < 0:
        raise ValueError(f"at_minute: {k} is no minute of the day")
    return c.day_value(lambda v, m: F.max(F.when(m == int(k), v)), dbl(x))


factor_op("at_minute", "day", 2)(at_minute)
