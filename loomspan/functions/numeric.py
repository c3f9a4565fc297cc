"""Numeric semantics shared by all operators: IEEE division and logs, finite values, full windows, ranks."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, Window, WindowSpec
from pyspark.sql import functions as F

INF = float("inf")
NAN = float("nan")


def col(x) -> Column:
    return x if isinstance(x, Column) else F.lit(x)


def dbl(x) -> Column:
    return col(x).cast("double")


def fin(x: Column) -> Column:
    """NaN and infinities become null."""
    x = dbl(x)
    return F.when(~F.isnan(x) & (F.abs(x) < INF), x)


def finite(x: Column) -> Column:
    x = dbl(x)
    return F.coalesce(~F.isnan(x) & (F.abs(x) < INF), F.lit(False))


def fdiv(a, b) -> Column:
    """Floating division: x/0 is +-Inf, 0/0 and NaN/0 NaN; null stays null."""
    a, b = dbl(a), dbl(b)
    zero = F.when(F.isnan(a) | (a == 0), NAN).when(a.isNull(), F.lit(None)).when(a > 0, INF).otherwise(-INF)
    return F.when(b == 0, zero).otherwise(F.try_divide(a, b))


def flog(x, base: float | None = None) -> Column:
    """Logarithm with IEEE limits: log(0) is -Inf, of a negative NaN."""
    x = dbl(x)
    v = F.log(x) if base is None else F.log(x) / float(np.log(base)) if base not in (2, 10) else (F.log2(x) if base == 2 else F.log10(x))
    return F.when(x.isNull(), F.lit(None)).when(F.isnan(x), NAN).when(x == 0, -INF).when(x < 0, NAN).otherwise(v)


def rows(w: WindowSpec, d: int) -> WindowSpec:
    return w.rowsBetween(-(int(d) - 1), Window.currentRow)


def running(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.currentRow)


def whole(w: WindowSpec) -> WindowSpec:
    return w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)


def full(x: Column, w: WindowSpec, d: int, value: Column, least: int | None = None) -> Column:
    """`value`, if the last d rows hold at least `least` (all d) observations of x."""
    return F.when(F.count(x).over(rows(w, d)) >= (d if least is None else least), value)


def average_rank(x: Column, partition: list[Column]) -> Column:
    """1-based rank of x in its partition, ties sharing the mean rank; null for null."""
    p = [*partition, x.isNull()]
    r = F.rank().over(Window.partitionBy(*p).orderBy(x)) + (F.count(F.lit(1)).over(Window.partitionBy(*p, x)) - 1) / 2.0
    return F.when(x.isNotNull(), r)


def ordered_bits(x: np.ndarray) -> np.ndarray:
    """IEEE doubles as unsigned integers in the same order; -0.0 and 0.0 are one."""
    b = (np.asarray(x, np.float64) + 0.0).view(np.uint64)
    sign = np.uint64(1) << np.uint64(63)
    return np.where(b & sign, ~b, b | sign)


def ulp_distance(a, b) -> np.ndarray:
    """Number of representable doubles between a and b."""
    x, y = ordered_bits(np.atleast_1d(a)), ordered_bits(np.atleast_1d(b))
    return np.where(x > y, x - y, y - x)


def close_doubles(a: np.ndarray, b: np.ndarray, max_ulp: int = 4, scaled_eps: float = 8.0) -> np.ndarray:
    """Equal within max_ulp representable values or scaled_eps machine epsilons of the larger; NaN equals NaN."""
    a, b = np.asarray(a, np.float64), np.asarray(b, np.float64)
    both_nan = np.isnan(a) & np.isnan(b)
    near = ulp_distance(a, b) <= max_ulp
    scaled = np.abs(a - b) <= scaled_eps * np.finfo(np.float64).eps * np.maximum(np.abs(a), np.abs(b))
    return both_nan | (~np.isnan(a) & ~np.isnan(b) & (near | scaled))
