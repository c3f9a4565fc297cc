"""The processing chain on a signal: per-date steps named in text, e.g. "winsorize(0.99)"."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.crosssection import Section
from loomspan.functions.numeric import average_rank, fin

PROCESSORS: dict[str, Callable] = {}


def register_processor(name: str):
    """A processor is fn(df, signal column name, date, code, **args) -> df."""

    def add(fn):
        if name in PROCESSORS:
            raise ValueError(f"processor {name!r} is registered already")
        PROCESSORS[name] = fn
        return fn

    return add


def parse_item(text: str) -> tuple[str, list, dict]:
    """name(arg, key=value | key: value)."""
    m = re.fullmatch(r"\s*(\w+)\s*(?:\((.*)\))?\s*", text, re.S)
    if not m:
        raise ValueError(f"no processor: {text!r}")
    args, kw = [], {}
    for part in filter(None, (p.strip() for p in (m[2] or "").split(","))):
        k = re.fullmatch(r"(\w+)\s*[=:]\s*(.+)", part)
        v = (k[2] if k else part).strip().strip("'\"")
        try:
            v = float(v)
        except ValueError:
            pass
        if k:
            kw[k[1]] = v
        else:
            args.append(v)
    return m[1], args, kw


def run_chain(df: DataFrame, chain: Sequence[str], signal: str = "signal", date: str = "date", code: str = "code") -> DataFrame:
    for item in chain:
        name, args, kw = parse_item(item)
        if name not in PROCESSORS:
            raise ValueError(f"unknown processor {name!r}; known are {', '.join(PROCESSORS)}")
        df = PROCESSORS[name](df.withColumn(signal, fin(F.col(signal))), signal, date, code, *args, **kw)
    return df


def _put(df: DataFrame, signal: str, c: Column) -> DataFrame:
    return df.withColumn(signal, c)


def nearest_quantile(x: Column, partition: Sequence[Column], q: float) -> Column:
    """The observation nearest to the quantile's place, half-way up, over the whole partition."""
    part = [*partition, x.isNull()]
    place = F.floor((F.count(x).over(Window.partitionBy(*part)) - 1) * q + 0.5) + 1
    mine = F.row_number().over(Window.partitionBy(*part).orderBy(x))
    return F.max(F.when(x.isNotNull() & (mine == place), x)).over(Window.partitionBy(*partition))


@register_processor("winsorize")
def winsorize(df, s, d, _c, quantile=0.99):
    """Clip to the (1 -+ q) / 2 quantiles of the date: the observations nearest to those places."""
    if not 0.5 <= quantile < 1:
        raise ValueError(f"winsorize: quantile {quantile} is not in [0.5, 1)")
    df = df.withColumn("_lo", nearest_quantile(F.col(s), [F.col(d)], (1 - quantile) / 2)).withColumn("_hi", nearest_quantile(F.col(s), [F.col(d)], (1 + quantile) / 2))
    return _put(df, s, Section(F.col(d)).clip(F.col(s), F.col("_lo"), F.col("_hi"))).drop("_lo", "_hi")


@register_processor("standardize")
def standardize(df, s, d, _c):
    return _put(df, s, Section(F.col(d)).zscore(F.col(s)))


PROCESSORS["zscore"] = standardize


@register_processor("csranknorm")
def csranknorm(df, s, d, _c):
    x = F.col(s)
    return _put(df, s, average_rank(x, [F.col(d)]) / (F.count(x).over(Window.partitionBy(d)) + 1))


@register_processor("robustzscore")
def robustzscore(df, s, d, _c):
    q, x = Section(F.col(d)), F.col(s)
    med = q.q(x, 0.5)
    df = df.withColumn("_dev", x - med)
    mad = q.q(F.abs(F.col("_dev")), 0.5) * 1.4826
    return _put(df, s, F.when(mad > 0, F.col("_dev") / mad)).drop("_dev")


@register_processor("clip")
def clip(df, s, _d, _c, lower=None, upper=None):
    x = F.col(s)
    out = x if upper is None else F.when(x > upper, upper).otherwise(x)
    return _put(df, s, out if lower is None else F.when(x < lower, lower).otherwise(out))


@register_processor("fillna")
def fillna(df, s, d, c, method="value", value=0.0, industry="industry"):
    x = F.col(s)
    if method == "value":
        return _put(df, s, F.coalesce(x, F.lit(float(value))))
    if method == "forward":
        return _put(df, s, F.last(x, ignorenulls=True).over(Window.partitionBy(c).orderBy(d).rowsBetween(Window.unboundedPreceding, 0)))
    if method == "industry_mean":
        return _put(df, s, F.coalesce(x, F.avg(x).over(Window.partitionBy(d, industry))))
    raise ValueError(f"fillna: no method {method!r}")


@register_processor("neutralize")
def neutralize(df, s, d, c, by="market", industry="industry", mv="total_mv"):
    """Demeaned per date, (date, industry) or (date, decile of market value by ordinal rank)."""
    x = F.col(s)
    if by == "market":
        return _put(df, s, x - F.avg(x).over(Window.partitionBy(d)))
    if by == "industry":
        if industry not in df.columns:
            raise ValueError(f"neutralize: no column {industry!r}")
        return _put(df, s, F.when(F.col(industry).isNotNull(), x - F.avg(x).over(Window.partitionBy(d, industry))))
    if by == "size":
        if mv not in df.columns:
            raise ValueError(f"neutralize: no column {mv!r}")
        m = F.when(fin(F.col(mv)) > 0, F.col(mv))
        part = Window.partitionBy(d, m.isNull())
        dec = F.floor((F.row_number().over(part.orderBy(m, c)) - 1) * 10 / F.count(F.lit(1)).over(part))
        df = df.withColumn("_dec", F.when(m.isNotNull(), dec))
        return _put(df, s, F.when(F.col("_dec").isNotNull(), x - F.avg(x).over(Window.partitionBy(d, "_dec")))).drop("_dec")
    raise ValueError(f"neutralize: by {by!r}")
