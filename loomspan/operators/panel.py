"""Panel contracts, calendars, membership, fills, price views and labels."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.numeric import fdiv

FUTURE = re.compile(r"^(forward_|future_)|^(target|label)$")
HORIZONS = (1, 5, 20)


class ContractError(ValueError):
    """A frame that breaks its contract."""


def duplicate_keys(df: DataFrame, key: Sequence[str] = ("date", "code")) -> DataFrame:
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n")).where("n > 1")


def check_panel(df: DataFrame, key: Sequence[str] = ("date", "code"), past_only: bool = False) -> DataFrame:
    """The frame itself if date is a date, code a string and the key unique and present; nothing is cast or dropped."""
    types = dict(df.dtypes)
    if types.get(key[0]) != "date" or types.get(key[1]) != "string":
        raise ContractError(f"{key[0]} must be date and {key[1]} string, not {types.get(key[0])} and {types.get(key[1])}")
    if past_only and (bad := [c for c in df.columns if FUTURE.search(c)]):
        raise ContractError(f"columns of the future: {', '.join(bad)}")
    if df.where(F.col(key[0]).isNull() | F.col(key[1]).isNull()).limit(1).count():
        raise ContractError("null in the key")
    if duplicate_keys(df, key).limit(1).count():
        raise ContractError("the key is not unique")
    return df


def calendar(df: DataFrame, day: str, open_flag: str | None = None) -> DataFrame:
    """Distinct open days."""
    d = df if open_flag is None else df.where(F.col(open_flag) == 1)
    return d.select(F.col(day).alias("date")).where("date is not null").distinct()


def skeleton(days: DataFrame, codes: DataFrame) -> DataFrame:
    """Every code on every day from its first to its last listed day.

    codes: (code, first, last). The calendar, bounded by its days, travels as one sorted array
    and is exploded per code between its bounds: no cross join of two tables.
    """
    cal = days.agg(F.sort_array(F.collect_set("date")).alias("_cal"))
    d = codes.join(F.broadcast(cal), F.lit(True))
    inside = F.filter("_cal", lambda x: (x >= F.col("first")) & (F.col("last").isNull() | (x <= F.col("last"))))
    return d.select("code", F.explode(inside).alias("date"))


def exchange(code: Column) -> Column:
    return F.upper(F.substring(code, -2, 2))


def board(code: Column) -> Column:
    """Board of a canonical code by suffix and leading digits."""
    n = F.substring(code, 1, 3)
    return (
        F.when(exchange(code) == "BJ", "bse")
        .when((exchange(code) == "SH") & n.isin("688", "689"), "star")
        .when((exchange(code) == "SZ") & n.isin("300", "301"), "chinext")
        .when(exchange(code).isin("SH", "SZ"), "main")
        .otherwise("unknown")
    )


CANONICAL = r"^[0-9]{6}\.(SZ|SH|BJ)$"


def membership(panel_days: DataFrame, listing: DataFrame, exchanges: Sequence[str] | None = None, min_list_days: int = 0, exclude_bj: bool = False, st: DataFrame | None = None, exclude_st: bool = False) -> DataFrame:
    """Point-in-time membership: date, code, in_universe, is_listed, list_days, is_st, exchange.

    is_st is null where no ST table is known for the day: unknown is not false, and does not exclude.
    """
    d = panel_days.select("date", "code").join(listing.select("code", "list_date", "delist_date"), "code", "left")
    listed = (F.col("date") >= F.col("list_date")) & (F.col("delist_date").isNull() | (F.col("date") < F.col("delist_date")))
    d = d.withColumn("is_listed", F.coalesce(listed, F.lit(False))).withColumn("list_days", F.when(F.col("is_listed"), F.datediff("date", "list_date"))).withColumn("exchange", exchange(F.col("code")))
    if st is None:
        d = d.withColumn("is_st", F.lit(None).cast("boolean"))
    else:
        flags = st.select("date", "code").distinct().withColumn("_st", F.lit(True))
        covered = st.select("date").distinct().withColumn("_known", F.lit(True))
        d = d.join(flags, ["date", "code"], "left").join(F.broadcast(covered), "date", "left")
        d = d.withColumn("is_st", F.when(F.col("_known"), F.coalesce("_st", F.lit(False)))).drop("_st", "_known")
    rule = F.col("is_listed") & (F.coalesce("list_days", F.lit(-1)) >= min_list_days)
    if exchanges:
        rule = rule & F.col("exchange").isin(*exchanges)
    if exclude_bj:
        rule = rule & (F.col("exchange") != "BJ")
    if exclude_st:
        rule = rule & ~F.coalesce("is_st", F.lit(False))
    return d.select("date", "code", rule.alias("in_universe"), "is_listed", "list_days", "is_st", "exchange")


def W(code: str = "code", date: str = "date"):
    return Window.partitionBy(code).orderBy(date)


def forward_fill(df: DataFrame, cols: Sequence[str], code: str = "code", date: str = "date") -> DataFrame:
    w = W(code, date).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumns({c: F.last(c, ignorenulls=True).over(w) for c in cols})


def fill_state(df: DataFrame, before, cols: Sequence[str], code: str = "code", date: str = "date") -> DataFrame:
    """Per code and column the latest non-null value strictly before a date."""
    d = df.where(F.col(date) < F.lit(before))
    return d.groupBy(code).agg(*[F.expr(f"max_by(`{c}`, `{date}`) filter (where `{c}` is not null)").alias(c) for c in cols])


def last_seen(df: DataFrame, col: str, before, after=None, code: str = "code", date: str = "date") -> DataFrame:
    d = df.where((F.col(date) < F.lit(before)) & F.col(col).isNotNull())
    if after is not None:
        d = d.where(F.col(date) > F.lit(after))
    return d.groupBy(code).agg(F.max(date).alias("last_date"))


def tail_dates(df: DataFrame, before, n: int, code: str = "code", date: str = "date") -> DataFrame:
    """The date of the n-th latest row before a date, per code; the earliest if there are fewer."""
    w = Window.partitionBy(code).orderBy(F.col(date).desc())
    d = df.where(F.col(date) < F.lit(before)).withColumn("_k", F.row_number().over(w)).where(F.col("_k") <= n)
    return d.groupBy(code).agg(F.min(date).alias("tail_date"))


def stale_codes(df: DataFrame, days: DataFrame, col: str = "close", limit: int = 20, code: str = "code", date: str = "date") -> DataFrame:
    """Codes without an observation for more than `limit` calendar days of the market, at the last day."""
    cal = days.agg(F.sort_array(F.collect_set("date")).alias("cal"))
    seen = df.groupBy(code).agg(F.expr(f"max(`{date}`) filter (where `{col}` is not null)").alias("last_date"))
    s = seen.join(F.broadcast(cal), F.lit(True))
    gap = F.size(F.filter("cal", lambda x: x > F.coalesce("last_date", F.lit("1900-01-01").cast("date"))))
    return s.withColumn("gap", gap).where(F.col("gap") > limit).select(code, "last_date", "gap")


def view_prices(df: DataFrame, view: str = "raw", asof=None, cols: Sequence[str] = ("open", "high", "low", "close"), adj: str = "adj_factor", code: str = "code", date: str = "date") -> DataFrame:
    """raw; hfq (x adj); qfq (x adj / latest adj); pit_qfq (x adj / adj as of a date, codes without one null)."""
    if view == "raw":
        return df
    if view == "hfq":
        f = F.col(adj)
    elif view == "qfq":
        whole = W(code, date).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
        f = fdiv(F.col(adj), F.last(adj, ignorenulls=True).over(whole))
    elif view == "pit_qfq":
        base = df.where(F.col(date) <= F.lit(asof)).groupBy(code).agg(F.expr(f"max_by(`{adj}`, `{date}`) filter (where `{adj}` is not null)").alias("_base"))
        df = df.join(base, code, "left")
        f = fdiv(F.col(adj), F.col("_base"))
    else:
        raise ValueError(f"no price view {view!r}")
    out = df.withColumn("_f", f)
    return out.withColumns({c: F.col(c) * F.col("_f") for c in cols}).drop("_f", "_base")


def total_return(close: Column, adj: Column, w=None) -> Column:
    p = close * adj
    return fdiv(p, F.lag(p).over(w or W())) - 1


def forward_returns(df: DataFrame, price: Column, horizons: Sequence[int] = HORIZONS, code: str = "code", date: str = "date") -> DataFrame:
    """Labels forward_return_<h>d: price h rows ahead over price, less 1."""
    return df.withColumns({f"forward_return_{h}d": fdiv(F.lead(price, h).over(W(code, date)), price) - 1 for h in horizons})


def attach_labels(signal: DataFrame, labels: DataFrame, key: Sequence[str] = ("date", "code")) -> DataFrame:
    return signal.join(labels, list(key))


def diff_panels(a: DataFrame, b: DataFrame, col: str, tol: float = 0.0, key: Sequence[str] = ("date", "code")) -> DataFrame:
    """Rows in which a column of two panels differs; the base of the look-ahead, scale and adjustment checks."""
    j = a.select(*key, F.col(col).alias("a")).join(b.select(*key, F.col(col).alias("b")), list(key), "full")
    return j.where((F.col("a").isNull() != F.col("b").isNull()) | (F.abs(F.col("a") - F.col("b")) > tol))


def lookahead_check(df: DataFrame, compute, cut, date: str = "date", col: str = "signal", tol: float = 1e-12) -> DataFrame:
    """Rows whose value changes when everything after `cut` is taken away."""
    return diff_panels(compute(df).where(F.col(date) <= F.lit(cut)), compute(df.where(F.col(date) <= F.lit(cut))), col, tol)


def scale_check(df: DataFrame, compute, cols: Sequence[str], k: float = 10.0, col: str = "signal", tol: float = 1e-9) -> DataFrame:
    """Rows whose value changes when prices are multiplied by a constant."""
    return diff_panels(compute(df), compute(df.withColumns({c: F.col(c) * k for c in cols})), col, tol)


def week_end(df: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """Last row of each code in each ISO week, dated by the week's last market day."""
    yow, wk = F.extract(F.lit("YEAROFWEEK"), F.col(date)), F.weekofyear(date)
    end = F.max(date).over(Window.partitionBy(yow, wk))
    d = df.withColumn("_end", end).withColumn("_y", yow).withColumn("_w", wk)
    mine = F.max(date).over(Window.partitionBy(code, "_y", "_w"))
    return d.withColumn("_m", mine).where(F.col(date) == F.col("_m")).withColumn(date, F.col("_end")).drop("_end", "_y", "_w", "_m")


def every_kth_date(df: DataFrame, k: int, date: str = "date") -> DataFrame:
    """Rows of every k-th distinct date, from the first."""
    days = df.select(date).distinct()
    pick = days.withColumn("_i", F.row_number().over(Window.orderBy(date)) - 1).where(F.col("_i") % k == 0).select(date)
    return df.join(F.broadcast(pick), date, "left_semi")


def resample(df: DataFrame, minutes: int = 5, code: str = "code", date: str = "date", minute: str = "minute_index", value: str = "close", volume: str = "volume", amount: str = "amount") -> DataFrame:
    """Bars of several grid minutes: OHLC of the minutes with trade, summed volume and amount."""
    b = F.floor(F.col(minute) / minutes).cast("int")
    act = f"filter (where `{amount}` > 0)"
    return df.groupBy(code, date, b.alias("bucket")).agg(
        F.expr(f"min_by(`{value}`, `{minute}`) {act}").alias("open"),
        F.expr(f"max(`{value}`) {act}").alias("high"),
        F.expr(f"min(`{value}`) {act}").alias("low"),
        F.expr(f"max_by(`{value}`, `{minute}`) {act}").alias("close"),
        F.sum(volume).alias("volume"),
        F.sum(amount).alias("amount"),
    )
