"""Small dataflow operators between tables: enrichments, links, date picks and daily values on a minute grid."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomspan.functions.numeric import full, rows


def index_columns(df: DataFrame, index: DataFrame, index_code: str, columns: Sequence[str], code: str = "code", date: str = "date", prefix: str = "index_") -> DataFrame:
    """Each row with the values of one index on its day; null where the index has none. Of a day's repeated index rows the greatest values count."""
    one = index.where(F.col(code) == index_code).groupBy(F.col(date).alias("_day")).agg(*[F.max(c).alias(prefix + c) for c in columns])
    return df.join(one, F.col(date) == F.col("_day"), "left").drop("_day")


def canonical_codes(df: DataFrame, mapping: DataFrame, raw: str, canonical: str, code: str = "code") -> DataFrame:
    """Rows under the canonical spelling of their code, in the column `canonical`; null where the mapping has none.

    A raw code with two canonical ones, or a canonical one of two raw codes, is an error: rows would multiply or collide.
    """
    m = mapping.select(F.col(raw).alias("_raw"), F.col(canonical).alias("_canonical")).where("_raw is not null").distinct()
    for one, other in (("_raw", "_canonical"), ("_canonical", "_raw")):
        bad = m.where(F.col(one).isNotNull()).groupBy(one).agg(F.count_distinct(other).alias("n")).where("n > 1").limit(1).collect()
        if bad:
            raise ValueError(f"{bad[0][0]!r} maps to {bad[0]['n']} codes")
    return df.join(m, F.col(code) == F.col("_raw"), "left").withColumn(canonical, F.col("_canonical")).drop("_raw", "_canonical")


def link_cancels(events: DataFrame, code: str = "code", day: str = "date", ref: str = "ref", carry: Sequence[str] = ("side", "price")) -> DataFrame:
    """Cancels with the side and price of the order they take back, if exactly one order of that code and day has the id.

    events: kind, id, `ref` (the id a cancel names). Columns come as add_<name>; an id that several orders share names none.
    """
    adds = events.where(F.col("kind") == "add").groupBy(F.col(code).alias("_c"), F.col(day).alias("_d"), F.col("id").alias("_id")).agg(F.count(F.lit(1)).alias("_n"), *[F.max(c).alias(f"add_{c}") for c in carry]).where("_n = 1").drop("_n")
    return events.where(F.col("kind") == "cancel").join(adds, (F.col(code) == F.col("_c")) & (F.col(day) == F.col("_d")) & (F.col(ref) == F.col("_id")), "left").drop("_c", "_d", "_id")


def any_per_group(df: DataFrame, by: Sequence[str], **conditions: Column) -> DataFrame:
    """Whether each condition holds for any row of a group; null counts as no."""
    return df.groupBy(*by).agg(*[F.bool_or(F.coalesce(c, F.lit(False))).alias(n) for n, c in conditions.items()])


def last_dates(df: DataFrame, n: int, date: str = "date") -> DataFrame:
    """Rows of the last n distinct dates."""
    return df.join(df.select(date).where(F.col(date).isNotNull()).distinct().orderBy(F.desc(date)).limit(n), date, "left_semi")


def seeded_dates(df: DataFrame, n: int, seed: int, date: str = "date") -> DataFrame:
    """Rows of n distinct dates drawn by a seed: those whose digest with the seed comes first. The same dates on any cluster."""
    days = df.select(date).where(F.col(date).isNotNull()).distinct()
    return df.join(days.orderBy(F.md5(F.concat_ws("|", F.col(date).cast("string"), F.lit(str(seed)))), date).limit(n), date, "left_semi")


def with_trade(bars: DataFrame, amount: str = "amount") -> DataFrame:
    """has_trade: whether the minute has an amount above 0."""
    return bars.withColumn("has_trade", F.coalesce((F.col(amount) > 0) & ~F.isnan(F.col(amount).cast("double")), F.lit(False)))


def inject_daily(bars: DataFrame, daily: DataFrame, days: int = 20, code: str = "code", date: str = "date") -> DataFrame:
    """Minutes with their day's eod_close, prev_close, day_amt, day_vol and means of the last `days` rows, adv20_amt and adv20_vol.

    Days without a row are skipped: windows run over the rows there are. Bars of a day without a daily row have nulls.
    """
    w = Window.partitionBy(code).orderBy(date)
    mean = lambda c: full(F.col(c).cast("double"), w, days, F.avg(c).over(rows(w, days)))
    d = daily.select(F.col(code).alias("_c"), F.col(date).alias("_d"), F.col("close").alias("eod_close"), F.lag("close").over(w).alias("prev_close"), F.col("amount").alias("day_amt"), F.col("volume").alias("day_vol"), mean("amount").alias("adv20_amt"), mean("volume").alias("adv20_vol"))
    return bars.join(d, (F.col(code) == F.col("_c")) & (F.col(date) == F.col("_d")), "left").drop("_c", "_d")


def execution_window(bars: DataFrame, day, start: int, end: int, codes: Sequence[str] | None = None, code: str = "code", date: str = "date", minute: str = "minute_index") -> DataFrame:
    """The minutes start to end (both included) of one day, for some codes or all; filters that reach the scan."""
    d = bars.where((F.col(date) == F.lit(day)) & F.col(minute).between(start, end))
    return d if codes is None else d.where(F.col(code).isin(list(codes)))


def action_window(events: DataFrame, start, end, codes: DataFrame | None = None, code: str = "code", date: str = "date") -> DataFrame:
    """Corporate actions whose day lies in [start, end], of the codes of a table or of all."""
    d = events.where(F.col(date).between(F.lit(start), F.lit(end)))
    return d if codes is None else d.join(codes.select(code).distinct(), code, "left_semi")
