"""Row rules for daily facts: one pass of flags, counted, judged, repaired and split."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

FATAL, ERROR, WARNING = "FATAL", "ERROR", "WARNING"


def daily_rules(code: str = "code", date: str = "date", order: Sequence[str] = ()) -> dict[str, tuple[str, Column]]:
    """rule -> (level, condition that a row breaks it); rows of one day go by `order`, which should tell them apart."""
    c = F.col
    w = Window.partitionBy(code).orderBy(date, *order)
    bad = lambda n: c(n).isNull() | F.isnan(c(n).cast("double"))
    return {
        "key_missing": (FATAL, c(code).isNull() | c(date).isNull()),
        "code_form": (ERROR, ~F.coalesce(c(code).rlike(r"^[0-9]{6}\.(SZ|SH|BJ)$"), F.lit(False))),
        "duplicate_key": (ERROR, F.count(F.lit(1)).over(Window.partitionBy(code, date)) > 1),
        "price_missing": (ERROR, bad("open") | bad("high") | bad("low") | bad("close")),
        "price_not_positive": (ERROR, (c("open") <= 0) | (c("high") <= 0) | (c("low") <= 0) | (c("close") <= 0)),
        "high_below": (ERROR, (c("high") < F.greatest("open", "close", "low") - 1e-9)),
        "low_above": (ERROR, (c("low") > F.least("open", "close", "high") + 1e-9)),
        "volume_negative": (ERROR, c("vol") < 0),
        "amount_negative": (ERROR, c("amount") < 0),
        "volume_missing": (WARNING, bad("vol")),
        "amount_missing": (WARNING, bad("amount")),
        "volume_without_amount": (WARNING, (c("vol") > 0) & (c("amount") == 0)),
        "amount_without_volume": (WARNING, (c("vol") == 0) & (c("amount") > 0)),
        "order_of_days": (WARNING, F.lag(date).over(w) >= c(date)),
        "jump": (WARNING, F.abs(c("close") / F.nullif(F.lag("close").over(w), F.lit(0.0)) - 1) > 0.35),
        "pre_close_gap": (WARNING, F.abs(c("pre_close") - F.lag("close").over(w)) > 0.3 * c("pre_close")),
    }


def violations(df: DataFrame, rules: Mapping[str, tuple[str, Column]], keep: Sequence[str]) -> DataFrame:
    """(keep..., rule, level): one row per broken rule; all rules share one pass and the windows of their keys."""
    flags = df.select(*keep, *[F.coalesce(cond, F.lit(False)).alias(f"_r_{n}") for n, (_, cond) in rules.items()])
    hit = F.array_compact(F.array(*[F.when(F.col(f"_r_{n}"), F.struct(F.lit(n).alias("rule"), F.lit(lv).alias("level"))) for n, (lv, _) in rules.items()]))
    return flags.select(*keep, F.explode(hit).alias("v")).select(*keep, "v.rule", "v.level")


def counts(v: DataFrame, dims: Sequence[str]) -> DataFrame:
    """Violations by level, by rule and by each single dimension, in one grouping-sets pass: (level, rule, dims..., n)."""
    cols = ["level", "rule", *dims]
    sets = ", ".join(f"({c})" for c in cols)
    v.createOrReplaceTempView("_loomspan_violations")
    return v.sparkSession.sql(f"select {', '.join(cols)}, count(*) as n from _loomspan_violations group by grouping sets ({sets})")


def systemic(v: DataFrame, dim: str, share: float = 0.5, least: int = 20) -> DataFrame:
    """Rules of which one value of `dim` has at least `share` of all hits."""
    g = v.groupBy("rule", dim).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy("rule")
    return g.withColumn("total", F.sum("n").over(w)).where((F.col("total") >= least) & (F.col("n") >= share * F.col("total"))).select("rule", dim, "n", "total")


def verdict(v: DataFrame, n_rows: int, error_share: float = 0.01) -> DataFrame:
    """PASS, DEGRADED or FAIL: any fatal or too many erroneous fails, any error degrades."""
    g = v.agg(F.sum((F.col("level") == FATAL).cast("long")).alias("fatal"), F.sum((F.col("level") == ERROR).cast("long")).alias("error"), F.sum((F.col("level") == WARNING).cast("long")).alias("warning"))
    g = g.select(*[F.coalesce(c, F.lit(0)).alias(c) for c in ("fatal", "error", "warning")])
    rate = F.col("error") / max(n_rows, 1)
    return g.withColumn("error_rate", rate).withColumn("status", F.when((F.col("fatal") > 0) | (rate > error_share), "FAIL").when(F.col("error") > 0, "DEGRADED").otherwise("PASS"))


def repair(df: DataFrame, order: Sequence[str], code: str = "code", date: str = "date") -> DataFrame:
    """The latest row of each key, with NaN as null."""
    d = df.withColumns({c: F.when(~F.isnan(c), F.col(c)) for c, t in df.dtypes if t in ("double", "float")})
    rest = [c for c in d.columns if c not in (code, date)]
    best = F.max(F.struct(*order, *[c for c in rest if c not in order])).alias("_b")
    return d.groupBy(code, date).agg(best).select(code, date, *[F.col(f"_b.{c}").alias(c) for c in rest])


def split(df: DataFrame, v: DataFrame, key: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(clean, quarantined) by fatal and error violations."""
    bad = v.where(F.col("level").isin(FATAL, ERROR)).select(*key).distinct()
    return df.join(bad, list(key), "left_anti"), df.join(bad, list(key), "left_semi")


def completeness(df: DataFrame, expected: DataFrame, date: str = "date") -> DataFrame:
    """Rows there and rows expected per day."""
    have = df.groupBy(date).agg(F.count(F.lit(1)).alias("actual"))
    want = expected.groupBy(date).agg(F.count(F.lit(1)).alias("expected"))
    return want.join(have, date, "full").select(date, F.coalesce("expected", F.lit(0)).alias("expected"), F.coalesce("actual", F.lit(0)).alias("actual")).withColumn("coverage", F.when(F.col("expected") > 0, F.col("actual") / F.col("expected")))


def derive_daily(df: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """pre_close in ex-right terms (half-up cents), change and pct_chg from close and adj_factor."""
    w = Window.partitionBy(code).orderBy(date)
    pre = F.lag("close").over(w) * F.lag("adj_factor").over(w) / F.nullif(F.col("adj_factor"), F.lit(0.0))
    d = df.withColumn("pre_close", F.floor(pre * 100 + 0.5) / 100)
    return d.withColumn("change", F.round(F.col("close") - F.col("pre_close"), 4)).withColumn("pct_chg", F.round(F.col("change") / F.nullif(F.col("pre_close"), F.lit(0.0)) * 100, 4))


def price_limits(df: DataFrame, bands: Mapping[str, int], board: Column, free_days: int = 5, code: str = "code", date: str = "date") -> DataFrame:
    """up_limit and down_limit in integer cents, half up; bands: board -> percent; the first `free_days` rows of a code have none."""
    w = Window.partitionBy(code).orderBy(date)
    pct = F.lit(None).cast("int")
    for b, p in bands.items():
        pct = F.when(board == b, F.lit(p)).otherwise(pct)
    cents = F.round(F.col("pre_close") * 100).cast("long")
    lim = lambda s: F.floor((cents * (100 + s * pct) + 50) / 100) / 100.0
    free = F.row_number().over(w) <= free_days
    return df.withColumn("up_limit", F.when(~free, lim(1))).withColumn("down_limit", F.when(~free, lim(-1)))


def gaps(df: DataFrame, days: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """Runs of market days without a row between a code's rows: (code, first, last, n)."""
    idx = days.select(F.col("date").alias(date)).distinct().withColumn("_i", F.row_number().over(Window.orderBy(date)))
    w = Window.partitionBy(code).orderBy("_i")
    d = df.select(code, date).distinct().join(F.broadcast(idx), date).withColumn("_n", F.lead("_i").over(w)).withColumn("_to", F.lead(date).over(w))
    return d.where(F.col("_n") > F.col("_i") + 1).select(code, F.col(date).alias("after"), F.col("_to").alias("before"), (F.col("_n") - F.col("_i") - 1).alias("n_missing"))


def check_key(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """Keys that come more than once, with how many distinct payloads they carry."""
    rest = [c for c in df.columns if c not in key]
    return df.groupBy(*key).agg(F.count(F.lit(1)).alias("n"), F.count_distinct(F.struct(*rest)).alias("payloads")).where("n > 1")


def compare_ohlc(a: DataFrame, b: DataFrame, key: Sequence[str], tolerance: float = 0.005, names: tuple[str, str] = ("a", "b")) -> DataFrame:
    from loomspan.operators import reconcile

    return reconcile.compare(a, b, key, ["open", "high", "low", "close"], tolerance, names=names)


def drift(old: DataFrame, new: DataFrame, cols: Sequence[str], bins: int = 10) -> DataFrame:
    """Population stability index of each column between two loads, over the old load's quantile bins."""
    cuts = old.agg(*[F.percentile_approx(c, F.array(*[F.lit(i / bins) for i in range(1, bins)]), 10_000).alias(c) for c in cols]).first()
    out = None
    for c in cols:
        b = F.lit(0)
        for q in cuts[c] or []:
            b = b + F.when(F.col(c) > q, 1).otherwise(0)
        side = lambda d, n: d.where(F.col(c).isNotNull()).groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias(n))  # noqa: B023, E731
        j = side(old, "o").join(side(new, "w"), "bin", "full").fillna(0, ["o", "w"])
        tot = j.agg(F.sum("o").alias("to"), F.sum("w").alias("tw"))
        p, q = F.greatest(F.col("o") / F.col("to"), F.lit(1e-6)), F.greatest(F.col("w") / F.col("tw"), F.lit(1e-6))
        one = j.join(F.broadcast(tot), F.lit(True)).agg(F.lit(c).alias("field"), F.sum((q - p) * F.log(q / p)).alias("psi"))
        out = one if out is None else out.unionByName(one)
    return out


def classify_missing(df: DataFrame, listing: DataFrame, days: DataFrame, code: str = "code", date: str = "date") -> DataFrame:
    """Why a market day has no row of a code: before_listing, after_delisting, terminal (never traded again) or gap."""
    from loomspan.operators.panel import skeleton

    span = listing.select(F.col(code).alias("code"), F.lit("1900-01-01").cast("date").alias("first"), F.lit(None).cast("date").alias("last"))
    sk = skeleton(days, span).join(df.select(F.col(code).alias("code"), F.col(date).alias("date")).distinct().withColumn("_have", F.lit(1)), ["code", "date"], "left").where("_have is null").drop("_have")
    last = df.groupBy(F.col(code).alias("code")).agg(F.max(date).alias("_last"))
    j = sk.join(listing.select(F.col(code).alias("code"), "list_date", "delist_date"), "code").join(last, "code", "left")
    why = F.when(F.col("list_date").isNotNull() & (F.col("date") < F.col("list_date")), "before_listing").when(F.col("delist_date").isNotNull() & (F.col("date") >= F.col("delist_date")), "after_delisting").when(F.col("_last").isNull() | (F.col("date") > F.col("_last")), "terminal").otherwise("gap")
    return j.select("code", "date", why.alias("cause"))
