"""Column-level data-quality profile by character-class masks.

Every value of every profiled column becomes a mask, its generalised form. A
text keeps its character classes and their run lengths; a number its sign,
decimal magnitude and three leading digits. Masks are counted per load and
field, combined map-side: the counts are all that is shuffled, and their number
is bounded by the masks, not by the rows. Each mask is then generalised step by
step up to its mere class (`LEVELS`), dominant patterns are mined per segment,
and a load is held, at every level, against the segment's other loads: by the
divergence of its mask distribution and by the share of its values under masks
that are rare there. How far loads of the segment usually are from each other sets
the limit. Null, NaN, infinity and zero are masks like any other.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

NULL_MASK, NAN_MASK = "<null>", "<nan>"
#: level -> least divergence (bits) beyond the segment's usual one that counts. Numbers: class, magnitude,
#: one, two, three leading digits; texts: class, classes without run lengths, with run lengths.
NUMBER_LEVELS = (0.09, 0.13, 0.2, 0.235, 0.23)
TEXT_LEVELS = (0.09, 0.13, 0.13)
LONG_TEXT = 64
#: these differences hold for loads of so many rows and more; below, they grow with the chance deviation, sqrt(FEW_ROWS / rows)
FEW_ROWS = 30


def text_mask(c: Column) -> Column:
    """Character classes: upper A, lower a, digit 9, other letters W; others stay; runs keep their length.

    A text of more than LONG_TEXT characters is masked by the classes it has and the
    binary magnitude of its length, so free text has few masks. Empty texts are <empty>.
    """
    m = F.regexp_replace(c, r"[0-9]", "9")
    m = F.regexp_replace(m, r"\p{Lu}", "A")
    m = F.regexp_replace(m, r"\p{Ll}", "a")
    m = F.regexp_replace(m, r"[\p{Lo}]", "W")
    has = F.concat(*[F.when(c.rlike(p), k).otherwise("") for p, k in ((r"\p{Lu}", "A"), (r"\p{Ll}", "a"), (r"[0-9]", "9"), (r"\p{Lo}", "W"))])
    long = F.concat(F.lit("<long "), has, F.lit(" 2^"), F.floor(F.log2(F.length(c))).cast("string"), F.lit(">"))
    return F.when(c.isNull(), NULL_MASK).when(c == "", "<empty>").when(F.length(c) > LONG_TEXT, long).otherwise(m)


def number_mask(c: Column) -> Column:
    """Sign, three leading digits and decimal magnitude of a number: 0, +1.25e2, -2.00e-3, <nan>, +<inf>, +<tiny> (below 1e-290).

    A number within 1e-9 of the next three digits has those, so 0.98 is +9.80e-1 however it is stored.
    """
    x = c.cast("double")
    a = F.abs(x)
    pos = F.when((a >= 1e-290) & (a < float("inf")), a)
    e = F.floor(F.log10(pos)).cast("int")
    d = F.floor(pos / F.pow(F.lit(10.0), (e - 2).cast("double")) * (1 + 1e-9)).cast("int")
    e, d = F.when(d >= 1000, e + 1).when(d < 100, e - 1).otherwise(e), F.when(d >= 1000, F.floor(d / 10).cast("int")).when(d < 100, 999).otherwise(d)
    s, sign = d.cast("string"), F.when(x < 0, "-").otherwise("+")
    return (
        F.when(x.isNull(), NULL_MASK)
        .when(F.isnan(x), NAN_MASK)
        .when(a == float("inf"), F.concat(sign, F.lit("<inf>")))
        .when(x == 0, "0")
        .when(a < 1e-290, F.concat(sign, F.lit("<tiny>")))
        .otherwise(F.concat(sign, F.substring(s, 1, 1), F.lit("."), F.substring(s, 2, 2), F.lit("e"), e.cast("string")))
    )


def number_levels(m: Column) -> list[Column]:
    """The mask of a number from its class up to three leading digits."""
    plain = ~m.contains("e") | m.contains("<")
    tail = F.substring(m, 6, 9)
    return [F.when(plain, m).otherwise(c) for c in (F.substring(m, 1, 1), F.concat(F.substring(m, 1, 1), tail), F.concat(F.substring(m, 1, 2), tail), F.concat(F.substring(m, 1, 4), tail), m)]


def text_levels(m: Column) -> list[Column]:
    """The mask of a text from its class up to its run lengths."""
    special = m.isin(NULL_MASK, "<empty>")
    runs = F.regexp_replace(m, r"A+", "A")
    for k in ("a", "9", "W"):
        runs = F.regexp_replace(runs, f"{k}+", k)
    return [F.when(special, m).otherwise("<text>"), F.when(m.startswith("<long "), F.regexp_replace(m, r" 2\^.*", ">")).otherwise(runs), m]


def _numeric(t: str) -> bool:
    return t in ("double", "float", "bigint", "int", "smallint", "tinyint") or t.startswith("decimal")


def mask_counts(df: DataFrame, by: Sequence[str], fields: Mapping[str, str]) -> DataFrame:
    """(by, field, num, mask, n, lo, hi): how often each mask occurs per group and field; lo and hi: its least and
    greatest finite number.

    `fields`: name -> SQL expression. Every row counts, repeats too; null groups are groups; an
    empty table gives no rows. One combined aggregation; no group is ever gathered.
    """
    kinds = dict(df.select([F.expr(e).alias(n) for n, e in fields.items()]).dtypes)
    cells = []
    for name, e in fields.items():
        v, num = F.expr(e), _numeric(kinds[name])
        x = v.cast("double") if num else F.lit(None).cast("double")
        cells.append(F.struct(F.lit(name).alias("field"), F.lit(num).alias("num"), (number_mask(v) if num else text_mask(v.cast("string"))).alias("mask"), F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).alias("x")))
    c = df.select(*[F.col(b).alias(f"_g{i}") for i, b in enumerate(by)], F.explode(F.array(*cells)).alias("c"))
    c = c.select(*[F.col(f"_g{i}").alias(b) for i, b in enumerate(by)], "c.*")
    return c.groupBy(*by, "field", "num", "mask").agg(F.count(F.lit(1)).alias("n"), F.min("x").alias("lo"), F.max("x").alias("hi"))


def statistics(counts: DataFrame, by: Sequence[str], commonest: int = 20) -> DataFrame:
    """One row per (by, field) from its mask counts: n_rows, null_share, nan_share, zero_share, neg_share, top_share (of the
    commonest mask), min, q1, med, q3, max of the finite numbers, and masks: the `commonest` masks with their shares, greatest first.

    Quartiles are read off the masks, whose numbers differ by less than 1 %: the middle of the mask in which the
    quartile falls. Texts have null for all of the numbers.
    """
    w = Window.partitionBy(*by, "field")
    up = w.orderBy(F.col("lo").asc_nulls_last(), "mask").rowsBetween(Window.unboundedPreceding, 0)
    k = F.when(F.col("lo").isNotNull(), F.col("n"))
    c = counts.withColumn("_below", F.sum(k).over(up)).withColumn("_all", F.sum(k).over(w)).withColumn("_mid", F.when(F.col("lo").isNotNull(), (F.col("lo") + F.col("hi")) / 2))
    c = c.withColumn("_rank", F.row_number().over(w.orderBy(F.desc("n"), "mask")))
    q = lambda p: F.min(F.when(F.col("_below") >= F.ceil(F.col("_all") * p), F.col("_mid")))
    part = lambda cond: F.sum(F.when(cond, F.col("n")).otherwise(0)) / F.sum("n")
    is_neg = F.col("num") & F.col("mask").startswith("-")
    g = c.groupBy(*by, "field").agg(
        F.sum("n").alias("n_rows"), part(F.col("mask") == NULL_MASK).alias("null_share"), part(F.col("num") & (F.col("mask") == NAN_MASK)).alias("nan_share"),
        part(F.col("num") & (F.col("mask") == "0")).alias("zero_share"), part(is_neg).alias("neg_share"), (F.max("n") / F.sum("n")).alias("top_share"),
        F.min("lo").alias("min"), q(0.25).alias("q1"), q(0.5).alias("med"), q(0.75).alias("q3"), F.max("hi").alias("max"),
        F.sort_array(F.collect_list(F.when(F.col("_rank") <= commonest, F.struct((-F.col("n")).alias("less"), "mask")))).alias("_m"),
    )
    return g.withColumn("masks", F.transform("_m", lambda m: F.struct(m["mask"].alias("mask"), (-m["less"] / F.col("n_rows")).alias("share")))).drop("_m")


def _levels(counts: DataFrame, *keep: str) -> DataFrame:
    """Each mask at each level of generalisation: (keep..., field, n, level, floor, mask)."""
    level = lambda cs, floors: F.array(*[F.struct(F.lit(i).alias("level"), F.lit(f).alias("floor"), c.alias("mask")) for i, (c, f) in enumerate(zip(cs, floors, strict=True))])
    up = F.when(F.col("num"), level(number_levels(F.col("mask")), NUMBER_LEVELS)).otherwise(level(text_levels(F.col("mask")), TEXT_LEVELS))
    return counts.select(*keep, "field", "n", F.explode(up).alias("_c")).select(*keep, "field", "n", "_c.level", "_c.floor", "_c.mask")


def mine_patterns(counts: DataFrame, segment: str, load: str, dominant: float = 0.02) -> DataFrame:
    """The mask counts at every level of generalisation, against the segment's other loads:
    (segment, load, field, level, floor, mask, n, share, others, dominant).

    share: in the load; others: in the segment's other loads together, null where there
    are none; dominant: others is at least `dominant`. A segment's masks are summed by a combined aggregation and
    joined back by mask, so a segment with most of the loads is no single task; only the masks of one load or of one
    segment (without its loads) share a window.
    """
    each = _levels(counts.repartition(F.col(segment), F.col(load), F.col("field")), segment, load)
    c = each.groupBy(segment, load, "field", "level", "floor", "mask").agg(F.sum("n").alias("n"))
    c = c.withColumn("_t", F.sum("n").over(Window.partitionBy(segment, load, "field", "level")))
    s = each.groupBy(segment, "field", "level", "mask").agg(F.sum("n").alias("n")).withColumn("_all", F.sum("n").over(Window.partitionBy(segment, "field", "level")))
    s = s.select(F.col(segment).alias("_g"), F.col("field").alias("_f"), F.col("level").alias("_l"), F.col("mask").alias("_m"), F.col("n").alias("_s"), "_all")
    c = c.join(s, c[segment].eqNullSafe(s["_g"]) & (c["field"] == s["_f"]) & (c["level"] == s["_l"]) & (c["mask"] == s["_m"]))
    others = F.when(F.col("_all") > F.col("_t"), (F.col("_s") - F.col("n")) / (F.col("_all") - F.col("_t")))
    c = c.withColumn("share", F.col("n") / F.col("_t")).withColumn("others", others)
    # a load of few rows strays further by chance
    c = c.withColumn("floor", F.col("floor") * F.sqrt(F.greatest(F.lit(1.0), FEW_ROWS / F.col("_t"))))
    return c.withColumn("dominant", F.col("others") >= dominant).select(segment, load, "field", "level", "floor", "mask", "n", "share", "others", "dominant")


def load_departures(counts: DataFrame, segment: str, load: str, usual: float = 4.0, rare_jump: float = 0.3, dominant: float = 0.02) -> DataFrame:
    """(segment, load, field, mask_div, rare_share, level, departs): how far each load is from the segment's others.

    At each level: the Jensen-Shannon divergence in bits of the load's masks from those of the other loads, and the
    share of its values under masks that are not dominant there. A level departs if its divergence is beyond the
    median load's by more than the level's least difference (`floor`) and `usual` robust deviations, or its rare share, at the levels
    above two digits, by more than `rare_jump` and `usual` deviations. The deviation is that of the lower half of the segment's
    loads, (median - lower quartile) / 0.6745, so that a minority of bad loads does not widen the limit. A slow drift, which all loads
    share, does not depart, nor does a field whose loads always differ. Of a load's levels the one that is furthest beyond its limit is
    reported. A segment with one load departs in nothing (mask_div and rare_share are null).
    """
    m = mine_patterns(counts, segment, load, dominant)
    x, y = F.col("share"), F.col("others")
    part = lambda v: F.when(v > 0, v * F.log2(2 * v / (x + y)) / 2).otherwise(0.0)
    g = m.groupBy(segment, load, "field", "level", "floor").agg(
        # masks that only the others have add half of their share
        F.when(F.count("others") > 0, F.sum(part(x) + part(y)) + (1 - F.sum(y)) / 2).alias("div"),
        F.when(F.count("others") > 0, F.sum(F.when(F.col("dominant"), 0.0).otherwise(x))).alias("rare"),
    )
    low = lambda c: F.percentile_approx(c, F.array(F.lit(0.25), F.lit(0.5)), 10_000)
    u = g.groupBy(F.col(segment).alias("_g"), F.col("field").alias("_f"), F.col("level").alias("_l")).agg(low("div").alias("_div"), low("rare").alias("_rare"))
    g = g.join(u, g[segment].eqNullSafe(u["_g"]) & (g["field"] == u["_f"]) & (g["level"] == u["_l"]))
    beyond = lambda c, least: F.col(c) - F.col(f"_{c}")[1] - F.greatest(least, (F.col(f"_{c}")[1] - F.col(f"_{c}")[0]) / 0.6745 * usual)
    rare = F.when(F.col("level") <= 2, beyond("rare", F.lit(rare_jump)))
    g = g.withColumn("_over", F.greatest(beyond("div", F.col("floor")), rare))
    far = F.max_by(F.struct("div", "rare", "level", "_over"), F.struct(F.coalesce("_over", F.lit(-9.0)), "level")).alias("f")
    g = g.groupBy(segment, load, "field").agg(far)
    return g.select(segment, load, "field", F.col("f.div").alias("mask_div"), F.col("f.rare").alias("rare_share"), F.col("f.level").alias("level"), F.coalesce(F.col("f._over") > 0, F.lit(False)).alias("departs"))


def distinct_counts(df: DataFrame, by: Sequence[str], fields: Mapping[str, str], rsd: float = 0.02) -> DataFrame:
    """(by, field, n_distinct): about how many values each field has per group (HyperLogLog, relative deviation `rsd`).

    One combined aggregation with a fixed state per group and field, whatever the values. Nulls are no value.
    """
    g = df.groupBy(*by).agg(*[F.approx_count_distinct(F.expr(e), rsd).alias(f"_d{i}") for i, e in enumerate(fields.values())])
    return g.select(*by, F.explode(F.array(*[F.struct(F.lit(n).alias("field"), F.col(f"_d{i}").alias("n_distinct")) for i, n in enumerate(fields)])).alias("c")).select(*by, "c.*")


def profile_columns(df: DataFrame, segment: str, load: str, fields: Mapping[str, str]) -> DataFrame:
    """`statistics` and `load_departures` of each (segment, load, field): one row each."""
    counts = mask_counts(df, [segment, load], fields)
    s, d = statistics(counts, [segment, load]), load_departures(counts, segment, load)
    d = d.select(F.col(segment).alias("_s"), F.col(load).alias("_l"), F.col("field").alias("_f"), "mask_div", "rare_share", "level", "departs")
    return s.join(d, s[segment].eqNullSafe(d["_s"]) & s[load].eqNullSafe(d["_l"]) & (s["field"] == d["_f"])).drop("_s", "_l", "_f")
