"""Quantities recorded in different units, brought to a common one.

A unit is the hidden state of a device (an entity as reported by one source):
a hidden Markov model whose Viterbi scores explain the device's log-values by
jumps of known size against the entity's smooth level. Two quantities that are
tied by a product (amount = volume x price) are decoded together, so that a
unit of one that is odd for its level must also fit the other. A unit named in
the row's own text fixes the state; a declaration for the source is a prior.

Text is parsed in SQL, each remark by one pattern a quantity. The chains run in
`series.by_series`: over one representative a device and day, each row then being judged by its
own emission under the scores of its day, wherever the row is processed.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import cached_property

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.operators.series import Arrays, by_series, runs

# Unit words and the factor to the common unit as a power of ten.
VOLUME_WORDS = {"x10000 sh": 4, "10k sh": 4, "wan shares": 4, "万股": 4, "x100 sh": 2, "lots of 100": 2, "lots": 2, "hands": 2, "手": 2, "single shares": 0, "shares": 0, "sh": 0, "股": 0}
AMOUNT_WORDS = {
    "x1e8 cny": 8, "100m cny": 8, "yi yuan": 8, "亿元": 8, "mn cny": 6, "million yuan": 6, "百万元": 6, "x10000 cny": 4, "10k cny": 4, "wan yuan": 4, "万元": 4,
    "kcny": 3, "thousand yuan": 3, "rmb '000": 3, "千元": 3, "rmb 1": 0, "cny": 0, "rmb": 0, "yuan": 0, "元": 0,
}
VALUE_WORDS = {"100m cny": 4, "亿元": 4, "亿": 4, "mn cny": 2, "百万元": 2, "百万": 2, "10k cny": 0, "万元": 0, "万": 0, "cny": -4, "yuan": -4, "元": -4}
# States of the chain: every power that a unit word has.
VOLUME_UNITS, AMOUNT_UNITS, VALUE_UNITS = (0, 2, 4), (0, 3, 4, 6, 8), (0, 2, 4, -4)


# What may stand before a unit word that names a unit, and after it.
_BEFORE = r"(?:[=:：(（|/、;,，]|\b(?:in|as|said|says|is|are|and|units?|vol|volume|qty|quantity|amt|amount|turnover|value|mv|total_mv|v|a)\b|单位|成交量|成交额|市值|[量额按为是和])\s*"
_AFTER = r"(?=\s*(?:$|[;,，|/)）、。.]|(?:and|by|per|for)\b|和|\b(?:vol|volume|qty|quantity|amt|amount|turnover|value|v|a)\b\s*[=:：(]?|成交|量|额))"


def _alt(words: dict[str, int]) -> str:
    return "|".join(sorted(words, key=len, reverse=True))


def _power(word: Column, words: dict[str, int]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in words.items() for x in kv]), word)


def _named(remark: Column, words: dict[str, int], others: Sequence[dict[str, int]] = ()) -> Column:
    """A unit word counts where the remark says that it is one: after a quantity, a preposition, a colon or the like
    and before the end, a separator or the next quantity; or where the remark consists of unit words alone."""
    mine, every = _alt(words), "|".join([_alt(words), *map(_alt, others)])
    alone = rf"^(?:(?:{every})\s*(?:[/、,，;]|and\b|和)\s*)*({mine})(?=(?:\s*(?:[/、,，;]|and\b|和)\s*(?:{every}))*$)"
    m = F.regexp_extract(F.lower(F.trim(remark)), rf"{_BEFORE}({mine}){_AFTER}|{alone}", 0)
    # the match without what stands before it
    return _power(F.regexp_extract(m, rf"({mine})$", 1), words)


def named_volume(remark: Column) -> Column:
    """The power of ten of the volume unit that a remark names; null if it names none: "a lot of revisions" or "shares desk on leave"."""
    return _named(remark, VOLUME_WORDS, (AMOUNT_WORDS,))


def named_amount(remark: Column) -> Column:
    """The power of ten of the amount unit that a remark names; null if none."""
    return _named(remark, AMOUNT_WORDS, (VOLUME_WORDS,))


def named_value(remark: Column) -> Column:
    """The power of ten (to units of 10,000) of the market-value unit a remark names."""
    return _named(remark, VALUE_WORDS)


def declared(word: Column, words: dict[str, int]) -> Column:
    return _power(F.lower(F.trim(word)), words)


def parse_value_text(text: Column) -> tuple[Column, Column]:
    """(number, power of ten of its unit or null) of a market value in words: 约1.2亿, CNY 0.09bn, 1,048.5mn."""
    t = F.lower(F.trim(text))
    number = F.regexp_replace(F.regexp_extract(t, r"([0-9][0-9,]*(?:\.[0-9]+)?(?:e[+-]?[0-9]+)?)", 1), ",", "")
    number = F.when(number != "", number.cast("double"))
    unit = F.regexp_extract(t, r"[0-9](?:e[+-]?[0-9]+)?\s*(100m cny|10k cny|mn cny|百万元|百万|亿元|亿|万元|万|元|cny|yuan|mn|bn)$", 1)
    power = F.when(unit == "bn", 5).when(unit == "mn", 2).otherwise(_power(unit, VALUE_WORDS))
    return number, power


def with_feeds(df: DataFrame, feeds: DataFrame, source: str, day: str, columns: dict[str, dict[str, int]], max_feeds: int = 100_000) -> DataFrame:
    """Adds decl_<column>: the declared power of ten for the row's source and day; null where none is.

    Declarations that overlap: the one that starts last. At most `max_feeds`
    declarations are broadcast; more are joined by shuffle.
    """
    k = feeds.select(F.col(source).alias("_s"), F.col("valid_from").alias("_from"), F.col("valid_to").alias("_to"), *[declared(F.col(c), w).alias(f"decl_{c}") for c, w in columns.items()])
    n = k.limit(max_feeds + 1).count()
    # one row per source: its declarations as a sorted array, so that rows are never multiplied
    per = k.groupBy("_s").agg(F.sort_array(F.collect_list(F.struct("_from", "_to", *[f"decl_{c}" for c in columns]))).alias("_ds"))
    per = F.broadcast(per) if n <= max_feeds else per
    j = df.join(per, F.col(source) == F.col("_s"), "left").drop("_s")
    hit = F.element_at(F.filter("_ds", lambda d: (d["_from"] <= F.col(day)) & (F.col(day) <= d["_to"])), -1)
    hit = F.when(F.size(F.filter("_ds", lambda d: (d["_from"] <= F.col(day)) & (F.col(day) <= d["_to"]))) > 0, hit)
    return j.withColumn("_d", hit).select(*df.columns, *[F.col(f"_d.decl_{c}").alias(f"decl_{c}") for c in columns])


def smooth_level(group: np.ndarray, value: np.ndarray, half: int = 10) -> np.ndarray:
    """Per row the median of the known values of its group within +-half rows; the group's median where those are few, NaN where none is known."""
    out = np.full(len(value), np.nan)
    if not len(value):
        return out
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    ends = np.r_[starts[1:], len(group)]
    for s, e in zip(starts, ends, strict=True):
        v = value[s:e]
        ok = np.flatnonzero(~np.isnan(v))
        if not len(ok):
            continue
        mid = np.median(v[ok])
        k = 2 * half + 1
        if len(ok) < k:
            out[s:e] = mid
            continue
        med = np.median(np.lib.stride_tricks.sliding_window_view(v[ok], k), axis=1)
        pos = np.clip(np.searchsorted(ok, np.arange(e - s)) - half, 0, len(med) - 1)
        out[s:e] = med[pos]
    return out


def viterbi_scores(dev: np.ndarray, emit: np.ndarray, change: float) -> np.ndarray:
    """Viterbi in both directions: [n, states], the score of the best path of the row's chain through each state, without the
    row's own emission.

    Chains are runs of equal `dev`; `emit` [n, states] log-likelihoods; a change of state costs
    `change`. The state with the greatest score plus own emission is that of the best path. All chains of a
    block step together, so the Python loop is as long as the longest chain only.
    """
    n, s = emit.shape
    out = np.zeros((n, s))
    if not n:
        return out
    starts, length = runs(dev)
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    for first, step in ((starts, 1), (starts + length - 1, -1)):
        score = emit[first].copy()
        for t in range(1, int(length[0])):
            k = int(np.searchsorted(-length, -t, side="left"))  # chains longer than t
            got = np.maximum(score[:k], score[:k].max(1, keepdims=True) - change)
            rows = first[:k] + step * t
            out[rows] += got
            score[:k] = got + emit[rows]
    return out


def _mix(x: np.ndarray, sd: float | np.ndarray, wide: float, heavy: float = 0.02) -> np.ndarray:
    """Log-density of a normal with a wide heavy tail; missing values say nothing."""
    with np.errstate(invalid="ignore"):
        d = (1 - heavy) * np.exp(-0.5 * (x / sd) ** 2) / sd + heavy * np.exp(-0.5 * (x / wide) ** 2) / wide + 1e-7
    return np.where(np.isnan(x), 0.0, np.log(d))


def _prior(hint: np.ndarray, decl: np.ndarray, units: Sequence[int], against: float = 3.0) -> np.ndarray:
    """Log-prior [n, units]: a named unit is certain, a declared one likely, else all alike.

    A named unit outside `units` leaves the state open; callers keep the hint itself.
    """
    u = np.asarray(units, float)[None, :]
    known = ~np.isnan(hint) & (hint[:, None] == u).any(1)
    p = np.where(np.isnan(decl)[:, None] | (decl[:, None] == u), 0.0, -against)
    return np.where(known[:, None], np.where(hint[:, None] == u, 0.0, -1e6), p)


def _log10(x: np.ndarray) -> np.ndarray:
    with np.errstate(invalid="ignore", divide="ignore"):
        return np.where((x > 0) & (x < np.inf), np.log10(x), np.nan)


class Pair:
    """Volume and amount, tied by the price. States are pairs of powers of ten: the amount's units within the volume's."""

    states = np.array([(v, a) for v in VOLUME_UNITS for a in AMOUNT_UNITS], float)
    half = 10
    fv, fa = states[:, 0], states[:, 1]
    nv, na = len(VOLUME_UNITS), len(AMOUNT_UNITS)

    def __init__(self, a: Arrays):
        o, c = a["open"], a["close"]
        self.lv, self.la = _log10(a["vol"]), _log10(a["amount"])
        self.lp = _log10((np.where(np.isnan(o), c, o) + np.where(np.isnan(c), o, c)) / 2)
        self.hv, self.ha, self.dv, self.da = a["hv"], a["ha"], a["dv"], a["da"]
        self.said = np.where(~np.isnan(self.hv), self.hv, self.dv), np.where(~np.isnan(self.ha), self.ha, self.da)
        self.sd = np.clip(1.5 * np.where(np.isnan(a["sa"]), 0.07, a["sa"]), 0.002, 0.15)[:, None]
        self.alone = np.flatnonzero(np.isnan(self.lv) & ~np.isnan(self.la))

    @cached_property
    def fixed(self) -> np.ndarray:
        """What of the log-likelihoods does not depend on the level."""
        e = _mix((self.la - self.lv - self.lp)[:, None] + (self.fa - self.fv), self.sd, 0.7)
        e += np.repeat(_prior(self.hv, self.dv, VOLUME_UNITS), self.na, axis=1)
        e += np.tile(_prior(self.ha, self.da, AMOUNT_UNITS), (1, self.nv))
        return e

    def lead(self, state: np.ndarray | None = None) -> np.ndarray:
        """log10 of the volume in common units, as text and declarations have it or as decoded; the amount over the price stands in for it."""
        v, a = self.said if state is None else (self.fv[state], self.fa[state])
        x = self.lv + v
        return np.where(np.isnan(x), self.la + a - self.lp, x)

    def emit(self, level: np.ndarray) -> np.ndarray:
        e = self.fixed + np.repeat(_mix((self.lv - level)[:, None] + np.array(VOLUME_UNITS, float), 0.35, 1.0), self.na, axis=1)
        if len(k := self.alone):
            e[k] += np.tile(_mix((self.la[k] - self.lp[k] - level[k])[:, None] + np.array(AMOUNT_UNITS, float), 0.35, 1.0), (1, self.nv))
        return e

    def powers(self, state: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.where(np.isnan(self.hv), self.fv[state], self.hv), np.where(np.isnan(self.ha), self.fa[state], self.ha)


class Single:
    """One quantity."""

    states = np.array([(u,) for u in VALUE_UNITS], float)
    half = 4

    def __init__(self, a: Arrays):
        self.f = self.states[:, 0]
        self.lx, self.hint = _log10(a["x"]), a["hint"]
        self.prior = _prior(self.hint, a["decl"], VALUE_UNITS)
        self.said = np.where(~np.isnan(self.hint), self.hint, a["decl"])

    def lead(self, state: np.ndarray | None = None) -> np.ndarray:
        return self.lx + (self.said if state is None else self.f[state])

    def emit(self, level: np.ndarray) -> np.ndarray:
        return self.prior + _mix(self.lx[:, None] + self.f - level[:, None], 0.3, 1.0)

    def powers(self, state: np.ndarray) -> tuple[np.ndarray]:
        return (np.where(np.isnan(self.hint), self.f[state], self.hint),)


def unit_messages(m: Pair | Single, a: Arrays) -> np.ndarray:
    """[n, states + 1]: Viterbi scores of each representative's states without its own emission, and its entity's level.

    `a` is sorted by entity, day and source. The level starts from what text and declarations say and is
    taken once more from the decoded values.
    """
    n = len(a["ent"])
    by_dev = np.lexsort((np.arange(n), a["src"], a["ent"]))
    e0, s0 = a["ent"][by_dev], a["src"][by_dev]
    dev = np.cumsum(np.r_[True, (e0[1:] != e0[:-1]) | (s0[1:] != s0[:-1])]) if n else e0
    lead, out = m.lead(), np.zeros((n, len(m.states) + 1))
    for _ in range(2):
        out[:, -1] = smooth_level(a["ent"], lead, m.half)
        e = m.emit(out[:, -1])
        out[by_dev, :-1] = viterbi_scores(dev, e[by_dev], 1.0)
        lead = m.lead((out[:, :-1] + e).argmax(1))
    return out


def decode(m: Pair | Single, msg: np.ndarray) -> tuple[np.ndarray, ...]:
    """Powers of ten of each row by its own emission under its day's scores."""
    return m.powers((msg[:, :-1] + m.emit(msg[:, -1])).argmax(1))


def daily_readings(daily: DataFrame, feeds: DataFrame) -> DataFrame:
    """What the chain needs of `daily`: ids, numbers, named and declared units. One pass, no text leaves the JVM."""
    d = with_feeds(daily, feeds, "src", "trade_date", {"vol_unit": VOLUME_WORDS, "amount_unit": AMOUNT_WORDS})
    return d.select(
        "row_id", "ts_code", F.datediff("trade_date", F.lit("1970-01-01")).alias("_day"), F.coalesce("src", F.lit("")).alias("src"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("_at"), "vol", "amount", "open", "high", "low", "close",
        named_volume(F.col("remark")).cast("float").alias("hv"), named_amount(F.col("remark")).cast("float").alias("ha"),
        F.col("decl_vol_unit").cast("float").alias("dv"), F.col("decl_amount_unit").cast("float").alias("da"),
    )


def named_units(daily: DataFrame) -> DataFrame:
    """(remark, n, vol_power, amount_power): each remark, how many rows have it and which units it was read to name; null: none."""
    n = daily.groupBy("remark").agg(F.count(F.lit(1)).alias("n"))
    return n.select("remark", "n", named_volume(F.col("remark")).alias("vol_power"), named_amount(F.col("remark")).alias("amount_power"))


BINS = 25  # a unit of log deviation: bins are 4 % wide


def fit_normal(x: np.ndarray, n: np.ndarray, broad: float = 0.1, rounds: int = 60) -> tuple[float, float]:
    """(deviation, share of the broad part) of absolute deviations x with counts n, by expectation maximisation.

    A half-normal with a broad component of constant density: what a source usually shows and its spikes.
    """
    if not n.sum():
        return float("nan"), float("nan")
    o = np.argsort(x)
    half = x[o][np.searchsorted(np.cumsum(n[o]), n.sum() / 2)]
    sd, rate = max(1.4826 * half, 1e-6), 0.01
    for _ in range(rounds):
        norm = (1 - rate) * 0.7978846 / sd * np.exp(-0.5 * np.minimum((x / sd) ** 2, 1400.0))
        r = rate * broad / (rate * broad + norm + 1e-300)
        w = n * (1 - r)
        if w.sum() <= 0:
            break
        rate, sd = min(float((n * r).sum() / n.sum()), 0.5), max(float(np.sqrt((w * x * x).sum() / w.sum())), 1e-6)
    return sd, rate


def source_noise(readings: DataFrame, fields: str = "ahlc", max_sources: int = 100_000) -> tuple[DataFrame, bool]:
    """What each source usually shows, and whether the table is small enough to broadcast (at most `max_sources` sources).

    sa, pa: deviation of amount from volume x price, log10, and the share of spikes among those; sh, ph and sl, pl: of high and low
    beyond open and close, natural log; sc, pc: of close from open; po: the share of readings that break a hard bound. All readings count of
    which the unit is named or declared (for sa). `fields`: which of a, h, l and c are wanted; the others are null. Deviations are counted in bins per source, combined map-side, and each source is
    fitted on its counts (`fit_normal`), so a source of any size is safe.
    """
    logs = lambda c: F.when((c > 0) & (c < float("inf")), F.ln(c))
    price = (F.coalesce("open", "close") + F.coalesce("close", "open")) / 2
    top, low = F.greatest("open", "close"), F.least("open", "close")
    # each logarithm is taken once: a projection is not merged into one that uses it twice
    r = readings.where("vol > 0").select(
        "src", (logs(F.col("amount")) - logs(F.col("vol")) - logs(price)).alias("p"), (F.coalesce("ha", "da") - F.coalesce("hv", "dv")).alias("u"), "high", "low", "amount", "open", "close", top.alias("top"), low.alias("bot"),
    )
    broken = (F.col("high") < F.col("top") - 1e-9) | (F.col("high") <= 0) | (F.col("low") > F.col("bot") + 1e-9) | (F.col("low") <= 0) | (F.col("amount") <= 0)
    ratio = lambda c, d: logs(F.col(c) / F.when(F.col(d) > 0, F.col(d)))
    devs = {"a": F.abs(F.col("p") / 2.302585092994046 + F.col("u")), "h": ratio("high", "top"), "l": ratio("bot", "low"), "c": F.abs(ratio("close", "open"))}
    r = r.select("src", *[devs[k].alias(k) for k in fields], *([F.when(broken, 1).otherwise(0).alias("o")] if "h" in fields else []))
    usable = {"a": F.col("a") < 0.5, "h": F.col("h") >= 0, "l": F.col("l") >= 0, "c": F.lit(True)}
    bins = {k: F.when(usable[k], F.floor(F.ln(F.greatest(F.col(k), F.when(F.col(k).isNotNull(), F.lit(1e-9)))) * BINS)) for k in fields} | ({"o": F.col("o")} if "h" in fields else {})
    cells = r.select("src", F.explode(F.array(*[F.struct(F.lit(k).alias("f"), v.cast("int").alias("bin")) for k, v in bins.items()])).alias("c")).select("src", "c.*")
    hist = cells.where("bin is not null").groupBy("src", "f", "bin").agg(F.count(F.lit(1)).alias("n"))
    names = [("sa", "pa"), ("sh", "ph"), ("sl", "pl"), ("sc", "pc")]

    def fit(g: pd.DataFrame) -> pd.DataFrame:
        out = {"_s": g["src"].iloc[0]}
        for k, (s, p) in zip("ahlc", names, strict=True):
            b = g[g["f"] == k]
            out[s], out[p] = fit_normal(np.exp((b["bin"].to_numpy() + 0.5) / BINS), b["n"].to_numpy(dtype=np.float64))
        o = g[g["f"] == "o"]
        out["po"] = float(o["n"][o["bin"] == 1].sum() / max(o["n"].sum(), 1))
        return pd.DataFrame([out])

    fitted = hist.groupBy("src").applyInPandas(fit, "_s string, " + ", ".join(f"{x} double" for sp in names for x in sp) + ", po double")
    rows = fitted.limit(max_sources + 1).collect()
    if len(rows) > max_sources:
        return fitted, False
    return F.broadcast(readings.sparkSession.createDataFrame(rows, fitted.schema)), True


def common_units_daily(daily: DataFrame, feeds: DataFrame, floor: int = 200_000) -> DataFrame:
    """Rows of `daily` as (row_id, vol_power, amount_power, vol_shares, amount_yuan).

    powers: of ten, from the stored unit to the common one; null where the
    value is null, 0 or not finite (then the common value is the stored one).
    Every row comes back once, repeats too. Rows without a code are one more series, without a day
    the earliest day. `floor`: see `by_series`; it changes where rows are processed, never the result.
    """
    r = daily_readings(daily, feeds)
    noise, small = source_noise(r, "a")
    r = r.drop("high", "low")
    side = (noise.select("_s", "sa"), small)

    def judge(a: Arrays, msg: np.ndarray) -> pd.DataFrame:
        vp, ap = decode(Pair(a), msg)
        return pd.DataFrame({"row_id": a["row_id"], "vol": a["vol"], "amount": a["amount"], "vp": vp, "ap": ap})

    out = by_series(r, lambda a: unit_messages(Pair(a), a), len(Pair.states) + 1, judge, "row_id long, vol double, amount double, vp double, ap double", floor, side)
    nn = lambda c: F.when(~F.isnan(c), F.col(c))
    v, a = nn("vol"), nn("amount")
    has = lambda c: c.isNotNull() & (c != 0) & (F.abs(c) < float("inf"))
    vp, ap = F.when(has(v), F.col("vp").cast("int")), F.when(has(a), F.col("ap").cast("int"))
    return out.select("row_id", vp.alias("vol_power"), ap.alias("amount_power"), (v * F.pow(F.lit(10.0), F.coalesce(vp, F.lit(0)))).alias("vol_shares"), (a * F.pow(F.lit(10.0), F.coalesce(ap, F.lit(0)))).alias("amount_yuan"))


def common_units_value(basic: DataFrame, feeds: DataFrame, floor: int = 200_000) -> DataFrame:
    """Rows of `daily_basic` as (row_id, mv_power, total_mv_10k): total_mv, or the number in its text, in units of 10,000."""
    num, power = parse_value_text(F.col("total_mv_text"))
    d = with_feeds(basic, feeds, "src", "trade_date", {"mv_unit": VALUE_WORDS})
    stored = F.when(F.col("total_mv").isNotNull() & ~F.isnan("total_mv"), F.col("total_mv"))
    r = d.select(
        "row_id", "ts_code", F.datediff("trade_date", F.lit("1970-01-01")).alias("_day"), F.coalesce("src", F.lit("")).alias("src"), F.unix_micros(F.col("loaded_at").cast("timestamp")).alias("_at"),
        F.coalesce(stored, num).alias("x"),
        F.coalesce(F.when(stored.isNull(), power), named_value(F.col("remark"))).cast("float").alias("hint"),
        F.col("decl_mv_unit").cast("float").alias("decl"),
    )

    def judge(a: Arrays, msg: np.ndarray) -> pd.DataFrame:
        (p,) = decode(Single(a), msg)
        return pd.DataFrame({"row_id": a["row_id"], "x": a["x"], "p": p})

    out = by_series(r, lambda a: unit_messages(Single(a), a), len(Single.states) + 1, judge, "row_id long, x double, p double", floor)
    x = F.when(~F.isnan("x"), F.col("x"))
    p = F.when(x.isNotNull() & (x != 0) & (F.abs(x) < float("inf")), F.col("p").cast("int"))
    return out.select("row_id", p.alias("mv_power"), (x * F.pow(F.lit(10.0), F.coalesce(p, F.lit(0)))).alias("total_mv_10k"))
