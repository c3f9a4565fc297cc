import datetime as dt
import random

import numpy as np
from pyspark.sql import functions as F

from loomspan.operators import units

DAILY = "row_id long, ts_code string, trade_date date, open double, high double, low double, close double, vol double, amount double, src string, remark string, loaded_at timestamp"
FEEDS = "src string, valid_from date, valid_to date, vol_unit string, amount_unit string, mv_unit string"
D = lambda i: dt.date(2025, 1, 1) + dt.timedelta(days=i)


def feeds(spark):
    return spark.createDataFrame([("good", D(0), D(400), "股", "元", "万元"), ("lots", D(0), D(400), "手", "千元", "亿元"), ("none", D(0), D(400), None, None, None)], FEEDS)


def rows(seed=0, n=120):
    rnd = random.Random(seed)
    out, truth = [], {}
    for c in range(4):
        level = 10 ** rnd.uniform(5, 7)
        for i in range(n):
            p, v = 20 + rnd.random(), level * float(np.exp(rnd.gauss(0, 0.3)))
            src = rnd.choice(["good", "good", "lots", "none"])
            vp, ap = {"good": (0, 0), "lots": (2, 3), "none": rnd.choice([(0, 0), (4, 4), (2, 0), (0, 8)])}[src]
            remark = None
            if src == "good" and rnd.random() < 0.1:
                vp, ap = rnd.choice([(0, 4), (2, 0), (4, 0), (0, 3)])
            if rnd.random() < 0.1:
                vp, remark = 4, "vol in wan shares"
            k = len(out)
            truth[k] = (vp, ap)
            out.append((k, f"00000{c}.SZ", D(i), p, p * 1.01, p * 0.99, p, v / 10.0**vp, v * p / 10.0**ap, src, remark, dt.datetime(2025, 1, 1)))
    return out, truth


def test_decodes_silent_rows(spark):
    r, truth = rows()
    got = {x["row_id"]: (x["vol_power"], x["amount_power"]) for x in units.common_units_daily(spark.createDataFrame(r, DAILY), feeds(spark)).collect()}
    assert got == truth


def test_every_named_power_is_a_state(spark):
    assert set(units.AMOUNT_UNITS) == set(units.AMOUNT_WORDS.values()) and set(units.VOLUME_UNITS) == set(units.VOLUME_WORDS.values()) and set(units.VALUE_UNITS) == set(units.VALUE_WORDS.values())
    r, truth = rows(3, 60)
    for k in range(0, len(r), 3):  # a feed declared in million yuan, and one that declares nothing
        x, shares = r[k], r[k][7] * 10.0 ** truth[k][0]
        truth[k] = (0, 6)
        r[k] = (*x[:7], shares, shares * x[6] / 1e6, "million" if k % 2 else "none", None, x[11])
    f = feeds(spark).unionByName(spark.createDataFrame([("million", D(0), D(400), "股", "mn cny", "万元")], FEEDS))
    got = {x["row_id"]: (x["vol_power"], x["amount_power"]) for x in units.common_units_daily(spark.createDataFrame(r, DAILY), f).collect()}
    assert got == truth


def test_where_rows_are_processed_changes_nothing(spark):
    """Codes above `floor`, null ones too, and days of many readings: every row as in one task, with exactly the same messages."""
    r, _ = rows(5, 60)
    rnd = random.Random(7)
    r += [(10_000 + i, *rnd.choice(r[:60])[1:]) for i in range(150)]  # repeats on all days
    r += [(20_000 + i, None, *rnd.choice(r)[2:]) for i in range(60)] + [(30_000, "000001.SZ", None, *r[0][3:])]
    r += [(40_000 + i, *r[70][1:7], v, None if i % 3 else v * 20, "none", None, dt.datetime(2025, 1, 1)) for i, v in enumerate([1e4, 1e6, 1e8] * 20)]  # one device and day
    df = spark.createDataFrame(r, DAILY)
    whole = sorted(map(str, units.common_units_daily(df, feeds(spark)).collect()))
    assert len(whole) == len(r)
    for floor in (20, 100):
        assert sorted(map(str, units.common_units_daily(df, feeds(spark), floor=floor).collect())) == whole


def test_words(spark):
    d = {
        "V=hands;A=RMB 1": (2, 0), "vol in x10000 sh, amt in RMB '000": (4, 3), "file header said lots and yi yuan": (2, 8), "units: amt x1e8 CNY | vol single shares": (0, 8), "补传件 单位 千元、万股": (4, 3), "万股/亿元": (4, 8), "量:手 额:万元": (2, 4),
        "成交量单位股，成交额单位元": (0, 0), "成交额(亿元)": (None, 8), "量按万股": (4, None), "volume given as wan shares by sender": (4, None), "turnover quoted in kCNY": (None, 3), "shares desk on leave": (None, None), "a lot of revisions": (None, None), "hand-keyed": (None, None), "手工补录": (None, None),
        "volume unit: lots": (2, None), "vol (lots)": (2, None), "Volume in lots": (2, None), "vol: 手": (2, None), "成交量:手": (2, None), "成交量（手）": (2, None), "单位：手": (2, None), "vol=hands": (2, None),
        "quantity in shares, turnover in cny": (0, 0), "lots": (2, None), "lots, 10k CNY": (2, 4), "late file; vol in lots": (2, None), "shares and yuan": (0, 0), "amounts in shares desk's file": (None, None), "a lot of shares traded": (None, None), "手": (2, None),
        "元旦后首批": (None, None), "万分之三费率已复核": (None, None), "亿林数据岗转": (None, None), "checked by desk": (None, None), "": (None, None),
    }
    df = spark.createDataFrame([(k,) for k in d], "r string").select("r", units.named_volume(F.col("r")).alias("v"), units.named_amount(F.col("r")).alias("a"))
    assert {x["r"]: (x["v"], x["a"]) for x in df.collect()} == d


def test_value_text(spark):
    d = {"1,048.556mn": (1048.556, 2), "CNY 0.09365bn": (0.09365, 5), "100.97 亿元": (100.97, 4), "约100.6亿": (100.6, 4), " 1.02778e+02 100m CNY": (102.778, 4), "10025506218.0000元": (10025506218.0, -4), "约10578.0675百万": (10578.0675, 2), "100.2061": (100.2061, None), "约1035033.76万": (1035033.76, 0), "n/a": (None, None)}
    n, p = units.parse_value_text(F.col("t"))
    got = {x["t"]: (x["n"], x["p"]) for x in spark.createDataFrame([(k,) for k in d], "t string").select("t", n.alias("n"), p.alias("p")).collect()}
    assert got == d


def test_edges(spark):
    nan = float("nan")
    r = [(1, None, None, None, None, None, None, None, None, None, None, None), (2, "a", D(0), 1.0, 1.0, 1.0, None, 0.0, 0.0, "good", None, None), (3, "a", D(0), 1.0, 1.0, 1.0, nan, nan, float("inf"), "new", "ok", None), (3, "a", D(0), 1.0, 1.0, 1.0, nan, nan, float("inf"), "new", "ok", None)]
    got = units.common_units_daily(spark.createDataFrame(r, DAILY), feeds(spark)).collect()
    assert len(got) == 4 and all(x["vol_power"] is None and x["amount_power"] is None for x in got)
    assert units.common_units_daily(spark.createDataFrame([], DAILY), feeds(spark)).count() == 0


def test_viterbi_scores_are_of_the_best_paths():
    rng = np.random.default_rng(0)
    dev = np.repeat([0, 1, 2], [5, 1, 4])
    e = rng.normal(size=(10, 3))
    got = units.viterbi_scores(dev, e, 0.7) + e
    for d in range(3):
        idx = np.flatnonzero(dev == d)
        score = {p: sum(e[i, s] for i, s in zip(idx, p, strict=True)) - 0.7 * sum(a != b for a, b in zip(p, p[1:], strict=False)) for p in np.ndindex(*[3] * len(idx))}
        assert tuple(got[idx].argmax(1)) == max(score, key=score.get)
        for k, i in enumerate(idx):
            assert np.allclose(got[i], [max(v for p, v in score.items() if p[k] == s) for s in range(3)])


def test_named_units_counts_all_remarks(spark):
    df = spark.createDataFrame([("vol in lots",), ("vol in lots",), ("ok",), (None,)], "remark string")
    assert {tuple(r) for r in units.named_units(df).collect()} == {("vol in lots", 2, 2, None), ("ok", 1, None, None), (None, 1, None, None)}
