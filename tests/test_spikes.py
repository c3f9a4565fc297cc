import datetime as dt
import math
import random

import numpy as np

from loomspan.operators import series, spikes, units
from tests.test_units import DAILY, D, feeds


def series_of(seed=1, n=80):
    rnd = random.Random(seed)
    out = []
    for c in range(3):
        for i in range(n):
            o = 20 + rnd.random()
            cl = o * math.exp(rnd.gauss(0, 0.01))
            h, lo = max(o, cl) * (1 + abs(rnd.gauss(0, 0.005))), min(o, cl) * (1 - abs(rnd.gauss(0, 0.005)))
            v = 1e6 * math.exp(rnd.gauss(0, 0.2))
            out.append([len(out), f"00000{c}.SZ", D(i), o, h, lo, cl, v, v * (o + cl) / 2 * math.exp(rnd.gauss(0, 0.003)), "good", None, dt.datetime(2025, 1, 1)])
    return out


def found(spark, rows, **kw):
    return {(r["row_id"], r["field"]): r["state"] for r in spikes.implausible_daily(spark.createDataFrame([tuple(r) for r in rows], DAILY), feeds(spark), **kw).collect()}


def test_clean_series_has_none(spark):
    assert found(spark, series_of()) == {}


def test_planted(spark):
    r = series_of()
    r[10][8] *= 4
    r[20][4] *= 1.5
    r[30][5] *= 0.6
    r[40][4] = r[40][3] * 0.9
    r[50][5] = -1.0
    for i in range(101, 106):
        r[i][8] = r[100][8]
    for i in range(121, 125):
        r[i][8] = r[121][8]  # four alike: too short
    for i in range(180, 188):
        r[i][4] = r[180][4]
    want = {(10, "amount"), (20, "high"), (30, "low"), (40, "high"), (50, "low"), *((i, "amount") for i in range(101, 106)), *((i, "high") for i in range(181, 188))}
    for floor in (200_000, 40):
        got = found(spark, r, floor=floor)
        assert want <= set(got)
        # a stuck high can also leave open or close above it, a frozen amount deviates: nothing else may be flagged
        assert {k for k in set(got) - want} <= {(180, "high"), *((i, "amount") for i in range(121, 125))} and (180, "high") not in got


def test_other_unit_is_no_case_and_repeats_count_each(spark):
    r = series_of()
    r[10][8] /= 1e4
    r[20][8] *= 5
    r.append([*r[20][:]])
    r[-1][0] = 9999
    got = found(spark, r)
    assert set(got) == {(20, "amount"), (9999, "amount")}


def test_where_rows_are_processed_changes_nothing(spark):
    r = series_of()
    r[10][8] *= 4
    for i in range(101, 107):
        r[i][8] = r[100][8]
    for i in range(240):  # two sources and several readings a day, some of them wrong
        x = [*r[i]]
        x[0], x[9], x[11] = 1000 + i, "good" if i % 3 else "none", dt.datetime(2025, 1, 1, i % 5)
        x[4] *= 1.5 if i % 50 == 7 else 1
        r.append(x)
    r += [[5000 + i, None, *x[2:]] for i, x in enumerate(r[:90])]
    want = found(spark, r)
    assert len(want) > 10
    for floor in (40, 170):
        assert found(spark, r, floor=floor) == want


def test_parameters_of_a_source():
    rng = np.random.default_rng(3)
    x = np.abs(np.r_[rng.normal(0, 0.01, 20_000), rng.uniform(0.2, 3, 60)])
    b, n = np.unique(np.floor(np.log(x) * units.BINS), return_counts=True)
    sd, rate = units.fit_normal(np.exp((b + 0.5) / units.BINS), n.astype(float))
    assert abs(sd / 0.01 - 1) < 0.03 and 0.002 < rate < 0.005
    assert all(math.isnan(v) for v in units.fit_normal(np.zeros(0), np.zeros(0)))


def test_a_noisier_source_is_judged_by_its_own_measure(spark):
    r = series_of(n=120)
    for i, x in enumerate(r):
        if i % 2:
            x[9], x[8] = "none", x[8] * math.exp(0.15 * math.sin(i))
    r[200][8] *= 1.15  # of the exact source
    got = found(spark, r)
    assert set(got) == {(200, "amount")}


def test_edges(spark):
    nul = [1, None, None, None, None, None, None, None, None, None, None, None]
    idle = [2, "a", D(0), 1.0, 5.0, 9.0, 1.0, 0.0, 7.0, "good", None, None]
    assert found(spark, [nul, idle]) == {}
    assert found(spark, []) == {}


def test_forward_backward_by_enumeration():
    rng = np.random.default_rng(1)
    chain = np.array([0, 0, 0, 1, 1])
    e = rng.random((5, 4)) + 0.01
    go, hold = spikes.steps(rng.random(5) * 0.01, rng.random(5) * 0.01)
    assert np.allclose(go.sum(1), 1) and np.allclose(hold.sum(1), 1)
    m = spikes.messages(chain, e, go, hold)
    for c in (0, 1):
        idx = np.flatnonzero(chain == c)
        for k, i in enumerate(idx):
            want = np.zeros(4)
            for p in np.ndindex(*[4] * len(idx)):
                w = go[idx[0], p[0]]
                for a, b, j in zip(p, p[1:], idx[1:], strict=False):
                    w *= (hold if a == spikes.STUCK else go)[j, b]
                for j, s in zip(idx, p, strict=True):
                    w *= 1.0 if j == i else e[j, s]
                want[p[k]] += w
            assert np.allclose(m[i], want / want.sum())


def test_by_entity_carries_cut_groups():
    import pandas as pd

    b = [pd.DataFrame({"k": list(k), "v": v}) for k, v in (("aa", [1, 2]), ("", []), ("a", [3]), ("ab", [4, 5]), ("b", [6]), ("cd", [7, 8]), ("e", [9]))]
    got = [g.groupby("k").v.sum().to_dict() for g in series.by_entity(iter(b), "k")]
    two = [pd.DataFrame({"k": ["a", None], "d": [1, 1], "v": [1, 2]}), pd.DataFrame({"k": [None, None], "d": [1, 2], "v": [4, 8]})]
    assert [g.groupby(["k", "d"], dropna=False).v.sum().tolist() for g in series.by_entity(iter(two), "k", "d")] == [[1], [6], [8]]
    assert {k: v for g in got for k, v in g.items()} == {"a": 10, "b": 11, "c": 7, "d": 8, "e": 9} and sum(len(g) for g in got) == 5
