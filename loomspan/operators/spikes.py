"""Implausible measurements: spikes, stuck values and impossible readings.

Each field of each entity's series is a hidden Markov chain over the states
normal, spike, stuck and out of range, whose parameters are those of the readings'
sources: the usual deviation and the rate of spikes are fitted per source by expectation maximisation over all
of its readings, the rate of impossible readings is counted (`units.source_noise`).
Forward-backward gives each reading's state probabilities; hard bounds enter
as certain emissions, and a stuck state must also pass an exact run-length check.

The chain runs over one representative reading per entity and day; every
other reading of the day is judged by its own emission under the chain's
messages for that day, so repeats make no run and are still flagged each.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.operators import series, units
from loomspan.operators.series import Arrays

NORMAL, SPIKE, STUCK, OUT = range(4)
FIELDS = ("amount", "high", "low")
#: a stuck run begins and goes on with these chances; the other two come from the source, within bounds
STUCK_ENTERS, STUCK_STAYS = 2e-4, 0.9
SPIKE_RATES, OUT_RATES = (2e-4, 5e-3), (2e-4, 5e-3)
PAID = 0.1  # deviation of the average price from the mean of open and close, as a share of the way between them
BROAD = 0.05  # density of a spike over the log deviation
#: chance that two normal readings in a row are stored alike
ALIKE = {"amount": 1e-6, "high": 2e-2, "low": 2e-2}
RUNS = {"amount": 5, "high": 7}


def steps(spike: np.ndarray, out: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Chances [n, 4] of the next state: after normal, spike or out of range; after stuck. spike, out: rates of the reading's source."""
    p = np.clip(np.where(np.isnan(spike), 5e-4, spike), *SPIKE_RATES)
    q = np.clip(np.where(np.isnan(out), 5e-4, out), *OUT_RATES)
    go = np.column_stack([1 - p - q - STUCK_ENTERS, p, np.full(len(p), STUCK_ENTERS), q])
    hold = np.column_stack([(1 - STUCK_STAYS) * (1 - p - q), p, STUCK_STAYS * (1 - p - q), q])
    return go, hold


def messages(chain: np.ndarray, emit: np.ndarray, go: np.ndarray, hold: np.ndarray) -> np.ndarray:
    """What the rest of its chain says of each state of each row, own emission left out: [n, 4].

    Chains are runs of equal `chain`; all of a block step together.
    """
    n, s = emit.shape
    if not n:
        return np.zeros((0, s))
    starts, length = series.runs(chain)
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    pred = np.empty((n, s))
    pred[starts] = go[starts]
    a = pred[starts] * emit[starts]
    a /= a.sum(1, keepdims=True)
    for t in range(1, int(length[0])):
        k = int(np.searchsorted(-length, -t, side="left"))
        rows = starts[:k] + t
        stuck = a[:k, STUCK, None]
        p = (1 - stuck) * go[rows] + stuck * hold[rows]
        pred[rows] = p
        p = p * emit[rows]
        a[:k] = p / p.sum(1, keepdims=True)
    back = np.ones((n, s))
    for t in range(int(length[0]) - 1, 0, -1):
        k = int(np.searchsorted(-length, -t, side="left"))
        rows = starts[:k] + t
        w = back[rows] * emit[rows]
        b = np.repeat((w * go[rows]).sum(1)[:, None], s, axis=1)
        b[:, STUCK] = (w * hold[rows]).sum(1)
        back[rows - 1] = b / b.sum(1, keepdims=True)
    m = pred * back
    return m / m.sum(1, keepdims=True)


def emissions(x: np.ndarray, sd: np.ndarray, bad: np.ndarray, alike: np.ndarray, p_alike: float, one_sided: bool) -> np.ndarray:
    """Likelihoods [n, 4] of log deviations x; NaN: not measured, says nothing; bad: beyond a hard bound."""
    miss = np.isnan(x)
    sd = np.clip(np.where(np.isnan(sd), 0.05, sd), 1e-4, None)
    z = np.where(miss, 0.0, x) / sd
    norm = np.exp(-0.5 * np.minimum(z * z, 1400.0)) * (0.3989423 * (2 if one_sided else 1)) / sd
    e = np.empty((len(x), 4))
    e[:, NORMAL] = norm * np.where(alike, p_alike, 1 - p_alike)
    e[:, SPIKE] = BROAD * np.where(alike, 1e-6, 1 - 1e-6)
    e[:, STUCK] = (0.5 * norm + 0.5 * BROAD) * np.where(alike, 0.999, 1e-9)
    e[:, OUT] = 1e-9
    e[miss] = np.where(alike[miss][:, None], np.array([p_alike, 1e-6, 0.999, 1e-9]), np.array([1 - p_alike, 1.0, 1e-9, 1e-9]))
    e[bad] = np.array([1e-12, 1e-12, 1e-12, 1.0])
    e[bad & alike] = np.array([1e-15, 1e-12, 0.5, 0.5])
    return e + 1e-300


def _deviations(a: Arrays, m: units.Pair, msg: np.ndarray) -> dict[str, tuple]:
    """field -> (stored value, log deviation, usual deviation, beyond a hard bound, one-sided, spike rate), in decoded units."""
    vp, ap = units.decode(m, msg)
    vol, amount, o, h, lo, c = (a[k] for k in ("vol", "amount", "open", "high", "low", "close"))
    traded = vol > 0
    top, low = np.fmax(o, c), np.fmin(o, c)
    with np.errstate(invalid="ignore", divide="ignore"):
        xa = np.where(traded, 2.302585092994046 * (m.la + ap - m.lv - vp - m.lp), np.nan)
        xh = np.where(traded & (h > 0) & (top > 0), np.log(h / top), np.nan)
        xl = np.where(traded & (lo > 0) & (low > 0), np.log(low / lo), np.nan)
    # without a close the day's own move adds to what is usual
    move = np.where(np.isnan(c) | np.isnan(o), np.where(np.isnan(a["sc"]), 0.03, a["sc"]), 0.0)
    # the price paid on average lies anywhere between open and close: a long way widens what is usual
    with np.errstate(invalid="ignore", divide="ignore"):
        way = PAID * np.nan_to_num(np.abs(np.log(np.where((top > 0) & (low > 0), top / low, 1.0))))
    return {
        "amount": (amount, xa, np.hypot(a["sa"] * 2.302585092994046, move + way), traded & (amount <= 0), False, a["pa"]),
        "high": (h, xh, a["sh"] + move, traded & ((h <= 0) | (h < top - 1e-9)), True, a["ph"]),
        "low": (lo, xl, a["sl"] + move, traded & ((lo <= 0) | (lo > low + 1e-9)), True, a["pl"]),
    }


UNITS = len(units.Pair.states) + 1
#: after the units' messages, per field: 4 state messages, the day's stored value, that of the day before, the run's length
WIDTH = UNITS + 7 * len(FIELDS)


def chain(a: Arrays) -> np.ndarray:
    """Messages of the unit chains and of the chains of days, for representatives sorted by entity, day and source."""
    out = np.empty((len(a["ent"]), WIDTH))
    m = units.Pair(a)
    out[:, :UNITS] = units.unit_messages(m, a)
    dev = _deviations(a, m, out[:, :UNITS])
    # of a day's sources the reading that arrived last
    o = np.lexsort((a["src"], a["row_id"], a["_at"], a["_day"], a["ent"]))
    e, d = a["ent"][o], a["_day"][o]
    last = np.r_[(e[1:] != e[:-1]) | (d[1:] != d[:-1]), True]
    rep, day = o[last], np.empty(len(o), np.int64)
    day[o] = np.r_[0, np.cumsum(last)[:-1]]
    ent = a["ent"][rep]
    first = np.r_[True, ent[1:] != ent[:-1]]
    for i, f in enumerate(FIELDS):
        value, x, sd, bad, one_sided, spike = (v if isinstance(v, bool) else v[rep] for v in dev[f])
        before = np.where(first, np.nan, np.r_[np.nan, value[:-1]])
        same = value == before
        m = messages(ent, emissions(x, sd, bad, same, ALIKE[f], one_sided), *steps(spike, a["po"][rep]))
        start = np.flatnonzero(~same)
        length = np.repeat(np.diff(np.r_[start, len(rep)]), np.diff(np.r_[start, len(rep)]))
        out[:, UNITS + 7 * i : UNITS + 7 * (i + 1)] = np.column_stack([m, value, before, length])[day]
    return out


def states(a: Arrays, msg: np.ndarray, least: Mapping[str, int] = RUNS) -> dict[str, np.ndarray]:
    """State of each reading and field (0: plausible) under its day's messages."""
    dev, out = _deviations(a, units.Pair(a), msg[:, :UNITS]), {}
    for i, f in enumerate(FIELDS):
        value, x, sd, bad, one_sided, _ = dev[f]
        m = msg[:, UNITS + 7 * i : UNITS + 7 * (i + 1)]
        alike = value == m[:, 5]
        post = m[:, :4] * emissions(x, sd, bad, alike, ALIKE[f], one_sided)
        state = post.argmax(1)
        # exact check of stuck runs: long enough, and not the run's first reading
        long = alike & (value == m[:, 4]) & (m[:, 6] >= least.get(f, np.inf))
        rest = post.copy()
        rest[:, STUCK] = 0
        out[f] = np.where((state == STUCK) & ~long, rest.argmax(1), state).astype(np.int8)
    return out


def implausible_daily(daily: DataFrame, feeds: DataFrame, floor: int = 200_000) -> DataFrame:
    """(row_id, field, state) of implausible amount, high and low in `daily`; state is spike, stuck or out_of_range.

    amount is held, in yuan, against vol in shares times the mean of open and
    close (units are decoded first, so another unit is no case); high and low
    against the higher and lower of open and close. Rows whose vol is not above 0, and
    null or NaN values, are never flagged. Every flagged row comes once per field. `floor`: see `by_series`; it
    changes where rows are processed, never the result.
    """
    r = units.daily_readings(daily, feeds)
    names = ["plausible", "spike", "stuck", "out_of_range"]

    def judge(a: Arrays, msg: np.ndarray) -> pd.DataFrame:
        traded = a["vol"] > 0
        hits = [(i, np.flatnonzero(traded & (s != NORMAL)), s) for i, s in enumerate(states(a, msg).values())]
        return pd.DataFrame({
            "row_id": np.concatenate([a["row_id"][k] for _, k, _ in hits]),
            "f": np.concatenate([np.full(len(k), i, np.int32) for i, k, _ in hits]),
            "s": np.concatenate([s[k].astype(np.int32) for _, k, s in hits]),
        })

    got = series.by_series(r, chain, WIDTH, judge, "row_id long, f int, s int", floor, units.source_noise(r))
    word = lambda c, ws: F.element_at(F.array(*[F.lit(w) for w in ws]), F.col(c) + 1)
    return got.select("row_id", word("f", FIELDS).alias("field"), word("s", names).alias("state"))
