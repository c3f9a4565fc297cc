"""Recursive operators: stages that run numpy kernels over each entity's sorted history.

Most formulas stay window expressions. What is recursive by nature (exponential
smoothing, position machines, expanding regressions) is collected as stages
while a formula is compiled; stages that do not need each other share one pass.
A panel has one row per (entity, date), so an entity's history is short
however large the panel; smoothing steps all entities of an Arrow batch together.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomspan.functions.numeric import dbl
from loomspan.functions.registry import Context


def ewm_block(chain: np.ndarray, x: np.ndarray, alpha: float, seed: int = 1) -> np.ndarray:
    """y = y' + alpha (x - y') along each run of equal `chain`; starts from the mean of the first `seed`
    observations (null before). A missing x carries y on but yields null at that row."""
    n = len(x)
    y = np.full(n, np.nan)
    if not n:
        return y
    starts = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1]])
    length = np.diff(np.r_[starts, n])
    order = np.argsort(-length, kind="stable")
    starts, length = starts[order], length[order]
    state, seen = np.zeros(len(starts)), np.zeros(len(starts), np.int64)
    for t in range(int(length[0])):
        k = int(np.searchsorted(-length, -t, side="left"))
        v = x[starts[:k] + t]
        ok = ~np.isnan(v)
        s, c = state[:k], seen[:k] + ok
        warm = c <= seed
        new = np.where(warm, s + (v - s) / np.maximum(c, 1), s + alpha * (v - s))
        state[:k] = np.where(ok, new, s)
        seen[:k] = c
        y[starts[:k] + t] = np.where(ok & (c >= seed), state[:k], np.nan)
    return y


@dataclass
class Stage:
    """kernel None: the input itself, computed once and kept as a column."""

    name: str
    kernel: str | None
    inputs: list[Column]
    params: tuple
    needs: frozenset[str]


@dataclass
class StagedContext(Context):
    """A compile context that collects recursive stages."""

    stages: list[Stage] = field(default_factory=list)
    known: dict = field(default_factory=dict)

    def stage(self, kernel: str, inputs: list[Column], *params) -> Column:
        return self._stage(kernel, [dbl(i) for i in inputs], params)

    def hold(self, c: Column) -> Column:
        """c as a column of its own. Spark computes a window once for each time it is written, and an operator that names
        a windowed value several times, itself made of such values, writes it once for each path through them."""
        return self._stage(None, [c], ())

    def _stage(self, kernel: str | None, inputs: list[Column], params: tuple) -> Column:
        key = (kernel, tuple(str(i) for i in inputs), params)
        if key not in self.known:
            text = " ".join(key[1])
            s = Stage(f"__seq{len(self.stages):03d}__", kernel, inputs, params, frozenset(s.name for s in self.stages if s.name in text))
            self.stages.append(s)
            self.known[key] = F.col(s.name)
        return self.known[key]

    def ewm(self, x, alpha: float, seed: int = 1) -> Column:
        c = self.stage("ewm", [x], float(alpha), int(seed))
        return F.when(~F.isnan(c), c)


KERNELS: dict[str, Callable] = {}


def kernel(name: str):
    """Registers fn(list of arrays of one entity, *params) -> array."""

    def add(fn):
        KERNELS[name] = fn
        return fn

    return add


@kernel("size")
def signals_to_size(a, accumulate: float, action: float):
    """Position from entry and exit signals: entry long / exit long / entry short / exit short."""
    el, xl, es, xs = [np.nan_to_num(v) != 0 for v in a]
    out, pos = np.zeros(len(el)), 0.0
    for i in range(len(out)):
        if pos > 0 and xl[i] or pos < 0 and xs[i]:
            pos = 0.0
        if el[i] and not xl[i]:
            pos = pos + 1 if accumulate and pos > 0 else 1.0
        elif es[i] and not xs[i]:
            pos = pos - 1 if accumulate and pos < 0 else -1.0
        out[i] = pos
    return out


@kernel("chips")
def chips(a, part: str, step: float, decay: float, share: float):
    """Chip distribution: turnover replaces holdings evenly, new ones spread over the day's range.

    part winner: share held below the close; part cost: price below which `share` of the chips lie.
    The grid is the multiples of `step`, so it is the same for every history; it grows as prices arrive and a row depends on
    earlier rows only. It has no limit: memory and time per row grow with the entity's price range so far over `step`.
    """
    high, low, avgp, turn, close = a
    ok = ~np.isnan(high) & ~np.isnan(low)
    out = np.full(len(high), np.nan)
    held, first = np.zeros(0), 0
    for i in range(len(high)):
        if ok[i]:
            t = min(1.0, max(0.0, (0.0 if np.isnan(turn[i]) else turn[i]) * decay))
            peak = avgp[i] if not np.isnan(avgp[i]) else (high[i] + low[i]) / 2
            at = int(np.rint(peak / step))
            lo, hi = min(at, int(np.ceil(low[i] / step - 1e-9))), max(at, int(np.floor(high[i] / step + 1e-9)))
            if not len(held):
                held, first = np.zeros(hi - lo + 1), lo
            if lo < first:
                held, first = np.r_[np.zeros(first - lo), held], lo
            if hi >= first + len(held):
                held = np.r_[held, np.zeros(hi - first - len(held) + 1)]
            grid = np.arange(lo, hi + 1) * step
            w = np.where((grid >= low[i] - 1e-9 * step) & (grid <= high[i] + 1e-9 * step), np.maximum(1e-9, 1 - np.abs(grid - peak) / max(high[i] - low[i], step)), 0.0)
            if not w.any():
                w[at - lo] = 1.0
            if held.any():
                held *= 1 - t
            else:
                t = 1.0
            held[lo - first : hi - first + 1] += t * w / w.sum()
        if held.any() and not np.isnan(close[i]):
            if part == "winner":
                out[i] = held[: max(0, int(np.floor(close[i] / step + 1e-9)) - first + 1)].sum() / held.sum()
            else:
                out[i] = (first + min(len(held) - 1, np.searchsorted(np.cumsum(held) / held.sum(), share - 1e-12))) * step
    return out


@kernel("rolling_ols")
def rolling_ols(a, d: int, out: str, block: int = 4096):
    """Fitted value or residual of y on the other inputs (with intercept) over the last d rows; expanding if d is 0.

    A row needs d complete rows (expanding: as many complete ones as coefficients). Each window is centred and scaled by its own
    rows, never a difference of running sums, so no digits are lost where the level is far above the deviation. An input that does not
    vary gets the coefficient 0.
    """
    y, x = a[0], np.column_stack(a[1:]) if len(a) > 1 else np.zeros((len(a[0]), 0))
    ok = ~np.isnan(y) & ~np.isnan(x).any(1)
    k, res = x.shape[1] + 1, np.full(len(y), np.nan)

    def put(rows: np.ndarray, yw: np.ndarray, xw: np.ndarray) -> None:
        """rows [m] and their windows yw [m, d], xw [m, d, k - 1]; the last of a window is the row itself."""
        ym, xm = yw.mean(1), xw.mean(1)
        xc = xw - xm[:, None, :]
        sd = np.sqrt((xc**2).mean(1))
        sd = np.where(sd > 1e-12 * np.maximum(np.abs(xm), 1e-300), sd, np.inf)
        z = xc / sd[:, None, :]
        b = np.linalg.pinv(z.transpose(0, 2, 1) @ z, rcond=1e-12, hermitian=True) @ (z.transpose(0, 2, 1) @ (yw - ym[:, None])[:, :, None])
        fit = ym + (z[:, -1, :] * b[:, :, 0]).sum(1)
        res[rows] = fit if out == "pred" else yw[:, -1] - fit

    if d:
        if len(y) >= d >= k:
            full = np.flatnonzero(np.convolve(ok, np.ones(d), "valid") == d) + d - 1
            yv, xv = np.lib.stride_tricks.sliding_window_view(y, d), np.lib.stride_tricks.sliding_window_view(x, d, axis=0)
            for i in range(0, len(full), max(1, block * 16 // (d * k))):
                r = full[i : i + max(1, block * 16 // (d * k))]
                put(r, yv[r - d + 1], xv[r - d + 1].transpose(0, 2, 1))
        return res
    rows = np.flatnonzero(ok)
    # running means and centred products, a row at a time (Welford)
    m, c, n = np.zeros(k), np.zeros((k, k)), 0
    for i in rows:
        v = np.r_[x[i], y[i]]
        n += 1
        gap = v - m
        m = m + gap / n
        c = c + np.outer(gap, v - m)
        if n >= k:
            sd = np.sqrt(np.diag(c)[:-1] / n)
            sd = np.where(sd > 1e-12 * np.maximum(np.abs(m[:-1]), 1e-300), sd, np.inf)
            b = np.linalg.pinv(c[:-1, :-1] / np.outer(sd, sd), rcond=1e-12, hermitian=True) @ (c[:-1, -1] / sd)
            fit = m[-1] + ((x[i] - m[:-1]) / sd) @ b
            res[i] = fit if out == "pred" else y[i] - fit
    return res


def run_stages(df: DataFrame, ctx: StagedContext) -> DataFrame:
    """Adds the column of every collected stage to `df`: kernels that can run share a pass and go before held columns, which they would carry."""
    left = list(ctx.stages)
    while left:
        can = [s for s in left if s.needs.isdisjoint(x.name for x in left)]
        todo = [s for s in can if s.kernel is not None] or can
        left = [s for s in left if s not in todo]
        if todo[0].kernel is None:
            df = df.withColumns({s.name: s.inputs[0] for s in todo})
            continue
        ins = {f"__in{i}_{j}__": c for i, s in enumerate(todo) for j, c in enumerate(s.inputs)}
        fed = df.withColumns(ins).repartition(ctx.code).sortWithinPartitions(ctx.code, ctx.date)
        keep = df.columns
        specs = [(s.name, s.kernel, s.params, [f"__in{i}_{j}__" for j in range(len(s.inputs))]) for i, s in enumerate(todo)]
        code = ctx.code
        schema = ", ".join([f"`{n}` {t}" for n, t in df.dtypes] + [f"`{s.name}` double" for s in todo])

        def solve(b: pd.DataFrame, specs=specs, keep=keep, code=code) -> pd.DataFrame:
            chain = pd.factorize(b[code])[0]
            cut = np.flatnonzero(np.r_[True, chain[1:] != chain[:-1], True])
            out = b[keep].copy()
            for name, kind, params, cols in specs:
                arrays = [b[c].to_numpy(dtype=np.float64, na_value=np.nan) for c in cols]
                if kind == "ewm":
                    out[name] = ewm_block(chain, arrays[0], *params)
                else:
                    y = np.empty(len(b))
                    for s, e in zip(cut[:-1], cut[1:], strict=True):
                        y[s:e] = KERNELS[kind]([a[s:e] for a in arrays], *params)
                    out[name] = y
            return out

        def run(batches: Iterator[pd.DataFrame], solve=solve, code=code) -> Iterator[pd.DataFrame]:
            from loomspan.operators.series import by_entity

            yield from map(solve, by_entity(batches, code))

        df = fed.mapInPandas(run, schema)
        # NaN from a kernel means none
        df = df.withColumns({s.name: F.when(~F.isnan(s.name), F.col(s.name)) for s in todo})
    return df
