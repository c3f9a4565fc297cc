"""Totals and averages over trailing calendar periods, days without a row included.

Rows shrink to one per (entity, day) first, map-side combined, so a hot entity
is at most one row a day. Entity timelines are cut into time tiles; each tile
also gets the days before it that its longest window reaches (the halo). A
tile is scattered from its sparse rows into a dense [entities, days] block and multiplied by banded
0/1 window operators, one matrix product per window and measure.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def banded(days: int, halo: int, window: int) -> np.ndarray:
    """[halo + days, days] operator: column j sums the `window` days that end with tile day j."""
    end = np.arange(days) + halo
    row = np.arange(halo + days)[:, None]
    return ((row <= end) & (row > end - window)).astype(np.float64)


def trailing_totals(
    df: DataFrame,
    entity: str,
    day: str,
    total: str,
    average: str,
    windows: Sequence[int] = (7, 30),
    version: Sequence[str] = (),
    tile_days: int = 122,
) -> DataFrame:
    """Per entity and calendar day, from its first to its last day in `df`:

    total_<w> (sum of `total` over the w days ending with the day; missing days
    and nulls add 0), n_<w> (days in the window with a value of `average`) and avg_<w> (mean of
    those daily values; null if none). Several rows of one (entity, day): only the one with the
    greatest `version` (columns in order; nulls least) counts, of equal versions the one with the greatest total, then the greatest
    average, so that repeats and revisions are not counted twice and both values come from one row. NaN counts as null. Rows with a null entity
    or day are left out; an empty table gives an empty result. A window of zeros gives
    exactly 0: sums are of the window's own days, never differences of running sums.
    """
    windows = sorted(set(windows))
    halo = max(windows) - 1
    num = lambda c: F.when(~F.isnan(F.col(c).cast("double")), F.col(c).cast("double"))
    daily = (
        df.where(F.col(entity).isNotNull() & F.col(day).isNotNull())
        .groupBy(F.col(entity).alias("_e"), F.datediff(F.col(day).cast("date"), F.lit("1970-01-01")).alias("_d"))
        .agg(F.max(F.struct(*[F.col(c).alias(f"_r{i}") for i, c in enumerate(version)], num(total).alias("_v"), num(average).alias("_a"))).alias("_b"))
        .select("_e", "_d", "_b._v", "_b._a")
    )
    # the day row goes to its own tile and, as halo, to the next one it can reach; span rows fill idle tiles
    own = F.floor(F.col("_d") / tile_days)
    reach = F.floor((F.col("_d") + halo) / tile_days)
    rows = daily.select("_e", "_d", "_v", "_a", F.explode(F.sequence(own, reach)).alias("_tile"))
    # each entity's span, per tile: first and last day, also for tiles without a row
    span = daily.groupBy("_e").agg(F.min("_d").alias("_lo"), F.max("_d").alias("_hi"))
    spans = span.select("_e", F.explode(F.sequence(F.floor(F.col("_lo") / tile_days), F.floor(F.col("_hi") / tile_days))).alias("_tile"), "_lo", "_hi")
    nul = F.lit(None)
    stream = rows.select("_e", "_tile", "_d", "_v", "_a", nul.cast("int").alias("_lo"), nul.cast("int").alias("_hi")).unionByName(
        spans.select("_e", "_tile", nul.cast("int").alias("_d"), nul.cast("double").alias("_v"), nul.cast("double").alias("_a"), "_lo", "_hi")
    )
    stream = stream.repartition("_e", "_tile").sortWithinPartitions("_tile", "_e", F.col("_d").asc_nulls_first())
    ops = [banded(tile_days, halo, w) for w in windows]
    out = f"{'`' + entity + '`'} {dict(df.dtypes)[entity]}, `{day}` date, " + ", ".join(f"total_{w} double, n_{w} int, avg_{w} double" for w in windows)

    def solve(b: pd.DataFrame) -> Iterator[pd.DataFrame]:
        for t, g in b.groupby("_tile", sort=False):
            code, ents = pd.factorize(g["_e"])
            d = g["_d"].to_numpy(dtype=np.float64)
            head = np.isnan(d)
            lo, hi = np.full(len(ents), 1.0), np.zeros(len(ents))
            lo[code[head]], hi[code[head]] = g["_lo"].to_numpy(dtype=np.float64)[head], g["_hi"].to_numpy(dtype=np.float64)[head]
            start = int(t) * tile_days
            at, col = code[~head], (d[~head] - start + halo).astype(np.int64)
            v, a = g["_v"].to_numpy(dtype=np.float64)[~head], g["_a"].to_numpy(dtype=np.float64)[~head]
            shape = (len(ents), tile_days + halo)
            tot, val, has = np.zeros(shape), np.zeros(shape), np.zeros(shape)
            tot[at, col] = np.nan_to_num(v)
            val[at, col] = np.nan_to_num(a)
            has[at, col] = ~np.isnan(a)
            days = start + np.arange(tile_days)
            inside = (days[None, :] >= lo[:, None]) & (days[None, :] <= hi[:, None])
            e, j = np.nonzero(inside)
            res = {entity: ents[e], day: days[j].astype("datetime64[D]").astype("datetime64[ns]")}
            for w, op in zip(windows, ops, strict=True):
                n = has @ op
                res[f"total_{w}"] = (tot @ op)[e, j]
                res[f"n_{w}"] = n[e, j].astype(np.int32)
                with np.errstate(invalid="ignore", divide="ignore"):
                    res[f"avg_{w}"] = np.where(n > 0, (val @ op) / n, np.nan)[e, j]
            yield pd.DataFrame(res)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # batches cut tiles of an entity anywhere: the last (tile, entity) waits for the next batch
        kept: list[pd.DataFrame] = []
        for b in batches:
            if not len(b):
                continue
            b = pd.concat([*kept, b], ignore_index=True) if kept else b
            tail = (b["_tile"] == b["_tile"].iloc[-1]) & (b["_e"] == b["_e"].iloc[-1])
            kept = [b[tail]]
            yield from solve(b[~tail])
        if kept:
            yield from solve(kept[0])

    res = stream.mapInPandas(run, out)
    return res.select(entity, day, *[c for w in windows for c in (F.col(f"total_{w}"), F.col(f"n_{w}"), F.when(~F.isnan(f"avg_{w}"), F.col(f"avg_{w}")).alias(f"avg_{w}"))])
