"""Chains over entities' series of daily readings, with the same result wherever a row is processed.

A chain runs over representatives: of each (entity, day, source) the reading that
arrived last. What the chain says of a representative, its own reading left out,
is a message of fixed width; every reading of that entity, day and source is then judged by its own
values under that message. An entity's rows are usually processed in one task. Of an entity with
more than `floor` rows only the representatives meet in one task, at most days x
sources of them; its rows are joined to the messages and judged anywhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

Arrays = dict[str, np.ndarray]
LEAST = -(2**62)


def runs(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and lengths of runs of equal values."""
    starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    return starts, np.diff(np.r_[starts, len(key)])


def arrays(b: pd.DataFrame) -> Arrays:
    """Columns of a frame as arrays: numbers as doubles with NaN for null, ids and times as integers; ent and src as
    numbers in the order of their text."""
    a = {c: b[c].to_numpy(dtype=np.float64, na_value=np.nan) for c in b.columns if c not in ("row_id", "_e", "src", "_day", "_at", "_msg")}
    for c in ("_day", "_at"):
        a[c] = b[c].to_numpy(dtype=np.int64, na_value=LEAST)
    a["row_id"] = b["row_id"].to_numpy(dtype=np.int64, na_value=LEAST)
    for c, k in (("_e", "ent"), ("src", "src")):
        a[k] = pd.factorize(b[c], sort=True)[0]
    return a


def last_of_each(a: Arrays) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order by entity, day, source and arrival; places of the representatives in that order; each row's representative)."""
    keys = (a["row_id"], a["_at"], a["src"], a["_day"], a["ent"])
    o = np.lexsort(keys)
    if len(o) > 1 and np.logical_and.reduce([k[o][1:] == k[o][:-1] for k in keys]).any():
        o = np.lexsort((*[a[c] for c in sorted(a) if a[c].dtype == np.float64], *keys))
    e, d, s = a["ent"][o], a["_day"][o], a["src"][o]
    last = np.r_[(e[1:] != e[:-1]) | (d[1:] != d[:-1]) | (s[1:] != s[:-1]), True] if len(o) else np.zeros(0, bool)
    return o, np.flatnonzero(last), np.r_[0, np.cumsum(last)[:-1]].astype(np.int64)[: len(o)]


def take(a: Arrays, at: np.ndarray) -> Arrays:
    return {k: v[at] for k, v in a.items()}


def _like(b: pd.DataFrame, keys: Sequence[str], row: pd.Series) -> np.ndarray:
    m = np.ones(len(b), bool)
    for k in keys:
        m &= (b[k].isna() if pd.isna(row[k]) else b[k] == row[k]).to_numpy()
    return m


def by_entity(batches: Iterator[pd.DataFrame], *keys: str) -> Iterator[pd.DataFrame]:
    """Frames of whole groups of `keys`, for batches sorted by them; what a batch cuts waits, and is put together once."""
    kept: list[pd.DataFrame] = []
    for b in batches:
        if not len(b):
            continue
        if kept:
            m = _like(b, keys, kept[0].iloc[0])
            if m.all():
                kept.append(b)
                continue
            end = int(np.argmin(m))
            yield pd.concat([*kept, b[:end]], ignore_index=True)
            b = b[end:]
        tail = int(np.argmax(_like(b, keys, b.iloc[-1])))
        if tail:
            yield b[:tail].reset_index(drop=True)
        kept = [b[tail:]]
    if kept:
        yield pd.concat(kept, ignore_index=True)


def by_series(
    readings: DataFrame,
    chain: Callable[[Arrays], np.ndarray],
    width: int,
    judge: Callable[[Arrays, np.ndarray], pd.DataFrame],
    schema: str,
    floor: int = 200_000,
    side: tuple[DataFrame, bool] | None = None,
    max_hot: int = 100_000,
) -> DataFrame:
    """`judge` on every row of `readings` under the messages of `chain`.

    readings: row_id, ts_code, _day (days since 1970), src, _at (arrival) and numbers. chain: representatives sorted by (entity, day,
    source) -> messages [n, width]; it may use all of an entity's representatives and nothing of other entities. judge:
    (rows, their messages) -> frame of `schema`. Null codes form one entity, null days the earliest day. Of equal
    arrivals the greatest row_id is the representative, then the greatest numbers. side: a table by source (_s), with the flag whether it
    may be broadcast; its columns are added to the rows. Entities above `floor` rows, null ones too, take the joined way; they are counted map-side, and
    their list is broadcast if it has at most `max_hot` entries. `floor` changes no result.
    """
    r = readings.withColumnRenamed("ts_code", "_e").withColumn("_e", F.coalesce("_e", F.lit(""))).withColumn("_day", F.coalesce("_day", F.lit(-1_000_000)).cast("int"))
    key = F.col("_e")
    per = r.groupBy(key.alias("_h")).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > floor).select("_h")
    hot = per.limit(max_hot + 1).count()

    def sided(d: DataFrame) -> DataFrame:
        return d if side is None else d.join(side[0], d["src"] == side[0]["_s"], "left").drop("_s")

    def placed(d: DataFrame) -> DataFrame:
        # a broadcast join keeps the partitioning, so the side's columns need not be shuffled
        early = side is not None and not side[1]
        d = sided(d).repartition("_e") if early else sided(d.repartition("_e"))
        return d.sortWithinPartitions("_e")

    def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in by_entity(batches, "_e"):
            a = arrays(b)
            o, rep, of = last_of_each(a)
            a = take(a, o)
            yield judge(a, chain(take(a, rep))[of])

    if not hot:
        return placed(r).mapInPandas(whole, schema)
    listed = F.broadcast(per) if hot <= max_hot else per
    cold, warm = r.join(listed, key == F.col("_h"), "left_anti"), r.join(listed, key == F.col("_h"), "left_semi")
    rest = [c for c in r.columns if c not in ("_e", "_day", "src", "_at", "row_id")]
    last = F.max(F.struct(F.coalesce("_at", F.lit(LEAST)).alias("_at"), F.coalesce("row_id", F.lit(LEAST)).alias("row_id"), *reversed(sorted(rest)))).alias("_r")
    reps = warm.groupBy("_e", "_day", "src").agg(last).select("_e", "_day", "src", "_r.*")

    def messages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in by_entity(batches, "_e"):
            a = arrays(b)
            o, _, _ = last_of_each(a)
            m = chain(take(a, o))
            yield pd.DataFrame({"_e2": b["_e"].to_numpy()[o], "_day2": b["_day"].to_numpy()[o], "src2": b["src"].to_numpy()[o], "_msg": list(m)})

    said = placed(reps).mapInPandas(messages, "_e2 string, _day2 int, src2 string, _msg array<double>")
    both = warm.join(said, (F.col("_e") == F.col("_e2")) & (F.col("_day") == F.col("_day2")) & (F.col("src") == F.col("src2"))).drop("_e2", "_day2", "src2")

    def single(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            if len(b):
                yield judge(arrays(b), np.stack(b["_msg"].to_numpy()))

    return placed(cold).mapInPandas(whole, schema).unionByName(sided(both).mapInPandas(single, schema))
