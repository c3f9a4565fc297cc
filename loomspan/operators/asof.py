"""Attributes as known at event time.

Events and attribute changes go into one stream per entity, sorted by the time
from which each is available, with an explicit priority at equal times
(changes before events), and the best known change is carried forward by a
running maximum. Hot entities: events shrink to their distinct (entity, time)
before any sort, changes to one per (entity, time), and each entity's stream
is cut into time tiles; what earlier tiles contribute arrives as one carried row.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Attributes:
    """A history of attribute changes.

    valid_from: in force from then on; known_at: not known before; both
    must have been reached at the event. Of several the one with the greatest
    `rank` columns wins (nulls lowest). `where` drops changes that never count.
    """

    df: DataFrame
    entity: str
    valid_from: str
    known_at: str
    rank: Sequence[str]
    where: Column | None = None


def as_known_at(events: DataFrame, entity: str, time: Column, histories: Mapping[str, Attributes], tile_seconds: int = 90 * 86400) -> DataFrame:
    """Events with, for each history, a struct column of its `rank` columns: the change in force and known.

    Returns all columns of `events` and one struct per history (null where
    nothing was known; null entity or time: nothing is known). Every event row
    comes back once, repeats too. A change exactly at the event's time counts.
    Changes with a null valid_from or known_at never count.
    """
    ev = events.withColumn("_t", time.cast("timestamp"))
    slots = ev.where(F.col(entity).isNotNull() & F.col("_t").isNotNull()).select(F.col(entity).alias("_e"), "_t").distinct()
    names = list(histories)
    tile = lambda c: F.floor(F.unix_timestamp(c) / tile_seconds)
    types = {n: F.struct(*[F.col(c) for c in h.rank]) for n, h in histories.items()}

    changes = None
    for n in names:
        h = histories[n]
        d = h.df if h.where is None else h.df.where(h.where)
        d = d.where(F.col(h.entity).isNotNull() & F.col(h.valid_from).isNotNull() & F.col(h.known_at).isNotNull())
        d = d.groupBy(F.col(h.entity).alias("_e"), F.greatest(F.col(h.valid_from).cast("timestamp"), F.col(h.known_at).cast("timestamp")).alias("_t")).agg(F.max(types[n]).alias(n))
        changes = d if changes is None else changes.unionByName(d, allowMissingColumns=True)
    changes = changes.withColumn("_tile", tile(F.col("_t")))

    best = [F.max(n).alias(n) for n in names]
    # per (entity, tile): the best change of all earlier tiles
    per_tile = changes.groupBy("_e", "_tile").agg(*best)
    wanted = slots.select("_e", tile(F.col("_t")).alias("_tile")).distinct()
    tiles = per_tile.unionByName(wanted, allowMissingColumns=True).groupBy("_e", "_tile").agg(*best)
    before = Window.partitionBy("_e").orderBy("_tile").rowsBetween(Window.unboundedPreceding, -1)
    carried = tiles.select("_e", "_tile", *[F.max(n).over(before).alias(n) for n in names])
    stream = (
        carried.withColumn("_t", F.lit(None).cast("timestamp")).withColumn("_p", F.lit(0))
        .unionByName(changes.withColumn("_p", F.lit(1)))
        .unionByName(slots.withColumn("_tile", tile(F.col("_t"))).withColumn("_p", F.lit(2)), allowMissingColumns=True)
    )
    # nulls sort first: the carried row leads its tile
    upto = Window.partitionBy("_e", "_tile").orderBy("_t", "_p").rowsBetween(Window.unboundedPreceding, 0)
    known = stream.select("_e", "_t", "_p", *[F.max(n).over(upto).alias(n) for n in names]).where("_p = 2").drop("_p")
    known = known.select(F.col("_e").alias("_ke"), F.col("_t").alias("_kt"), *[F.col(n).alias(f"_k_{n}") for n in names])
    out = ev.join(known, (ev[entity] == known["_ke"]) & (ev["_t"] == known["_kt"]), "left")
    return out.select(*[events[c] for c in events.columns], *[F.col(f"_k_{n}").alias(n) for n in names])
