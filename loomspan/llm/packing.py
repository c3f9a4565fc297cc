"""Filling containers of fixed capacity with texts, balanced by attention cost.

A text of n tokens costs n + n*n/scale: the linear part of a model's work and the
quadratic one of attention. Texts go, longest first, to the container that has the
lowest cost so far among those with room. Texts are spread over shards by a hash,
each of a bounded number of tokens, and shards are packed in parallel; only the
last containers of a shard can be less than full.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomspan.session import checkpoint


def pack(sizes: Sequence[int], capacity: int, scale: float = 4096.0) -> np.ndarray:
    """Container number of each size (all <= capacity), for sizes in descending order.

    Starts from as few containers as the total needs and takes, per item, the
    lowest-cost container with room; a new one is opened when none has room.
    """
    sizes = np.asarray(sizes, np.int64)
    out = np.zeros(len(sizes), np.int64)
    if not len(sizes):
        return out
    used = int(-(-int(sizes.sum()) // capacity))
    room = np.full(used + len(sizes) // 8 + 8, -1, np.int64)
    cost = np.full(len(room), np.inf)
    room[:used], cost[:used] = capacity, 0.0
    for k, n in enumerate(sizes.tolist()):
        c = int(np.where(room[:used] >= n, cost[:used], np.inf).argmin())
        if room[c] < n:
            if used == len(room):
                room, cost = np.r_[room, np.full(used, -1)], np.r_[cost, np.full(used, np.inf)]
            c, used = used, used + 1
            room[c], cost[c] = capacity, 0.0
        out[k] = c
        room[c] -= n
        cost[c] += n + n * n / scale
    return out


def containers(docs: DataFrame, item: str, size: str, capacity: int = 2048, scale: float = 4096.0, shard_tokens: int = 8_000_000) -> DataFrame:
    """(item, piece, start, n_tokens, container): where each text, or piece of it, goes.

    Only an item larger than `capacity` is split: into full containers of its own and
    one rest that is packed like an item; start is the piece's first token. Empty or null items take no room
    and get container null. Rows are items: repeats, and rows without an id, are packed each. container is
    <shard>-<number>, or full-<item>-<row>-<piece> for a full one, unique over all. Items of one size go in the
    order of `item`, so what shares a container is deterministic for unique items. Rows of an id whose repeats hold
    much of a shard are spread over all shards. An empty table gives no rows.
    """
    n = F.coalesce(F.col(size).cast("long"), F.lit(0).cast("long"))
    d = docs.select(F.col(item).alias("item"), n.alias("n"), F.monotonically_increasing_id().alias("row"))
    d = checkpoint(d)  # sizes are counted once, and row numbers stay
    total = d.agg(F.sum("n")).first()[0] or 0
    shards = max(1, -(-total // shard_tokens))
    pieces = d.select("item", "n", "row", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.ceil(F.col("n") / capacity).cast("long") - 1, F.lit(0).cast("long")))).alias("piece"))
    pieces = pieces.withColumn("start", F.col("piece") * capacity).withColumn("n_tokens", F.least(F.col("n") - F.col("start"), F.lit(capacity).cast("long")))
    full = pieces.where(F.col("n_tokens") == capacity).withColumn("container", F.concat_ws("-", F.lit("full"), F.col("item").cast("string"), F.col("row").cast("string"), F.col("piece").cast("string")))
    void = pieces.where("n_tokens = 0").withColumn("container", F.lit(None).cast("string"))
    part = pieces.where(f"n_tokens > 0 and n_tokens < {capacity}")
    salt = F.lit(None).cast("long")
    if shards > 1:
        # at most 8 * shards ids; the rest of a unique item is smaller than `capacity` and never among them
        heavy = [r["item"] for r in part.groupBy("item").agg(F.sum("n_tokens").alias("m")).where(F.col("m") > max(capacity, shard_tokens // 8)).select("item").collect()]
        known = [x for x in heavy if x is not None]
        many = F.coalesce(F.col("item").isin(known), F.lit(False)) if known else F.lit(False)
        salt = F.when(many | F.col("item").isNull() if len(known) < len(heavy) else many, F.col("row"))
    # hashing a null changes nothing
    part = part.withColumn("shard", F.pmod(F.xxhash64("item", "piece", salt), F.lit(shards)).cast("long"))
    part = part.select("item", "piece", "start", "n_tokens", "shard")
    kind = dict(d.dtypes)["item"]

    def solve(g: pd.DataFrame) -> pd.DataFrame:
        g = g.sort_values(["n_tokens", "item", "piece"], ascending=[False, True, True], kind="stable")
        c = pack(g["n_tokens"].to_numpy(), capacity, scale)
        return g.assign(container=c)[["item", "piece", "start", "n_tokens", "shard", "container"]]

    packed = part.groupBy("shard").applyInPandas(solve, f"item {kind}, piece long, start long, n_tokens long, shard long, container long")
    packed = packed.withColumn("container", F.concat_ws("-", F.col("shard").cast("string"), F.col("container").cast("string")))
    cols = ["item", "piece", "start", "n_tokens", "container"]
    out = packed.select(cols).unionByName(full.select(cols)).unionByName(void.select(cols))
    return out.withColumnRenamed("item", item)
