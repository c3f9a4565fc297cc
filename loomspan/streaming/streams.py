"""Structured Streaming over event streams: windows, watermarks and stateful replay."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomspan.session import shared_folder


def read_events(spark: SparkSession, folder: str, schema, max_files: int = 4) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).parquet(folder)


def tumbling(df: DataFrame, ts: str, width: str, late: str, by: list[str], value: str) -> DataFrame:
    """Count and sum per key and tumbling window; rows later than `late` are dropped."""
    w = df.withWatermark(ts, late).groupBy(F.window(ts, width), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*by, F.col("window.start").alias("start"), "n", "total")


def sliding(df: DataFrame, ts: str, width: str, slide: str, late: str, by: list[str], value: str) -> DataFrame:
    w = df.withWatermark(ts, late).groupBy(F.window(ts, width, slide), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*by, F.col("window.start").alias("start"), "n", "total")


def sessions(df: DataFrame, ts: str, gap: str, late: str, by: list[str], value: str) -> DataFrame:
    w = df.withWatermark(ts, late).groupBy(F.session_window(ts, gap), *by)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n", "total")


def running_book(df: DataFrame, key: str, ts: str, kind: str, qty: str, order: str, late: str = "500 milliseconds") -> DataFrame:
    """Per key and micro-batch the resting quantity after its events: add raises, fill and cancel lower it, never below 0.

    State is one number and two counters a key; events of a batch apply in order of time, then of `order`.
    """

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rest, n, clipped = state.get if state.exists else (0.0, 0, 0)
        rows = pd.concat(list(frames)).sort_values([ts, order], kind="stable")
        for what, q in zip(rows[kind], rows[qty], strict=True):
            rest = rest + q if what == "add" else rest - q
            if rest < 0:
                rest, clipped = 0.0, clipped + 1
            n += 1
        state.update((float(rest), int(n), int(clipped)))
        yield pd.DataFrame({key: [k[0]], "resting": [float(rest)], "events": [int(n)], "clipped": [int(clipped)]})

    t = dict(df.dtypes)[key]
    return df.withWatermark(ts, late).groupBy(key).applyInPandasWithState(step, f"{key} {t}, resting double, events long, clipped long", "resting double, events long, clipped long", "update", GroupStateTimeout.NoTimeout)


def run_available(stream: DataFrame, out: str, checkpoint: str, mode: str = "append", fmt: str = "parquet") -> None:
    """Processes what there is and stops; the checkpoint is the high-water mark of the next run."""
    stream.writeStream.format(fmt).outputMode(mode).option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def run_to_files(stream: DataFrame, mode: str = "complete") -> DataFrame:
    """Processes what there is and gives the result back from files in the shared folder; nothing is gathered in the driver.

    Each micro-batch is written by the executors, a repeated one over its first try. complete: the last batch, which has all rows;
    update and append: the batches' rows with their number in `batch`.
    """
    spark = stream.sparkSession
    out = f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"
    done: list[int] = []

    def put(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")
        done.append(batch)

    stream.writeStream.foreachBatch(put).outputMode(mode).option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start().awaitTermination()
    if not done:
        return spark.createDataFrame([], stream.schema) if mode == "complete" else spark.createDataFrame([], stream.schema).withColumn("batch", F.lit(0))
    if mode == "complete":
        return spark.read.schema(stream.schema).parquet(f"{out}/rows/batch={max(done)}")
    return spark.read.option("basePath", f"{out}/rows").parquet(*[f"{out}/rows/batch={b}" for b in sorted(set(done))])


def last_state(updates: DataFrame, key: str) -> DataFrame:
    """Of each key the row of its last batch."""
    rest = [c for c in updates.columns if c not in (key, "batch")]
    return updates.groupBy(key).agg(F.max_by(F.struct(*rest), "batch").alias("_r")).select(key, "_r.*")
