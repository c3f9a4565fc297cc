"""Session settings and lineage cuts that hold up on a cluster."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Settings under which every operator here is written and tested.
DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
}


def local_session(app: str = "loomspan", cores: str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and the bench. Clusters bring their own."""
    b = SparkSession.builder.master(f"local[{cores}]").appName(app)
    for k, v in {**DEFAULTS, "spark.sql.shuffle.partitions": str(shuffle_partitions), "spark.ui.enabled": "false", "spark.driver.memory": "8g", **conf}.items():
        b = b.config(k, v)
    return b.getOrCreate()


def on_one_machine(master: str) -> bool:
    return re.fullmatch(r"local(\[.*\])?", master) is not None


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, which all executors and the driver reach.

    It is read from the session. Where none is set, one on this machine is made only if the session runs on this machine
    alone (master local), as in tests; on a cluster executors could not share it, so there RuntimeError.
    """
    sc = spark.sparkContext
    where = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if where:
        return where
    if not on_one_machine(sc.master):
        raise RuntimeError("spark.checkpoint.dir names no shared folder")
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        sc.setCheckpointDir(tempfile.mkdtemp(prefix="loomspan-cp-"))
    return sc._jsc.sc().getCheckpointDir().get()


def checkpoint(df: DataFrame) -> DataFrame:
    """Cut lineage in the shared folder."""
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        where = shared_folder(df.sparkSession)
        if not sc._jsc.sc().getCheckpointDir().isDefined():
            sc.setCheckpointDir(where)
    return df.checkpoint()


def written(df: DataFrame) -> DataFrame:
    """`df` stored as a compressed table in the shared folder and read back: for results too large for a checkpoint's plain rows."""
    path = f"{shared_folder(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
