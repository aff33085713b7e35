"""Tables written once where a plan would otherwise compute the same rows again and again."""

from __future__ import annotations

import tempfile
import uuid
from contextlib import suppress

from pyspark.sql import DataFrame, SparkSession


def scratch_dir(spark: SparkSession) -> str:
    """A new path below the shared folder that spark.checkpoint.dir names.

    Where that is unset, a local session gets a folder of its own; a cluster is refused, as its executors and its driver
    would not see each other's local files.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", base)
    return f"{base.rstrip('/')}/tallyweave-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df written once to the shared folder and read back: cuts the lineage, and survives lost executors."""
    path = scratch_dir(df.sparkSession)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def discard(*tables: DataFrame) -> None:
    """Deletes what settled() wrote for these tables; nothing that is still to be computed may read them."""
    for df in tables:
        if path := getattr(df, "_scratch", None):
            spark = df.sparkSession
            with suppress(Exception):  # a table that stays costs disk only
                folder = spark._jvm.org.apache.hadoop.fs.Path(path)
                folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)
