"""Tables between the steps of a run, in the shared folder that the session names: they cut the lineage, and a lost
executor costs nothing."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared_dir(spark) -> str:
    """spark.checkpoint.dir, or a checkpoint folder set before. Without either, a local master gets a temporary folder; a
    cluster is an error, as its executors would write to their own disks."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if root:
        return root
    held = spark.sparkContext._jsc.sc().getCheckpointDir()
    if held.isDefined():
        return held.get()
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="kindredge-"))
    return shared_dir(spark)


def grown(df: DataFrame) -> DataFrame:
    """``df`` as a side of a join, where both sides grow with the input: joined by sorting, whatever Spark estimates. It judges a
    side by its compressed bytes, and would broadcast tables that take the driver many times as much memory."""
    return df.hint("merge")


def save(df: DataFrame, name: str = "table") -> DataFrame:
    path = f"{shared_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
