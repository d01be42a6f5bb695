"""Tables in the folder that driver and executors share (spark.checkpoint.dir)."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where it is unset, a local master takes a new folder of its machine; on a cluster that is an error."""
    sc = spark.sparkContext
    told = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not told:
        own = sc._jsc.sc().getCheckpointDir()
        if own.isDefined():
            told = own.get()
        elif sc.master.startswith("local"):
            told = tempfile.mkdtemp(prefix="topicspark-")
            sc.setCheckpointDir(told)
        else:
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return told


def new_folder(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_folder(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written as a Parquet table in the shared folder, in a folder for each value of by, and read again: its plan starts
    at the files."""
    path = new_folder(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path) if by else df.sparkSession.read.parquet(path)


def estimated_bytes(df: DataFrame) -> int:
    """What the optimizer takes df's size to be; of unknown inputs very large."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
