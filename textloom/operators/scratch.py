"""Tables that jobs write for themselves, where lineage ends: in the folder that the driver and all executors share."""

from __future__ import annotations

import os
import re
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir. Where it is unset, a ``local`` master, as in tests, gets one of our own and a cluster an error."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found and not re.match(r"local(\[|$)", spark.sparkContext.master):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return (found or os.path.join(tempfile.gettempdir(), "textloom-scratch")).rstrip("/")


def place(spark: SparkSession, name: str) -> str:
    """A new path in that folder."""
    return f"{folder(spark)}/textloom-{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str) -> DataFrame:
    """``df`` written as Parquet and read back: what follows reads only the columns it needs, and a lost executor loses nothing."""
    path = place(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
