"""Tables in the folder that all of a cluster's machines share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir. Where none is set, local mode (tests) gets a temporary folder and a cluster an error, as its machines share no local disk."""
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.conf.get("spark.tallywood.shared", None)
    if not at:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        at = "file://" + tempfile.mkdtemp(prefix="tallywood-")
        spark.conf.set("spark.tallywood.shared", at)
    return at.rstrip("/")


def place(spark: SparkSession, name: str = "table") -> str:
    """A path of its own in the shared folder."""
    return f"{folder(spark)}/{uuid.uuid4().hex}-{name}"


def saved(df: DataFrame, name: str = "table") -> DataFrame:
    """Write a table and read it back: lineage ends here, and what was written outlives executors."""
    path = place(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
