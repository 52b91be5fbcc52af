"""Parquet tables of a data directory, and tables written on the way."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where it is unset (tests) one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found.rstrip("/")


def path(spark: SparkSession) -> str:
    """A new path for tables of this application in the shared folder."""
    return f"{shared(spark)}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application wrote on the way. Call it when the results are stored."""
    at = spark._jvm.org.apache.hadoop.fs.Path(f"{shared(spark)}/tables/{spark.sparkContext.applicationId}")
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


def written(df: DataFrame) -> DataFrame:
    """df written to the shared folder and read back: its lineage ends in files that outlive any executor."""
    at = path(df.sparkSession)
    df.write.parquet(at)
    return df.sparkSession.read.schema(df.schema).parquet(at)
