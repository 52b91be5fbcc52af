"""Shared helpers of the training-data operators: shared-folder tables, global row numbers, columns."""

from __future__ import annotations

import itertools
import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SPACE_WORDS = r"[^\x20\x09-\x0D]+"
_LOW33 = (1 << 33) - 1


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share; only where it is unset (tests) one is made."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not found:
        found = tempfile.mkdtemp(prefix="lodestack-")
        spark.conf.set("spark.checkpoint.dir", found)
    return found


def scratch(spark: SparkSession) -> str:
    """A new path for a table of this application; results may read from it until clean_up."""
    return f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}/{uuid.uuid4().hex}"


def clean_up(spark: SparkSession) -> None:
    """Delete all that this application wrote on the way. Call it when the results are stored."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{shared_dir(spark).rstrip('/')}/tables/{spark.sparkContext.applicationId}")
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def materialize(df: DataFrame) -> DataFrame:
    """Write df to the shared folder and read it back: lineage ends in files that outlive any executor."""
    spark = df.sparkSession
    path = scratch(spark)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ranked(df: DataFrame, *keys: Column, name: str = "rn") -> tuple[DataFrame, int]:
    """df in a table with the global row number (from 0) in the order of keys, and the row count.

    Rows are range-partitioned and sorted; only one count per partition reaches the driver.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    t = materialize(
        df.repartitionByRange(n, *keys).sortWithinPartitions(*keys)
        .select("*", F.spark_partition_id().alias("__part"), F.monotonically_increasing_id().bitwiseAND(F.lit(_LOW33)).alias("__seq"))
    )
    start, rows = 0, []
    for p, c in sorted((r[0], r[1]) for r in t.groupBy("__part").count().collect()):
        rows.append((p, start))
        start += c
    offsets = spark.createDataFrame(rows, "__part int, __start long")
    out = t.join(F.broadcast(offsets), "__part").withColumn(name, F.col("__start") + F.col("__seq"))
    return out.drop("__part", "__seq", "__start"), start


def slices(pdf, text_col: str, size: int = 1 << 21):
    """Parts of a pandas frame of about `size` characters of text, whole rows, at least one a part."""
    total = pdf[text_col].str.len().fillna(0).to_numpy("int64").cumsum()
    edge = [0, *(np.flatnonzero(np.diff(total // size)) + 1).tolist(), len(pdf)]
    for a, b in itertools.pairwise(edge):
        if a < b:
            yield pdf.iloc[a:b]


def bind(value: Column, body) -> Column:
    """body(value) with value evaluated once."""
    return F.transform(F.array(value), body)[0]


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")
