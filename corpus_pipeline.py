"""The corpus pipeline: toxicity, near duplicates, benchmark decontamination, mixing, sharding.

Every stage takes (spark, docs, sf_dir); its result is written as Parquet and reread as the next one's docs. Null
texts are empty texts to every stage; rows without words are near duplicates of each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestack.llm.common import scratch
from lodestack.llm.decontamination import decontaminate
from lodestack.llm.mixing import mix, with_size
from lodestack.llm.sharding import SHARDS, shard
from lodestack.llm.simhash import keep_one
from lodestack.llm.toxicity import THRESHOLD, score_documents


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below the threshold."""
    return score_documents(spark, docs, sf_dir, out="__score").filter(F.col("__score") < THRESHOLD).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: five-word shingles, similarity 0.8 or more, verified."""
    return keep_one(docs, words_per_shingle=5, similarity=0.8)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark window."""
    return decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix takes it."""
    taken = mix(with_size(docs)).filter("times > 0")
    return taken.withColumn("__k", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*docs.columns)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed corpus, text and all, with each row's shard and slot."""
    return shard(docs, SHARDS)


STAGES = [("toxicity", toxicity), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    at = scratch(spark)
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{at}/{name}")
        docs = spark.read.parquet(f"{at}/{name}")
    return docs
