"""7. Reproducible shuffle into shards: a Feistel permutation with cycle walking over global row numbers.

Rows are numbered from 0 by a bucket, their id's and text's hash, then by id and text hash within it: buckets are counted first, so
one exchange by bucket numbers the rows and nothing is written on the way. The number, split over a x b >= N, goes through
alternating Feistel rounds and is walked again while it lies beyond N. Position p gives shard p mod S and slot
p div S: counts differ by at most one and slots have no gaps (law `rows`). Equal rows are alike, so it does not matter which of
them gets which of their numbers.

A cycle leaves the range at most a*b - N (less than a) times in a row, which for small N bounds the walk; for large
N each step leaves with a chance below 2/sqrt(N), and the bound is 64 steps. Null ids come first in their bucket, null texts have
size 16, equal rows get positions of their own, an empty table gives an empty result. The added columns replace
any of the same names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind, documents

SHARDS, SEED, ROUNDS, BUCKETS = 40, 7, 6, 8


def permute(x: Column, n: int, seed: int = SEED) -> Column:
    """A permutation of 0 .. n-1."""
    if n < 2:
        return x.cast("long")
    a = math.isqrt(n - 1) + 1
    b = -(-n // a)

    def once(v: Column) -> Column:
        pair = F.struct(F.floor(v / F.lit(b)).cast("long").alias("l"), (v % F.lit(b)).cast("long").alias("r"))
        for i in range(ROUNDS):
            l_new = (lambda i: lambda p: F.struct(
                (F.pmod(p["l"] + F.pmod(F.xxhash64(p["r"], F.lit(seed), F.lit(i)), F.lit(a)), F.lit(a)) if i % 2 == 0 else p["l"]).alias("l"),
                (p["r"] if i % 2 == 0 else F.pmod(p["r"] + F.pmod(F.xxhash64(p["l"], F.lit(seed), F.lit(i)), F.lit(b)), F.lit(b))).alias("r")))(i)
            pair = bind(pair, l_new)
        return bind(pair, lambda p: p["l"] * F.lit(b) + p["r"])

    steps = min(a * b - n, 64)
    first = once(x.cast("long"))
    if not steps:
        return first
    return F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda v, _: F.when(v < n, v).otherwise(once(v)))


def shard(df: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", seed: int = SEED) -> DataFrame:
    """df with shard (int) and slot (long)."""
    buckets = BUCKETS * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    base = df.drop("shard", "slot").withColumn("__tie", F.xxhash64(text_col))
    base = base.withColumn("__b", F.pmod(F.xxhash64(id_col, "__tie"), F.lit(buckets)).cast("int"))
    starts, n = [], 0
    for b, c in sorted((r[0], r[1]) for r in base.groupBy("__b").count().collect()):  # one row a bucket
        starts.append((b, n))
        n += c
    starts = F.broadcast(df.sparkSession.createDataFrame(starts, "__b int, __start long"))
    inside = F.row_number().over(Window.partitionBy("__b").orderBy(id_col, "__tie")) - 1
    rows = base.withColumn("__rn", inside).join(starts, "__b").withColumn("__rn", F.col("__start") + F.col("__rn")).drop("__start", "__b")
    rows = rows.withColumn("__pos", permute(F.col("__rn"), n, seed))
    slot = F.when(F.col("__pos") < n, F.floor(F.col("__pos") / shards).cast("long")).otherwise(F.raise_error("the walk left the rows' range").cast("long"))
    return rows.withColumn("shard", (F.col("__pos") % shards).cast("int")).withColumn("slot", slot).drop("__rn", "__pos", "__tie")


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    docs = documents(spark, sf_dir).select("doc_id", (F.octet_length(text) + 16).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    out = shard(docs, text_col="text_crc32")
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
