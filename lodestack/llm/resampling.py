"""13. Importance resampling to a target distribution by inverted postings that are partitioned by feature bucket.

Features are a text's runs of 1 to `most` words; a feature's bucket is its crc32 modulo `buckets`. Tasks cut their documents
into chunks of bounded size and emit, for each bucket of a chunk, one block of postings: the chunk's documents that have the bucket,
with counts. Blocks are shuffled by bucket and salt, so a bucket that every document has is many blocks in several partitions,
and written. The two corpora's counts of a bucket meet by a join, which gives its gain. Where its blocks lie, a bucket's gain times each count is that
document's contribution; contributions are added up within a task, sent as blocks by chunk, and reduced by document there. A chunk holds at
most CHUNK bytes of texts or one long text, so no group is unbounded.

Gumbel noise from a hash of the seed and the id is added to the weights; the highest `share` per cent of the scores of
documents with at least `least` words are drawn, ranked by global row numbers without a single-task sort.

Null and empty texts have no features and weight 0; short texts are never drawn. A null id hashes as an empty one, repeated rows are drawn one by
one, ties go to the smaller id. An empty target leaves gains of the documents' counts alone; an empty table gives an empty result. Extra
columns are not carried.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, ranked, slices

BUCKETS, MOST, SEED, SHARE, LEAST, CHUNK, SALTS, HELD = 10_000, 3, 42, 5, 20, 1 << 23, 8, 1 << 22
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
POSTINGS = "chunk long, bucket int, total long, n int, docs binary, counts binary, ids array<string>, n_words array<long>, n_features array<long>"


def features(text: bytes, most: int = MOST) -> tuple[int, np.ndarray]:
    """The number of words, and the crc32 of each run of 1 to most words; a run's goes on from that of the run before."""
    words = text.translate(_FOLD).split()
    sums, more, out = list(map(crc32, words)), [b" " + w for w in words], []
    for n in range(most):
        if n:
            sums = list(map(crc32, more[n:], sums[:-1]))
        if not sums:
            break
        out.append(np.array(sums, np.uint32))
    return len(words), np.concatenate(out) if out else np.zeros(0, np.uint32)


def packed(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Values as single bytes, and the places of those that are larger: they follow behind in four bytes each."""
    return np.minimum(values, 255).astype(np.uint8), np.flatnonzero(values >= 255)


def unpacked(b: bytes, n: int) -> np.ndarray:
    out = np.frombuffer(b, np.uint8, n).astype(np.int64)
    if len(b) > n:
        out[out == 255] = np.frombuffer(b, "<u4", offset=n)
    return out


def postings(df: DataFrame, id_col: str, text_col: str, buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """POSTINGS: a block for each bucket of a chunk, and for each chunk one row without bucket that lists its documents.

    docs: distances between the chunk's numbers of the documents that have the bucket; counts: how often.
    """
    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, no = TaskContext.get().partitionId(), 0
        for pdf in batches:
            for rows in slices(pdf, "t", CHUNK):
                chunk, found = (part << 32) + no, [features(t, most) for t in rows["t"]]
                no += 1
                n = np.array([len(f) for _, f in found], np.int64)
                yield pd.DataFrame({"chunk": [chunk], "bucket": pd.array([None], "Int32"), "total": [int(n.sum())], "n": [0], "docs": [None], "counts": [None],
                                    "ids": [rows["id"].tolist()], "n_words": [[w for w, _ in found]], "n_features": [n.tolist()]})
                key = np.concatenate([f for _, f in found]).astype(np.int64) % buckets * len(found) + np.repeat(np.arange(len(found)), n)
                key.sort()
                first = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
                count, bucket, doc = np.diff(np.r_[first, len(key)]), key[first] // len(found), key[first] % len(found)
                edge = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]]) if len(bucket) else np.zeros(0, np.int64)
                step = np.diff(np.r_[0, doc])
                step[edge] = doc[edge]
                stop = np.r_[edge[1:], len(bucket)]

                def cut(values: np.ndarray, edge=edge, stop=stop) -> list[bytes]:
                    small, large = packed(values)
                    whole, far, wide = small.tobytes(), values[large].astype("<u4").tobytes(), np.searchsorted(large, np.r_[edge, len(values)]) * 4
                    return [whole[a:b] + far[c:d] for a, b, (c, d) in zip(edge.tolist(), stop.tolist(), itertools.pairwise(wide.tolist()))]

                if len(edge):
                    yield pd.DataFrame({"chunk": chunk, "bucket": pd.array(bucket[edge], "Int32"), "total": np.add.reduceat(count, edge), "n": stop - edge, "docs": cut(step), "counts": cut(count), "ids": None, "n_words": None, "n_features": None})

    src = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return src.mapInPandas(blocks, POSTINGS)


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, gain) of the buckets that docs has: the log of the target's share over the documents' share, smoothed by one, in thousandths."""
    s, t = (x.filter("bucket is not null").groupBy("bucket").agg(F.sum("total").alias(name)) for x, name in ((docs, "s"), (target, "t")))
    both = materialize(s.join(t, "bucket", "left").withColumn("t", F.coalesce("t", F.lit(0))))
    all_s, all_t = both.agg(F.sum("s")).first()[0] or 0, target.filter("bucket is null").agg(F.sum("total")).first()[0] or 0
    ratio = (F.col("t") + 1).cast("double") * F.lit(float(all_s + buckets)) / ((F.col("s") + 1).cast("double") * F.lit(float(all_t + buckets)))
    return both.select("bucket", F.floor(F.lit(1000.0) * F.log(ratio)).cast("long").alias("gain"))


def weights(df: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS, most: int = MOST) -> DataFrame:
    """(id, chunk, at, n_words, n_features, weight), one row per row of df; (chunk, at) names the row."""
    spark = df.sparkSession
    parts, salt = int(spark.conf.get("spark.sql.shuffle.partitions")), F.when(F.col("bucket").isNotNull(), F.pmod(F.xxhash64("chunk"), F.lit(SALTS))).otherwise(F.xxhash64("chunk"))
    rows = materialize(postings(df, id_col, text_col, buckets, most).repartition(parts, "bucket", salt))
    aim = materialize(postings(target.select(F.lit(None).cast("string").alias("__id"), target_col), "__id", target_col, buckets, most))
    gain = gains(rows, aim, buckets)  # at most `buckets` rows

    def contributions(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums, held = {}, 0

        def sent() -> pd.DataFrame:
            at = {c: np.flatnonzero(s) for c, s in sums.items()}
            return pd.DataFrame({"chunk": list(sums), "at": [at[c].astype("<u4").tobytes() for c in sums], "part": [s[at[c]].astype("<i8").tobytes() for c, s in sums.items()]})

        for pdf in batches:
            for chunk, n, docs, counts, g in zip(pdf["chunk"], pdf["n"], pdf["docs"], pdf["counts"], pdf["gain"]):
                place = unpacked(docs, n).cumsum()
                own = sums.get(chunk)
                if own is None or len(own) <= place[-1]:
                    grown = np.zeros(int(place[-1]) + 1 + (len(own) if own is not None else 0), np.int64)
                    if own is not None:
                        grown[:len(own)] = own
                        held -= len(own)
                    own = sums[chunk] = grown
                    held += len(own)
                own[place] += unpacked(counts, n) * g
            if held > HELD:
                yield sent()
                sums.clear()
                held = 0
        if sums:
            yield sent()

    blocks = rows.filter("bucket is not null").select("chunk", "bucket", "n", "docs", "counts").join(F.broadcast(gain), "bucket").filter("gain != 0")
    sums = blocks.select("chunk", "n", "docs", "counts", "gain").mapInPandas(contributions, "chunk long, at binary, part binary")
    sums = sums.select("*", *[F.lit(None).cast(rows.schema[c].dataType).alias(c) for c in ("ids", "n_words", "n_features")])
    listed = rows.filter("bucket is null").select("chunk", *[F.lit(None).cast("binary").alias(c) for c in ("at", "part")], "ids", "n_words", "n_features")

    def reduced(pdf: pd.DataFrame) -> pd.DataFrame:
        own = pdf[pdf["ids"].notna()].iloc[0]
        out = np.zeros(len(own["ids"]), np.int64)
        for at, part in zip(pdf["at"], pdf["part"]):
            if at is not None:
                out[np.frombuffer(at, "<u4")] += np.frombuffer(part, "<i8")
        return pd.DataFrame({"id": own["ids"], "chunk": pdf["chunk"].iloc[0], "at": np.arange(len(out)), "n_words": own["n_words"], "n_features": own["n_features"], "weight": out})

    return sums.unionByName(listed).groupBy("chunk").applyInPandas(reduced, "id string, chunk long, at int, n_words long, n_features long, weight long")


def noise(name: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the first 32 bits of sha256 of seed and name."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(name, F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return F.floor(F.lit(-1000.0) * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


def resample(df: DataFrame, target: DataFrame, share: int = SHARE, least: int = LEAST, seed: int = SEED, id_col: str = "doc_id", **more) -> DataFrame:
    """(id_col, n_words, n_features, weight, score, rank), one row per row of df; rank is null for what is not drawn."""
    w = materialize(weights(df, target, id_col, **more))
    kind = df.schema[id_col].dataType
    w = w.withColumn("score", F.col("weight") + noise(F.col("id"), seed)).withColumn(id_col, F.col("id").cast(kind))
    long_enough = F.col("n_words") >= least
    rows, n = ranked(w.filter(long_enough), F.desc("score"), F.col(id_col), F.col("chunk"), F.col("at"), name="__rn")
    drawn = rows.withColumn("rank", F.when(F.col("__rn") < share * n // 100, F.col("__rn") + 1)).drop("__rn")
    out = drawn.unionByName(w.filter(~long_enough).withColumn("rank", F.lit(None).cast("long")))
    return out.select(id_col, "n_words", "n_features", "weight", "score", F.col("rank").cast("long"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = resample(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")
