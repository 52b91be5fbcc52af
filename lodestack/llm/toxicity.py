"""5. Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Features are the distinct hashed words, pairs and pairs with one word between, of the whole text. Training takes a
bounded sample of labelled rows (`sample` rows, least by hash of id, default 20,000, and at most `most` features in all, default 40 million), one pass after another, with
per-coordinate rates and L1 sparsity; the weights left are at most `1 << bits` floats, a proven broadcast bound.

Null and empty texts get the bias alone; without any label every score is 0.0. A null id is never trained on.
Rows repeated in labels count once, as toxic if any says so. The score depends on the text only.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize

BITS, SAMPLE, FEATURES, EPOCHS, THRESHOLD = 20, 20000, 40_000_000, 5, 0.3
_WORD = re.compile(r"[^\W_]+")


class _Ids(dict):
    def __missing__(self, word: str) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = zlib.crc32(word.encode("utf-8", "surrogatepass"))
        return h


def features(text: str | None, bits: int, ids: dict) -> np.ndarray:
    w = np.array([ids[x] for x in _WORD.findall((text or "").lower())], np.uint64)
    p, q = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
    grams = [w * p, (w[:-1] * p ^ w[1:] * q) * p, (w[:-2] * q ^ w[2:] * p) * q]
    return np.unique(np.concatenate(grams) >> np.uint64(64 - bits)).astype(np.int32)


def ftrl(rows: list[np.ndarray], labels: np.ndarray, bits: int = BITS, epochs: int = EPOCHS, alpha: float = 0.5, beta: float = 1.0, l1: float = 6.0, l2: float = 1.0) -> np.ndarray:
    """Weights, the last one the bias (not penalised)."""
    size = 1 << bits
    z, n = np.zeros(size + 1), np.zeros(size + 1)
    pen = np.full(size + 1, l1)
    pen[size] = 0.0

    def weights(i):
        return np.where(np.abs(z[i]) <= pen[i], 0.0, -(z[i] - np.sign(z[i]) * pen[i]) / ((beta + np.sqrt(n[i])) / alpha + l2))

    for e in range(epochs):
        for r in np.random.default_rng(e).permutation(len(rows)):
            i = np.append(rows[r], size)
            w = weights(i)
            g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - labels[r]
            s = (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / alpha
            z[i] += g - s * w
            n[i] += g * g
    return weights(np.arange(size + 1)).astype(np.float32)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample: int = SAMPLE, bits: int = BITS, most: int = FEATURES) -> np.ndarray | None:
    """Weights from the labelled rows of least hash: at most `sample` rows and `most` features, whatever the texts' length.

    One task of an executor fits them; only the weights left reach the driver.
    """
    chosen = labels.filter(F.col(id_col).isNotNull() & F.col("toxic").isNotNull()).groupBy(id_col).agg(F.max("toxic").alias("__toxic"))
    chosen = chosen.orderBy(F.xxhash64(id_col), id_col).limit(sample)

    @F.pandas_udf("array<int>")
    def hashed(s: pd.Series) -> pd.Series:
        ids = _Ids()
        return pd.Series([features(x, bits, ids) for x in s], dtype="object")

    rows = docs.select(id_col, text_col).join(F.broadcast(chosen), id_col).select(F.xxhash64(id_col).alias("o"), hashed(F.col(text_col)).alias("f"), F.col("__toxic").cast("double").alias("y"))
    rows = materialize(rows.select("*", F.xxhash64("f").alias("h"), F.size("f").alias("n")))
    order = rows.select("o", "h", "n").orderBy("o", "h").limit(sample).toPandas()
    if order.empty:
        return None
    kept = max(1, int((order["n"].cumsum() <= most).sum()))
    last_o, last_h = int(order["o"].iloc[kept - 1]), int(order["h"].iloc[kept - 1])
    taken = rows.filter((F.col("o") < last_o) | ((F.col("o") == last_o) & (F.col("h") <= last_h)))

    def fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        f, y = [], []
        for pdf in batches:  # equal rows of one id may go on beyond the bound
            f += [np.asarray(x, np.int32) for x in pdf["f"][:kept - len(f)]]
            y += pdf["y"][:kept - len(y)].tolist()
        if f:
            w = ftrl(f, np.array(y), bits)
            at = np.flatnonzero(w)
            yield pd.DataFrame({"i": at, "w": w[at]})

    found = taken.repartition(1).sortWithinPartitions("o", "h").mapInPandas(fit, "i int, w float").toPandas()
    out = np.zeros((1 << bits) + 1, np.float32)
    out[found["i"].to_numpy()] = found["w"].to_numpy()
    return out


def score(df: DataFrame, weights: np.ndarray | None, text_col: str = "text", bits: int = BITS, out: str = "score") -> DataFrame:
    if weights is None:
        return df.withColumn(out, F.lit(0.0))
    held = df.sparkSession.sparkContext.broadcast((np.flatnonzero(weights).astype(np.int32), weights[np.flatnonzero(weights)]))

    @F.pandas_udf("double")
    def of(s: pd.Series) -> pd.Series:
        w, ids = np.zeros((1 << bits) + 1), _Ids()
        w[held.value[0]] = held.value[1]
        return pd.Series([1 / (1 + np.exp(-np.clip(w[features(x, bits, ids)].sum() + w[-1], -35, 35))) for x in s], dtype="float64")

    return df.withColumn(out, of(F.col(text_col)))


def held_out(c: Column) -> Column:
    return F.coalesce(F.crc32(c.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_documents(spark: SparkSession, docs: DataFrame, sf_dir: str, out: str = "score") -> DataFrame:
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").filter(~held_out(F.col("doc_id")))
    return score(docs, train(documents(spark, sf_dir), labels), out=out)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = score_documents(spark, documents(spark, sf_dir).select("doc_id", "text"), sf_dir)
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
