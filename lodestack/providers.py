"""Interfaces of what a model does, and stand-ins that need none: embeddings, completions, rerank scores."""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Protocol

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


class Embedder(Protocol):
    dim: int

    def embed(self, texts: list[str]) -> np.ndarray: ...


class Model(Protocol):
    name: str

    def complete(self, prompt: str) -> str: ...


class Scorer(Protocol):
    def score(self, pairs: list[tuple[str, str]]) -> list[float]: ...


def hash_embedding(text: str, dim: int = 384) -> np.ndarray:
    """Unit vector of signed word hashes; a text without words is the zero vector."""
    v = np.zeros(dim)
    for w in re.findall(r"\w+", text.lower()):
        h = xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass"))
        v[h % dim] += 1 if h >> 63 else -1
    n = np.linalg.norm(v)
    return v / n if n else v


class HashEmbedder:
    def __init__(self, dim: int = 384):
        self.dim = dim

    def embed(self, texts: list[str]) -> np.ndarray:
        return np.stack([hash_embedding(t, self.dim) for t in texts]) if texts else np.zeros((0, self.dim))


class OverlapScorer:
    """Share of the query's words that the text holds."""

    def score(self, pairs: list[tuple[str, str]]) -> list[float]:
        out = []
        for q, t in pairs:
            a, b = set(re.findall(r"\w+", (q or "").lower())), set(re.findall(r"\w+", (t or "").lower()))
            out.append(len(a & b) / len(a) if a else 0.0)
        return out


class EchoModel:
    """Answers each prompt with fixed text."""

    def __init__(self, reply: str = "[]", name: str = "echo"):
        self.reply, self.name = reply, name

    def complete(self, prompt: str) -> str:
        return self.reply


def embed(df: DataFrame, embedder: Embedder, text_col: str = "text", out: str = "embedding", batch: int = 32) -> DataFrame:
    """df with vectors of its texts, in batches; a null text is empty."""
    @F.pandas_udf("array<float>")
    def of(s: pd.Series) -> pd.Series:
        t = s.fillna("").tolist()
        return pd.Series([v for i in range(0, len(t), batch) for v in embedder.embed(t[i:i + batch]).astype("float32")], dtype="object")

    return df.withColumn(out, of(F.col(text_col)))


def rerank(pairs: DataFrame, scorer: Scorer, batch: int = 32) -> DataFrame:
    """pairs (query, text, ...) with rerank, scored in batches; a scorer that fails on a batch scores it 0."""
    @F.pandas_udf("double")
    def of(q: pd.Series, t: pd.Series) -> pd.Series:
        rows, out = list(zip(q.fillna(""), t.fillna(""))), []
        for i in range(0, len(rows), batch):
            part = rows[i:i + batch]
            try:
                s = [float(x) for x in scorer.score(part)]
            except Exception:  # a model may fail in any way; the row stays, unscored
                s = []
            out += s if len(s) == len(part) else [0.0] * len(part)
        return pd.Series(out, dtype="float64")

    return pairs.withColumn("rerank", of(F.col("query"), F.col("text")))


def grade(reply: str) -> int:
    """The first digit 0 to 3 of a reply, else 0."""
    m = re.search("[0-3]", reply or "")
    return int(m[0]) if m else 0


def json_list(reply: str) -> str | None:
    """The outermost list of a reply, without fences; null if there is none."""
    m = re.search(r"\[.*\]", reply or "", re.S)
    return m[0] if m else None


def complete_once(df: DataFrame, model: Model, cache: DataFrame, prompt_col: str = "prompt") -> DataFrame:
    """df with reply; replies in cache (key, reply) are not asked for again, and equal prompts are asked once.

    The key is the SHA-256 of prompt and model name; write `select key, reply` of the result back to keep them.
    """
    key = F.sha2(F.concat_ws("\x00", F.coalesce(prompt_col, F.lit("")), F.lit(model.name)), 256)
    keyed = df.withColumn("key", key)

    def ask(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf["key"], "reply": [model.complete(p) for p in pdf["p"]]})

    new = keyed.join(cache.select("key"), "key", "left_anti").groupBy("key").agg(F.first(F.coalesce(prompt_col, F.lit(""))).alias("p"))
    replies = cache.select("key", "reply").unionByName(new.mapInPandas(ask, "key string, reply string"))
    return keyed.join(replies, "key", "left")
