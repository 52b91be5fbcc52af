"""4. Token counts by heap-and-linked-list byte-pair merging, for the vocabulary of a sentencepiece BPE model.

Spaces become U+2581 and one is put in front (the model's normaliser is the identity); symbols are code points.
The adjacent pair of the best score, leftmost first, is popped from a heap and merged in a linked list. The count
is initial symbols minus merges, plus the further bytes of code points outside the vocabulary (byte fallback).
No identifiers are made. Where no piece holds U+2581 after another character, merges cannot cross such a
boundary, and texts are counted by parts with a bounded cache.

Null and empty texts have 0 tokens. Repeated rows get equal counts; other columns are kept.
"""

from __future__ import annotations

import heapq
import re
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents

MODEL, LIMIT = "piece_bpe_32k.model", 4096
SPACE = "▁"


class Counter:
    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        sp = SentencePieceProcessor(model_file=path)
        special = [i for i in range(sp.get_piece_size()) if sp.is_control(i) or sp.is_unknown(i) or sp.is_byte(i) or sp.is_unused(i)]
        skip = set(special)
        self.rank = {sp.id_to_piece(i): -sp.get_score(i) for i in range(sp.get_piece_size()) if i not in skip}
        split = not any(SPACE in p.lstrip(SPACE) for p in self.rank)
        self.parts = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+" if split else r"(?s:.+)").findall
        self.short = lru_cache(1 << 17)(self.merged)

    def merged(self, s: str) -> int:
        rank, n = self.rank, len(s)
        if n > 1 and s in rank and n == 2:
            return 1
        sym, prev, nxt = list(s), list(range(-1, n - 1)), list(range(1, n + 1))
        heap = []
        for i in range(n - 1):
            r = rank.get(s[i:i + 2])
            if r is not None:
                heap.append((r, i, 2))
        heapq.heapify(heap)
        count = n
        while heap:
            r, i, size = heapq.heappop(heap)
            j = nxt[i] if sym[i] else n
            if j >= n or len(sym[i]) + len(sym[j]) != size:
                continue
            sym[i] += sym[j]
            sym[j] = ""
            count -= 1
            k = nxt[i] = nxt[j]
            if k < n:
                prev[k] = i
                x = sym[i] + sym[k]
                if x in rank:
                    heapq.heappush(heap, (rank[x], i, len(x)))
            h = prev[i]
            if h >= 0:
                x = sym[h] + sym[i]
                if x in rank:
                    heapq.heappush(heap, (rank[x], h, len(x)))
        return count + sum(len(x.encode("utf-8", "surrogatepass")) - 1 for x in sym if len(x) == 1 and x not in rank)

    def __call__(self, text: str | None) -> int:
        if not text:
            return 0
        return sum(self.short(p) if len(p) <= 48 else self.merged(p) for p in self.parts(SPACE + text.replace(" ", SPACE)))


@lru_cache(2)
def counter(path: str) -> Counter:
    return Counter(path)


def count_tokens(df: DataFrame, path: str, text_col: str = "text", out: str = "n_tokens") -> DataFrame:
    @F.pandas_udf("long")
    def count(s: pd.Series) -> pd.Series:
        c = counter(path)
        return pd.Series([c(x) for x in s], dtype="int64")

    return df.withColumn(out, count(F.col(text_col)))


def op4_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = count_tokens(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(MODEL))
    return out.select("doc_id", F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"), "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))
