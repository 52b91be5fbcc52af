"""11. Packing by concatenation and cutting: two passes of prefix sums give each document its place in one long row of ids.

Documents are tokenized once, an end id behind each, into a written table whose rows know their first id within their
partition. Partition totals, one number a partition, are summed up on the driver; with them every row knows its global
place, and rows are cut into fixed windows where they lie: no shuffle, and a long document is cut like any other. A
document across a window's edge leaves one record on each side of it. What is behind the last full window is cut at powers of two, so
no sequence needs padding.

The order is that of the input's partitions and rows; equal inputs in equal layouts give equal packings. Null and empty
texts are the end id alone. Repeated rows are packed as often as they occur, null ids are kept, extra columns are not carried; an
empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import itertools
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import ByteTokens
from .common import documents, materialize, slices

VOCABULARY, WINDOW, END = "byte_bpe_50k.json", 2048, 1


@lru_cache(2)
def encoder(path: str) -> ByteTokens:
    return ByteTokens(path)


def tail_edges(total: int, window: int) -> list[int]:
    """Edges from the last full window to the end, powers of two apart, greatest first."""
    at = total // window * window
    edges, left = [at], total - at
    while left:
        step = 1 << (left.bit_length() - 1)
        edges.append(edges[-1] + step)
        left -= step
    return edges


def cut(start: int, n: int, window: int, tail: list[int]) -> Iterator[tuple[int, int, int, int]]:
    """(first id, length, sequence, offset) of the pieces of a document of n ids that begins at a global place."""
    inner = range((start // window + 1) * window, min(start + n, tail[0] + 1), window)
    edges = [start, *inner, *(e for e in tail[1:] if start < e < start + n), start + n]
    for a, b in itertools.pairwise(edges):
        if a < tail[0]:
            yield a - start, b - a, a // window, a % window
        else:
            i = bisect.bisect_right(tail, a) - 1
            yield a - start, b - a, tail[0] // window + i, a - tail[i]


def placed(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(part, first, id, n, ids): a written table of each document's ids and its first place within its partition."""
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of, part, at = encoder(path), TaskContext.get().partitionId(), 0
        last = np.array([end], of.width).tobytes()
        for pdf in batches:
            for rows in slices(pdf, "t"):
                ids = [of(t) + last for t in rows["t"]]
                n = np.array([len(b) // len(last) for b in ids], np.int64)
                stop = at + np.cumsum(n)
                yield pd.DataFrame({"part": part, "first": stop - n, "id": rows["id"].to_numpy(), "n": n, "ids": ids})
                at = int(stop[-1])

    src = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return materialize(src.mapInPandas(tokens, "part int, first long, id string, n long, ids binary"))


def pack(df: DataFrame, path: str, window: int = WINDOW, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(id_col, start, length, ids, doc_tokens, sequence_id, offset): each document's pieces; ids as little-endian unsigned 32-bit integers."""
    t = placed(df, path, id_col, text_col, end)
    starts, total = {}, 0
    for part, n in sorted((r[0], r[1]) for r in t.groupBy("part").agg(F.sum("n")).collect()):  # one row a partition
        starts[part] = total
        total += n
    tail, held = tail_edges(total, window), df.sparkSession.sparkContext.broadcast(starts)

    def pieces(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        width = encoder(path).width
        for pdf in batches:
            rows = []
            for part, first, name, n, b in zip(pdf["part"], pdf["first"], pdf["id"], pdf["n"], pdf["ids"]):
                ids = np.frombuffer(b, width).astype("<u4")
                rows += [(name, a, k, ids[a:a + k].tobytes(), n, s, o) for a, k, s, o in cut(held.value[part] + int(first), int(n), window, tail)]
            yield pd.DataFrame(rows, columns=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    out = t.mapInPandas(pieces, "id string, start long, length long, ids binary, doc_tokens long, sequence_id long, offset long")
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "start", "length", "ids", "doc_tokens", "sequence_id", "offset")


def op11_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = pack(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(VOCABULARY))
    return out.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
