"""2. SimHash near-duplicates by covering locality-sensitive hashing.

64-bit fingerprints within radius r are linked. Each bit i has a nonzero vector v(i) of r+1 bits; table t
(1 .. 2^(r+1)-1) keeps the bits whose vector has an odd product with t. Any r bits span at most r of r+1
dimensions, so some t is even with all of them: every pair within r agrees on that table's whole key.

Equal fingerprints are merged before the tables. Tables are sorted, not grouped: buckets stream past, a bucket
of any size is held as fingerprints only, and each yields a star to its local roots, never its pairs. Buckets
above `block` fingerprints are dealt out as pairs of blocks, so no task holds more than two blocks.

Null and empty texts have fingerprint 0 and link like any other. Repeated rows share a component. A null
doc_id is never a component's id unless all its rows are null. Clashing extra columns do not matter: the
general operator only adds __ columns.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import LOWER, UPPER, documents, materialize

RADIUS, BLOCK = 4, 4096
_WORD, _LOWER = re.compile(r"[^\x20\x09-\x0D]+"), str.maketrans(UPPER, LOWER)


def shingle_hashes(text: str | None, words_per_shingle: int) -> Iterator[np.ndarray]:
    """64-bit hashes of a text's shingles, in parts of bounded size; nothing for a text without words."""
    words = _WORD.findall((text or "").translate(_LOWER))
    k, n = words_per_shingle, max(1, len(words) - words_per_shingle + 1) if words else 0
    for at in range(0, n, 65536):  # bounded memory for very long texts
        yield np.fromiter((xxhash.xxh64_intdigest(" ".join(words[i:i + k]).encode("utf-8", "surrogatepass"), 42) for i in range(at, min(n, at + 65536))), np.uint64)


def simhash(text: str | None, words_per_shingle: int) -> int:
    """Signed 64-bit fingerprint of one text."""
    return fingerprint(shingle_hashes(text, words_per_shingle))


def fingerprint(parts: Iterable[np.ndarray]) -> int:
    """Signed 64-bit fingerprint of shingle hashes: a bit is set if it is in over half of them."""
    total, n = np.zeros(64, np.int64), 0
    for h in parts:
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
        n += len(h)
    bits = np.packbits(total * 2 > n, bitorder="little")
    return int(bits.view(np.int64)[0])


def with_fingerprint(df: DataFrame, words_per_shingle: int, text_col: str = "text") -> DataFrame:
    @F.pandas_udf("long")
    def fp(s: pd.Series) -> pd.Series:
        return pd.Series([simhash(x, words_per_shingle) for x in s], dtype="int64")

    return df.withColumn("__fp", fp(F.col(text_col)))


def masks(radius: int = RADIUS) -> list[int]:
    size = (1 << (radius + 1)) - 1
    return [sum(1 << i for i in range(64) if bin(t & (i % size + 1)).count("1") & 1) for t in range(1, size + 1)]


def _stars(fp: np.ndarray, run: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Links inside runs of sorted rows, as (member, root). In a pair of blocks, pairs of one block are compared too, once for each of its pairs."""
    n, root = len(fp), np.arange(len(fp))
    live, step = np.arange(n), 1
    u = fp.view(np.uint64)
    while True:
        live = live[live + step < n]
        live = live[run[live] == run[live + step]]
        if not len(live):
            break
        a, b = live, live + step
        near = (np.bitwise_count(u[a] ^ u[b]) <= radius)
        a, b = a[near], b[near]
        while len(a):
            ra, rb = root[a], root[b]
            split = ra != rb
            a, b, ra, rb = a[split], b[split], ra[split], rb[split]
            if not len(a):
                break
            np.minimum.at(root, np.maximum(ra, rb), np.minimum(ra, rb))
            while (root[root] != root).any():
                root = root[root]
        step += 1
    member = root != np.arange(n)
    return fp[member], fp[root[member]]


def links(fps: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(a, b): stars whose components are those of all pairs of distinct __fp within the radius."""
    tables = F.array(*[F.struct(F.lit(t).alias("t"), F.col("__fp").bitwiseAND(F.lit(m - (1 << 64) if m >> 63 else m)).alias("key")) for t, m in enumerate(masks(radius))])
    keyed = fps.select("__fp", F.explode(tables).alias("x")).select("__fp", "x.t", "x.key")
    sizes = materialize(keyed.groupBy("t", "key").count().filter("count > 1"))
    big = sizes.filter(F.col("count") > block)
    small = keyed.join(sizes.filter(F.col("count") <= block).select("t", "key"), ["t", "key"]).withColumn("part", F.lit("").cast("string"))
    pieces = keyed.join(big, ["t", "key"]).withColumn("n", F.ceil(F.col("count") * 2 / block).cast("int"))
    pieces = pieces.withColumn("own", F.pmod(F.xxhash64("__fp"), F.col("n")).cast("int"))
    pieces = pieces.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    pieces = pieces.select("__fp", "t", "key", F.concat_ws(":", F.least("own", "other"), F.greatest("own", "other")).alias("part"))
    rows = small.select("__fp", "t", "key", "part").unionByName(pieces)
    n = int(fps.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartition(n, "t", "key", "part").sortWithinPartitions("t", "key", "part", "__fp")

    def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rest = None
        for pdf in batches:
            pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
            if pdf.empty:
                continue
            new = (pdf["t"].diff().ne(0) | pdf["key"].ne(pdf["key"].shift()) | pdf["part"].ne(pdf["part"].shift())).to_numpy()
            start = int(np.flatnonzero(new)[-1])
            rest, done, run = pdf.iloc[start:], pdf.iloc[:start], np.cumsum(new)[:start]
            if start:
                a, b = _stars(done["__fp"].to_numpy(), run, radius)
                yield pd.DataFrame({"a": a, "b": b})
        if rest is not None:
            a, b = _stars(rest["__fp"].to_numpy(), np.zeros(len(rest), int), radius)
            yield pd.DataFrame({"a": a, "b": b})

    return rows.mapInPandas(scan, "a long, b long").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(v, c): the smallest vertex that each vertex of an edge reaches; labels and pointer jumps over written tables."""
    edges = materialize(edges)
    both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = materialize(both.groupBy("a").agg(F.least("a", F.min("b")).alias("c")).withColumnRenamed("a", "v"))
    while True:
        near = both.join(labels, both.b == labels.v).groupBy("a").agg(F.min("c").alias("m"))
        step = labels.join(near, labels.v == near.a, "left").select("v", F.least("c", "m").alias("c"), F.col("c").alias("old"))
        jump = labels.select(F.col("v").alias("x"), F.col("c").alias("y"))
        step = step.join(jump, step.c == jump.x, "left").select("v", F.least("c", "y").alias("c"), "old")
        step = materialize(step)
        labels = step.select("v", "c")
        if step.filter("c <> old").isEmpty():
            return labels


def near_duplicates(df: DataFrame, words_per_shingle: int = 5, radius: int = RADIUS, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """df with __fp, __row (unique) and __first (the row that stands for the component, least id first), __component (its id)."""
    rows = materialize(with_fingerprint(df, words_per_shingle, text_col).withColumn("__row", F.monotonically_increasing_id()))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    fps = rows.groupBy("__fp").agg(F.min(key).alias("least"))
    parts = components(links(fps, radius, block))
    fps = fps.join(parts, F.col("__fp") == F.col("v"), "left").select("__fp", "least", F.coalesce("c", "__fp").alias("c"))
    fps = materialize(fps)
    heads = fps.groupBy("c").agg(F.min("least").alias("head"))
    of = fps.join(heads, "c").select("__fp", F.col("head.id").alias("__component"), F.col("head.row").alias("__first"))
    return rows.join(of, "__fp")


def keep_one(df: DataFrame, words_per_shingle: int = 5, **more) -> DataFrame:
    """One row of each component of near copies verified by shingle similarity, see near_copies.keep_one."""
    from .near_copies import keep_one as keep  # it builds on this module

    return keep(df, words_per_shingle, **more)


def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    rows = with_fingerprint(docs, 4).select("doc_id", "__fp")
    out = near_duplicates_of(rows)
    return out.select("doc_id", F.lower(F.lpad(F.hex("__fp"), 16, "0")).alias("fingerprint"), F.col("__component").alias("component_id"))


def near_duplicates_of(rows: DataFrame, radius: int = RADIUS, block: int = BLOCK) -> DataFrame:
    """(doc_id, __fp) rows with __component."""
    rows = materialize(rows)
    fps = rows.groupBy("__fp").agg(F.min("doc_id").alias("least"))
    parts = components(links(fps, radius, block))
    fps = materialize(fps.join(parts, F.col("__fp") == F.col("v"), "left").select("__fp", "least", F.coalesce("c", "__fp").alias("c")))
    heads = fps.groupBy("c").agg(F.min("least").alias("__component"))
    return rows.join(fps.join(heads, "c").select("__fp", "__component"), "__fp")
