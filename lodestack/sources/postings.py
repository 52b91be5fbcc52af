"""A kept BM25 index: postings in segments and shards with per-block maxima, so that a search reads no text.

Documents are dealt into shards of about SHARD by their id's hash and numbered inside by id. A term has one row a shard, so a frequent term is
many rows. A row holds the documents' numbers and counts, and for each block of BLOCK numbers where the term occurs its greatest count and the least
length there, which bound its part of any score whatever the mean length becomes. A shard scores a query's blocks from the highest bound down
and stops when no bound reaches the k-th score found.

Adding writes a further segment; removing marks documents and writes their terms' counts with a minus, taken from the forward rows, so statistics are
always those of the live documents and results equal operators.retrieval.bm25 over them. Null texts are empty; repeated rows
are documents of their own, and removing an id removes all of its rows.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators.retrieval import _TERM, EPSILON, K1, B, blocks_of, portions, top
from .tables import written

SHARD, BLOCK = 1 << 14, 128


def tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, len, terms, tfs) of (doc_id, text)."""
    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in (part for pdf in batches for part in portions(pdf)):
            bags = [Counter(_TERM.findall((t or "").lower())) for t in rows["text"]]
            yield pd.DataFrame({"doc_id": rows["doc_id"], "len": [sum(b.values()) for b in bags], "terms": [list(b) for b in bags], "tfs": [list(b.values()) for b in bags]})

    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInPandas(count, f"doc_id {kind}, len int, terms array<string>, tfs array<int>")


class PostingsIndex:
    """An index at a path: forward rows, shards, postings, term and corpus counts, and marks of what is gone."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    @classmethod
    def build(cls, docs: DataFrame, path: str) -> PostingsIndex:
        """Index (doc_id, text) rows at path, which must not exist yet."""
        out = cls(docs.sparkSession, path)
        out.add(docs)
        return out

    def add(self, docs: DataFrame) -> None:
        """A further segment of (doc_id, text) rows; an id that is there already gets a second document."""
        seg = uuid.uuid4().hex
        rows = written(tokens(docs))
        shards = max(1, -(-rows.count() // SHARD))
        w = Window.partitionBy("shard").orderBy("doc_id", "len", F.hash("terms"))
        rows = rows.withColumn("shard", F.pmod(F.xxhash64("doc_id"), F.lit(shards)).cast("int")).withColumn("no", F.row_number().over(w) - 1)
        self._write(rows, "forward", seg)
        rows = self._read("forward").filter(F.col("seg") == seg)
        shard = rows.groupBy("shard").agg(F.array_sort(F.collect_list(F.struct("no", "doc_id", "len"))).alias("d"))
        self._write(shard.select("shard", F.col("d.doc_id").alias("ids"), F.col("d.len").alias("lens")), "shards", seg)
        flat = rows.select("shard", "no", "len", F.explode(F.arrays_zip("terms", "tfs")).alias("t")).select("shard", "no", "len", F.col("t.terms").alias("term"), F.col("t.tfs").alias("tf"))
        # a block first, so that a term's row of a shard is put together from a few hundred blocks
        block = flat.groupBy("shard", "term", F.floor(F.col("no") / BLOCK).cast("int").alias("b")).agg(F.array_sort(F.collect_list(F.struct("no", "tf"))).alias("p"), F.max("tf").alias("top"), F.min("len").alias("short"))
        term = block.groupBy("shard", "term").agg(F.array_sort(F.collect_list(F.struct("b", "p", "top", "short"))).alias("x"))
        p = F.flatten("x.p")
        self._write(term.select("shard", "term", p["no"].alias("docs"), p["tf"].alias("tfs"), F.col("x.b").alias("b"), F.transform("x.p", lambda q: F.size(q)).alias("n"), F.col("x.top").alias("top"), F.col("x.short").alias("short")).repartition("term"), "postings", seg)
        new = self._read("postings").filter(F.col("seg") == seg)
        self._counts(new.groupBy("term").agg(F.sum(F.size("docs")).cast("long").alias("df"), F.sum(F.aggregate("tfs", F.lit(0).cast("long"), lambda a, t: a + t)).alias("tf")), rows, seg, 1)

    def remove(self, ids: DataFrame) -> None:
        """Documents of these ids (doc_id) go."""
        seg = uuid.uuid4().hex
        live = self._read("forward").join(self._read("gone"), ["seg", "shard", "no"], "left_anti") if self._has("gone") else self._read("forward")
        rows = written(live.join(ids.select("doc_id").distinct(), "doc_id", "left_semi"))
        flat = rows.select(F.explode(F.arrays_zip("terms", "tfs")).alias("t"))
        counts = written(flat.groupBy(F.col("t.terms").alias("term")).agg((-F.count("*")).alias("df"), (-F.sum("t.tfs")).alias("tf")))
        self._counts(counts, rows, seg, -1)
        rows.select("seg", "shard", "no").write.mode("append").parquet(f"{self.path}/gone")

    def _counts(self, terms: DataFrame, rows: DataFrame, seg: str, sign: int) -> None:
        self._write(terms.select("term", "df", "tf"), "terms", seg)
        self._write(rows.agg((F.count("*") * sign).alias("n"), (F.coalesce(F.sum("len"), F.lit(0)) * sign).cast("long").alias("words")), "corpus", seg)

    def _write(self, df: DataFrame, name: str, seg: str) -> None:
        df.write.parquet(f"{self.path}/{name}/seg={seg}")

    def _has(self, name: str) -> bool:
        p = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}")
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(p)

    def _read(self, name: str) -> DataFrame:
        df = self.spark.read.parquet(f"{self.path}/{name}")
        return df.withColumn("seg", F.col("seg").cast("string"))

    def statistics(self) -> DataFrame:
        """(term, df, tf) of the live documents."""
        return self._read("terms").groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf")).filter("df > 0")

    def search(self, queries: DataFrame, k: int = 10) -> DataFrame:
        """(query_id, doc_id, score, rank) of (query_id, text) queries, as retrieval.bm25 over the live documents."""
        spark = self.spark
        n, words = self._read("corpus").agg(F.sum("n"), F.sum("words")).first()
        ids, asks = self._read("shards").schema["ids"].dataType.elementType.simpleString(), queries.schema["query_id"].dataType.simpleString()
        out, found = f"query_id {asks}, doc_id {ids}, score double", []
        df = self.statistics()
        mean = df.agg(F.avg(F.log((F.lit(n) - F.col("df") + 0.5) / (F.col("df") + 0.5)))).first()[0] or 0.0
        average, postings, shards = max(words, 1) / max(n, 1), self._read("postings"), self._read("shards")
        for part in blocks_of(queries.select("query_id", "text")):
            bags = [Counter(_TERM.findall((t or "").lower())) for t in part["text"]]
            asked = [i for i, b in enumerate(bags) if b]
            if not asked:
                continue
            wanted = F.broadcast(spark.createDataFrame([(t,) for t in sorted({t for b in bags for t in b})], "term string"))
            known = {r["term"]: r["df"] for r in df.join(wanted, "term", "left_semi").collect()}
            idf = {t: np.log((n - x + 0.5) / (x + 0.5)) for t, x in known.items()}
            bag = [{t: c * (mean * EPSILON if idf[t] < 0 else idf[t]) for t, c in bags[i].items() if t in idf} for i in asked]
            held = spark.sparkContext.broadcast((bag, part["query_id"].to_numpy()[asked]))
            hits = postings.join(wanted, "term", "left_semi").drop("tf")
            whole = shards.select("seg", "shard", *[F.lit(None).cast(t).alias(c) for c, t in (("term", "string"), ("docs", "array<int>"), ("tfs", "array<int>"), ("b", "array<int>"), ("n", "array<int>"), ("top", "array<int>"), ("short", "array<int>"))], "ids", "lens", F.lit(None).cast("array<int>").alias("gone"))
            empty = lambda c: F.lit(None).cast(whole.schema[c].dataType).alias(c)
            rows = hits.select(*[F.col(c) if c in hits.columns else empty(c) for c in whole.columns]).unionByName(whole)
            if self._has("gone"):
                gone = self._read("gone").groupBy("seg", "shard").agg(F.collect_list("no").alias("gone"))
                rows = rows.unionByName(gone.select(*[F.col(c) if c in gone.columns else empty(c) for c in whole.columns]))
            found.append(rows.groupBy("seg", "shard").applyInPandas(_ranker(held, k, average, BLOCK), out))
        if not found:
            return spark.createDataFrame([], f"{out}, rank int")
        both = found[0]
        for f in found[1:]:
            both = both.unionByName(f)
        return top(both, k)


def _ranker(held, k: int, average: float, block: int):
    def ranked(pdf: pd.DataFrame) -> pd.DataFrame:
        return _ranked(pdf, *held.value, k, average, block)

    return ranked


def _ranked(pdf: pd.DataFrame, bags: list[dict], queries: np.ndarray, k: int, average: float, block: int = BLOCK) -> pd.DataFrame:
    """The best k documents of a shard for each query; the shard's rows are its terms, its documents and what is gone."""
    own = pdf[pdf["ids"].notna()].iloc[0]
    ids, lens = np.asarray(own["ids"]), np.asarray(own["lens"], float)
    live = np.ones(len(ids), bool)
    for g in pdf.loc[pdf["gone"].notna(), "gone"]:
        live[g] = False
    k = min(k, int(live.sum()))
    if not k:
        return pd.DataFrame({"query_id": queries[:0], "doc_id": ids[:0], "score": np.zeros(0)})
    blocks = -(-len(ids) // block)
    damp = K1 * (1 - B + B * lens / average)
    part = lambda tf, d: tf * (K1 + 1) / (tf + d)
    terms = {}
    for term, docs, tfs, b, n, best, short in zip(*(pdf.loc[pdf["term"].notna(), c] for c in ("term", "docs", "tfs", "b", "n", "top", "short"))):
        bound = np.zeros(blocks)
        bound[b] = part(np.asarray(best, float), K1 * (1 - B + B * np.asarray(short, float) / average))
        at = np.zeros(blocks + 1, np.int64)
        at[np.asarray(b) + 1] = n
        terms[term] = np.asarray(docs), part(np.asarray(tfs, float), damp[docs]), bound, at.cumsum()
    out = []
    for q, bag in enumerate(bags):
        have = [(w, *terms[t]) for t, w in bag.items() if t in terms]
        score = np.where(live, 0.0, -np.inf)
        if any(w < 0 for w, *_ in have):  # bounds hold for positive weights only
            for w, docs, x, _, _ in have:
                score[docs] += w * x
        elif have:
            bound, floor = sum(w * u for w, _, _, u, _ in have), 0.0
            order = np.argsort(-bound, kind="stable")
            for i, b in enumerate(order.tolist()):
                if bound[b] <= 0 or bound[b] < floor - 1e-6:
                    break
                for w, docs, x, _, at in have:
                    lo, hi = at[b], at[b + 1]
                    score[docs[lo:hi]] += w * x[lo:hi]
                if i % 8 == 7:
                    floor = np.partition(score, len(score) - k)[len(score) - k]
        score = np.round(score, 6)
        least = np.partition(score, len(score) - k)[len(score) - k]
        pick = np.flatnonzero(score >= least)
        pick = pick[np.argsort(-score[pick], kind="stable")[:k]]
        out.append(pd.DataFrame({"query_id": np.repeat(queries[q:q + 1], len(pick)), "doc_id": ids[pick], "score": score[pick]}))
    return pd.concat(out)
