"""12. Alignment of two tokenizers' tokens: a merge of both rows of cumulative token ends emits groups and links.

A is a byte-level vocabulary of space + text, B a sentencepiece vocabulary of text (which adds the space). Byte offsets where
tokens of both end cut them into groups; a link is a pair of token occurrences whose byte ranges overlap. The two rows of ends are walked at once
inside mapInPandas, in vector steps over about half a million characters of texts. Texts are encoded by segments, each distinct one
once while it is held: at a segment's edge tokens of both end (byte_tokens tells why for A; no piece of B holds a space behind
another character). Spark counts in how many documents each id pair is linked, finds each id's greatest count on either side, and joins counts and maxima back to the documents' pairs.

Pairs in very many documents would meet in one task of that join: the `limit` most frequent counts are broadcast, and only the
rest, each in few documents, is shuffled. Texts that are null or empty, or whose joined token bytes differ from space + text on either
side, have no tokens: zeros, and '' for their groups. Repeated rows each count as a document. Extra columns are not carried;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .byte_tokens import LONG, ByteTokens, segments
from .common import documents, materialize, slices

A, B, LIMIT = "byte_bpe_50k.json", "piece_bpe_32k.model", 500_000
SPACE = "▁"


def merge(ends_a: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Both rows of cumulative ends (of equal totals) walked at once: for each link its A and B token; the group of each A and each B token; and of each link.

    Every end of either row closes one link, that of the two tokens that are open there; an end of both closes a group too.
    """
    mark = np.zeros(int(ends_a[-1]) + 1 if len(ends_a) else 0, np.uint8)
    mark[ends_a] |= 1
    mark[ends_b] |= 2
    mark = mark[np.flatnonzero(mark)]
    in_a, in_b, both = mark & 1, mark >> 1, mark == 3
    group = np.cumsum(both) - both
    return np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b, group[in_a > 0], group[in_b > 0], group


class Aligner:
    """The ids of segments on both sides while they are held, as packed pairs; None where the tokens' bytes are not the segment."""

    def __init__(self, path_a: str, path_b: str, hold: int = 1 << 18):
        from sentencepiece import SentencePieceProcessor

        self.a, self.b, self.hold = ByteTokens(path_a, special=False, hold=0), SentencePieceProcessor(model_file=path_b), hold
        names = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.piece = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)]
        self.token = [self.a.token.get(i, b"") for i in range(max(self.a.token) + 1)]
        self.split = self.a.by_segment and not any(SPACE in p.lstrip(SPACE) for p in names)
        self.space = self.b.piece_to_id(SPACE)
        self.size_a, self.size_b = (np.array(list(map(len, x)), np.int64) for x in (self.token, self.piece))
        # an id's decimal text with what follows it: a comma, or at a group's end a bar (A) or a semicolon (B)
        self.text_a, self.text_b = (np.array([f"{i}{mark}".encode() for i in range(len(x)) for mark in (",", end)], object) for x, end in ((self.token, "|"), (self.piece, ";")))
        self.known: dict[bytes, tuple[bytes, bytes] | None] = {}

    def learn(self, new: list[bytes]) -> None:
        """Segments with their first space. The model puts that space in front by itself, but of an empty text it makes nothing."""
        if len(self.known) + len(new) > self.hold:
            self.known.clear()
        encode, token, piece = self.a.plain, self.token, self.piece
        for s, b in zip(new, self.b.encode([s[1:].decode("utf-8") for s in new], num_threads=1)):
            a, b = encode(s), b if len(s) > 1 else [self.space]
            same = b"".join([token[x] for x in a]) == s and b"".join([piece[x] for x in b]) == s
            self.known[s] = (np.array(a, "<u4").tobytes(), np.array(b, "<u4").tobytes()) if same else None

    def ids(self, texts: list[bytes]) -> tuple[list[bytes | None], list[bytes | None]]:
        """The ids of each text on both sides; None if it has no tokens."""
        cut = [(segments(b" " + t) if self.split else [b" " + t]) if t else None for t in texts]
        known, out_a, out_b, long = self.known, [], [], False
        new = {s for c in cut if c for s in c if s not in known}
        if new:
            if len(known) + len(new) > self.hold:
                known.clear()
                new = {s for c in cut if c for s in c}
            long = any(len(s) > LONG for s in new)
            self.learn(list(new))
        for c in cut:
            found = [known[s] for s in c] if c else [None]
            whole = None not in found
            out_a.append(b"".join([x[0] for x in found]) if whole else None)
            out_b.append(b"".join([x[1] for x in found]) if whole else None)
        if long:
            for s in new:
                if len(s) > LONG:
                    del known[s]
        return out_a, out_b

    def __call__(self, texts: list[bytes]) -> pd.DataFrame:
        """(n_a, n_b, n_groups, n_links, groups_sha256, a, b, times) of each text, the last three its distinct pairs."""
        ids_a, ids_b = self.ids(texts)
        a, b = (np.frombuffer(b"".join([x or b"" for x in ids]), "<u4").astype(np.int64) for ids in (ids_a, ids_b))
        n_a, n_b = (np.array([len(x or b"") // 4 for x in ids], np.int64) for ids in (ids_a, ids_b))
        docs, width = np.arange(len(texts)), len(self.piece)
        of_a, of_b, group_a, group_b, _ = merge(np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b]))
        doc_a = np.repeat(docs, n_a)
        key, times = np.unique(doc_a[of_a] * (len(self.token) * width) + a[of_a] * width + b[of_b], return_counts=True)
        doc, pair = key // (len(self.token) * width), key % (len(self.token) * width)
        cut = np.searchsorted(doc, np.arange(len(texts) + 1))
        last = lambda g: np.append(g[1:] != g[:-1], True)[:len(g)]
        many_a, many_b = np.bincount(group_a), np.bincount(group_b)
        text = np.empty(len(a) + len(b), object)
        text[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[group_a]] = self.text_a[2 * a + last(group_a)]
        text[np.arange(len(b)) + np.cumsum(many_a)[group_b]] = self.text_b[2 * b + last(group_b)]
        text, stop = text.tolist(), np.cumsum(n_a + n_b).tolist()
        shas = [hashlib.sha256(b"".join(text[y - n:y])[:-1]).hexdigest() if n else "" for y, n in zip(stop, (n_a + n_b).tolist())]
        pick = lambda x: [x[i:j].astype(np.int32) for i, j in zip(cut[:-1], cut[1:])]
        return pd.DataFrame({"n_a": n_a, "n_b": n_b, "n_groups": np.bincount(doc_a[last(group_a)], minlength=len(texts)), "n_links": np.bincount(doc_a[of_a], minlength=len(texts)), "groups_sha256": shas,
                             "a": pick(pair // width), "b": pick(pair % width), "times": pick(times)})


@lru_cache(2)
def aligner(path_a: str, path_b: str) -> Aligner:
    return Aligner(path_a, path_b)


def aligned(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A written table, a row a document: __row, id, n_a, n_b, n_groups, n_links, groups_sha256, and its distinct pairs (a, b) with their times."""
    def rows_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = aligner(path_a, path_b)
        for pdf in batches:
            for part in slices(pdf, "t", 1 << 19):
                out = of(part["t"].tolist())
                out.insert(0, "id", part["id"].to_numpy())
                out.insert(0, "__row", part["__row"].to_numpy())
                yield out

    src = df.select(F.monotonically_increasing_id().alias("__row"), F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t"))
    return materialize(src.mapInPandas(rows_of, "__row long, id string, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, a array<int>, b array<int>, times array<int>"))


def pair_counts(docs: DataFrame) -> DataFrame:
    """(a, b, n, best_a, best_b): in how many documents each pair is linked, and whether that is the most of its A or B id; a written table."""
    pairs = docs.select(F.explode(F.arrays_zip("a", "b")).alias("p")).select("p.a", "p.b")
    n = materialize(pairs.groupBy("a", "b").agg(F.count("*").alias("n")))
    for side in ("a", "b"):
        n = n.join(n.groupBy(side).agg(F.max("n").alias(f"most_{side}")), side)
    return materialize(n.select("a", "b", "n", (F.col("n") == F.col("most_a")).alias("best_a"), (F.col("n") == F.col("most_b")).alias("best_b")))


def align(df: DataFrame, path_a: str, path_b: str, id_col: str = "doc_id", text_col: str = "text", limit: int = LIMIT) -> DataFrame:
    """(id_col, n_a, n_b, n_groups, n_links, groups_sha256, n_best, n_best_b, count_sum), one row per row of df.

    n_best, n_best_b: links whose count is the greatest of their A id or B id; count_sum: the sum of the links' counts.
    """
    docs = aligned(df, path_a, path_b, id_col, text_col)
    counts = pair_counts(docs)
    least, total = 1, 0
    by = counts.groupBy(F.floor(F.log2("n")).alias("e")).count().collect()  # one row a power of two
    for e, rows in sorted(map(tuple, by), reverse=True):
        total += rows
        if total > limit:
            least = 1 << (int(e) + 1)
            break
    pairs = docs.select("__row", F.explode(F.arrays_zip("a", "b", "times")).alias("p")).select("__row", "p.a", "p.b", "p.times")

    def summed(found: DataFrame) -> DataFrame:
        times = F.col("times").cast("long")
        return found.groupBy("__row").agg(F.sum(F.when(F.col("best_a"), times).otherwise(0)).alias("n_best"), F.sum(F.when(F.col("best_b"), times).otherwise(0)).alias("n_best_b"), F.sum(times * F.col("n")).alias("count_sum"))

    often = F.broadcast(counts.filter(F.col("n") >= least))
    sums = summed(pairs.join(often, ["a", "b"]))
    if least > 1:
        rare = materialize(pairs.join(often.select("a", "b"), ["a", "b"], "left_anti"))
        sums = sums.unionByName(summed(rare.join(counts.filter(F.col("n") < least), ["a", "b"]))).groupBy("__row").agg(*[F.sum(c).alias(c) for c in ("n_best", "n_best_b", "count_sum")])
    out = docs.drop("a", "b", "times").join(sums, "__row", "left").na.fill(0, ["n_best", "n_best_b", "count_sum"])
    return out.select(F.col("id").cast(df.schema[id_col].dataType).alias(id_col), "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "n_best", "n_best_b", "count_sum")


def op12_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    out = align(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(A), public_tokenizers.path(B))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
