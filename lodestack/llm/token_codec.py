"""8. Token-ID output: a static range asymmetric numeral system over shared frequency tables.

File format (a table of blocks in Parquet, one payload each): documents in id order, whole documents to a block. A
payload is a header of little-endian integers (magic, ids, lanes, words, crc32 of the ids, crc32 of the rest), the final state of each
lane, and per step the 32-bit words that lanes emitted. Lanes are interleaved (id i in lane i mod lanes) and decoded
in vector steps; every block is independent and holds its first id number within its partition and its
documents' lengths; a table of checkpoints holds the partitions' first numbers, so blocks are decoded in parallel. The frequency table is one per data set, bounded by the
vocabulary, with at least 1 for each id that occurs.

Null and empty texts are the end id alone. Ties of id are ordered by the text's hash; repeated rows are written
as often as they occur. A damaged payload raises ValueError. Extra columns are not written.
"""

from __future__ import annotations

import itertools
import json
import os
import re
import struct
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, scratch, slices

VOCABULARY, END, BLOCK = "word_bpe_49k.json", 1, 1 << 17
MAGIC, SCALE, LANES = 0x4C53524E, 22, 1024
LOW = np.uint64(1 << 31)


def normalize(counts: np.ndarray) -> np.ndarray:
    """Frequencies that add up to 2^SCALE, at least 1 where the count is positive."""
    total, m = int(counts.sum()), 1 << SCALE
    if not total:
        return counts.astype(np.int64)
    f = np.where(counts > 0, np.maximum(1, (counts.astype(object) * m // total).astype(np.int64)), 0)
    order = np.argsort(-f, kind="stable")
    diff = m - int(f.sum())
    if diff > 0:
        f[order[0]] += diff
    for i in order:
        if diff >= 0:
            break
        take = min(-diff, int(f[i]) - 1)
        f[i] -= take
        diff += take
    return f


def encode(ids: np.ndarray, freq: np.ndarray) -> bytes:
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    fr, n = freq.astype(np.uint64), len(ids)
    lanes = max(1, min(LANES, n // 64))
    x = np.full(lanes, LOW, np.uint64)
    out, sc = [], np.uint64(SCALE)
    for at in range((n - 1) // lanes * lanes, -1, -lanes) if n else ():
        s = ids[at:at + lanes]
        y, f = x[:len(s)], fr[s]
        over = y >= f << np.uint64(63 - SCALE)  # at most one word a step: states stay below 2^63
        out.append((y[over] & np.uint64(0xFFFFFFFF)).astype("<u4"))
        y = np.where(over, y >> np.uint64(32), y)
        q = y // f
        x[:len(s)] = (q << sc) + (y - q * f) + cum[s]
    words = np.concatenate(out[::-1]) if out else np.zeros(0, "<u4")
    body = x.astype("<u8").tobytes() + words.tobytes()
    return struct.pack("<6I", MAGIC, n, lanes, len(words), zlib.crc32(ids.astype("<u4").tobytes()), zlib.crc32(body)) + body


def decode(payload: bytes, freq: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Ids of a block; symbol maps each of the 2^SCALE values to its id."""
    magic, n, lanes, m, crc, body = struct.unpack_from("<6I", payload)
    if magic != MAGIC or len(payload) != 24 + 8 * lanes + 4 * m or zlib.crc32(payload[24:]) != body:
        raise ValueError("not a block of token ids")
    x = np.frombuffer(payload, "<u8", lanes, 24).copy()
    words = np.frombuffer(payload, "<u4", m, 24 + 8 * lanes).astype(np.uint64)
    cum = np.concatenate([[0], np.cumsum(freq)[:-1]]).astype(np.uint64)
    fr, out, at, mask = freq.astype(np.uint64), np.empty(n, np.uint32), 0, np.uint64((1 << SCALE) - 1)
    for i in range(0, n, lanes):
        y = x[:min(lanes, n - i)]
        slot = y & mask
        s = symbol[slot]
        out[i:i + len(s)] = s
        y = fr[s] * (y >> np.uint64(SCALE)) + slot - cum[s]
        low = y < LOW
        k = int(low.sum())
        y[low] = y[low] << np.uint64(32) | words[at:at + k]
        at += k
        x[:len(y)] = y
    if at != m or zlib.crc32(out.astype("<u4").tobytes()) != crc:
        raise ValueError("checksum of a block does not match")
    return out


# The pattern of the tokenizer file, and that pattern for characters whose lower case and NFC are one to one.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTER = "A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0132-\u0148\u014a-\u017e"
PLAIN = re.compile(f"[!-~{LETTER}]+")
PIECE = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{LETTER}]+|[0-9]|[^0-9{LETTER}]+")


def _visible() -> dict[int, int]:
    """The byte level's spelling: visible bytes stand for themselves, the others for code points from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: 256 + i for i, b in enumerate(hidden)}


_VISIBLE = _visible()

_LOW = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


class Words:
    """Ids of texts by the library, each distinct word encoded once while it is held.

    The tokenizer's normaliser and pre-tokenizer treat the parts on either side of ASCII white space alone (NFC composes
    nothing with it, lower case is by character, no piece holds white space) and special strings hold none, so a text's
    ids are its words' ids in order. New words of plain characters are cut by the pattern and their pieces go to the
    library's model, spelled as its byte level spells them; other words go through the whole library. Words of up to 16
    bytes are looked up exactly, many at a time, in arrays of their bytes. At most `hold` words of up to 64 bytes and a quarter as many pieces are held. With a file of another pattern the library encodes whole texts.
    """

    def __init__(self, path: str, hold: int = 1 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library, self.hold = Tokenizer.from_file(path), hold
        self.model = self.library.model
        kind = json.loads(self.library.to_str())
        cut, form = kind["pre_tokenizer"] or {}, kind["normalizer"] or {}
        special = [t["content"] for t in kind["added_tokens"]]
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.by_word = ([p.get("pattern", {}).get("Regex", p["type"]) for p in cut.get("pretokenizers", ())] == [PATTERN, "ByteLevel"]
                        and [x["type"] for x in form.get("normalizers", ())] == ["NFC", "Replace", "Lowercase"] and not any(re.search(r"\s", t) for t in special))
        self.clear()

    def clear(self, words: int = 0) -> None:
        """An empty table for `hold` words, or more if a batch alone has more."""
        slots = 1 << (2 * max(self.hold, words) - 1).bit_length()
        self.a, self.b, self.n, self.no = np.zeros(slots, np.uint64), np.zeros(slots, np.uint64), np.zeros(slots, np.uint8), np.zeros(slots, np.int32)
        self.long: dict[bytes, int] = {}
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.start, self.size, self.flat, self.used, self.count = np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64), np.zeros(1 << 14, np.uint32), 0, 0

    def slots(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        h = (a ^ (b * np.uint64(0xC2B2AE3D27D4EB4F) + n)) * np.uint64(0x9E3779B97F4A7C15)
        return ((h ^ (h >> np.uint64(29))) & np.uint64(len(self.a) - 1)).astype(np.int64)

    def find(self, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> np.ndarray:
        """Numbers of words of up to 16 bytes, given as two integers and a length; -1 where not held."""
        slot, out, todo = self.slots(a, b, n), np.full(len(a), -1, np.int64), np.arange(len(a))
        while len(todo):
            at = slot[todo]
            held = self.n[at]
            same = (self.a[at] == a[todo]) & (self.b[at] == b[todo]) & (held == n[todo])
            out[todo[same]] = self.no[at[same]]
            todo = todo[~same & (held > 0)]
            slot[todo] = (slot[todo] + 1) & (len(self.a) - 1)
        return out

    def insert(self, a: np.ndarray, b: np.ndarray, n: np.ndarray, no: np.ndarray) -> None:
        """Distinct new words; of several that want one free slot the first takes it."""
        slot, todo = self.slots(a, b, n), np.arange(len(a))
        while len(todo):
            free = todo[self.n[slot[todo]] == 0]
            free = free[np.unique(slot[free], return_index=True)[1]]
            at = slot[free]
            self.a[at], self.b[at], self.n[at], self.no[at] = a[free], b[free], n[free], no[free]
            done = np.zeros(len(a), bool)
            done[free] = True
            todo = todo[~done[todo]]
            slot[todo] = (slot[todo] + 1) & (len(self.a) - 1)

    def encoded(self, texts: list[str]) -> list[list[int]]:
        return [e.ids for e in self.library.encode_batch_fast(texts, add_special_tokens=False)]

    def piece(self, text: str) -> tuple[int, ...]:
        if len(self.pieces) >= self.hold >> 2:
            self.pieces.clear()
        self.pieces[text] = found = tuple([k.id for k in self.model.tokenize(text.encode("utf-8").decode("latin-1").translate(_VISIBLE))])
        return found

    def learn(self, words: list[bytes]) -> None:
        known, flat, sizes, order, other, texts = self.pieces.get, [], [], [], [], []
        for w in words:
            t = w.decode("utf-8")
            if not PLAIN.fullmatch(t) or (self.special and self.special.search(t)):
                other.append(w)
                texts.append(t)
                continue
            before = len(flat)
            for p in PIECE.findall(t.lower()):
                flat += known(p) or self.piece(p)
            sizes.append(len(flat) - before)
            order.append(w)
        for ids in self.encoded(texts):
            flat += ids
            sizes.append(len(ids))
        words, sizes, flat = order + other, np.array(sizes, np.int64), np.array(flat, np.uint32)
        first, n, more = self.count, self.count + len(words), self.used + len(flat)
        while n > len(self.size):
            self.start, self.size = (np.concatenate([x, np.zeros_like(x)]) for x in (self.start, self.size))
        while more > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        self.start[first:n], self.size[first:n], self.flat[self.used:more] = self.used + np.cumsum(sizes) - sizes, sizes, flat
        self.used, self.count = more, n
        size = np.fromiter(map(len, words), np.int64, len(words))
        short = size <= 16
        a = np.frombuffer(b"".join([w.ljust(16, b"\0") for w in itertools.compress(words, short)]), "<u8").reshape(-1, 2)
        no = np.arange(first, n)
        self.insert(a[:, 0].copy(), a[:, 1].copy(), size[short].astype(np.uint64), no[short])
        self.long.update(zip(itertools.compress(words, ~short), no[~short].tolist()))

    def __call__(self, texts: list[bytes], end: int) -> list[np.ndarray]:
        """The ids of each text (UTF-8) with the end id behind."""
        if not self.by_word:
            return [np.array([*ids, end], np.uint32) for ids in self.encoded([t.decode("utf-8") for t in texts])]
        buf = b" ".join(texts) + b" " * 24
        chars = np.frombuffer(buf, np.uint8)
        space = (chars == 32) | (chars - np.uint8(9) <= 4)
        edge = np.flatnonzero(space[1:] != space[:-1]) + 1
        edge = edge if space[0] else np.insert(edge, 0, 0)
        start, stop = edge[0::2], edge[1::2]
        eight, n = np.ndarray((len(buf) - 8,), "<u8", buf, strides=(1,)), stop - start
        a, b, size = eight[start] & _LOW[np.minimum(n, 8)], eight[start + 8] & _LOW[np.clip(n - 8, 0, 8)], n.astype(np.uint64)
        far = np.flatnonzero(n > 16)
        names = [buf[i:j] for i, j in zip(start[far].tolist(), stop[far].tolist())]
        word = self.find(a, b, np.where(n <= 16, size, 0))
        word[far] = [self.long.get(w, -1) for w in names]
        miss = np.flatnonzero(word < 0)
        new = {buf[i:j] for i, j in zip(start[miss].tolist(), stop[miss].tolist())}
        if new and self.count + len(new) > self.hold and (self.count or len(new) * 2 > len(self.a)):
            self.clear(len(new))
            return self(texts, end)
        if new:
            self.learn(list(new))
            word[miss] = self.find(a[miss], b[miss], np.where(n[miss] <= 16, size[miss], 0))
            word[far] = [self.long[w] for w in names]
        count = self.size[word]
        last = np.cumsum(count)
        total = int(last[-1]) if len(last) else 0
        ids = self.flat[np.repeat(self.start[word] - (last - count), count) + np.arange(total)]
        if any(len(w) > 64 for w in new):
            self.clear()
        bound = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in texts)]))
        ends = np.concatenate([[0], last])[bound]
        return [np.append(ids[x:y], np.uint32(end)) for x, y in zip(ends, ends[1:])]


@lru_cache(2)
def words(path: str) -> Words:
    return Words(path)


def packed(ids: np.ndarray) -> bytes:
    return ids.astype("<u2").tobytes() if int(ids.max(initial=0)) < 65536 else b"\x01" + ids.astype("<u4").tobytes()


def unpacked(b: bytes) -> np.ndarray:
    return np.frombuffer(b, "<u2").astype(np.int64) if len(b) % 2 == 0 else np.frombuffer(b, "<u4", offset=1).astype(np.int64)


def tokenized(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> DataFrame:
    """(id, h, n, ids): a written table of each row's id as text, text hash, count and ids; every text is tokenized once."""
    def tokens(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        of = words(path)
        for pdf in batches:
            for part in slices(pdf, "t"):
                rows = of(part["t"].tolist(), end)
                yield pd.DataFrame({"id": part["id"].to_numpy(), "h": part["h"].to_numpy(), "n": [len(r) for r in rows], "ids": [packed(r) for r in rows]})

    src = df.select(F.col(id_col).cast("string").alias("id"), F.coalesce(F.col(text_col), F.lit("")).cast("binary").alias("t")).withColumn("h", F.xxhash64("t"))
    return materialize(src.mapInPandas(tokens, "id string, h long, n long, ids binary"))


def write_ids(df: DataFrame, path: str, to: str, id_col: str = "doc_id", text_col: str = "text", end: int = END) -> None:
    """Encode df's texts, in the order of its ids, to blocks under to/blocks, their checkpoints under to/checkpoints and
    the table under to/frequencies.

    The written tokens are counted, then range-partitioned by id once and encoded where they arrive. A block knows its
    start within its partition; the partitions' starts, one row each, are the checkpoints.
    """
    spark = df.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    toks = tokenized(df, path, id_col, text_col, end)

    def tally(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = np.zeros(0, np.int64)
        for pdf in batches:
            c = np.bincount(np.concatenate([unpacked(b) for b in pdf["ids"]])) if len(pdf) else np.zeros(0, np.int64)
            size = max(len(c), len(total))
            total = np.pad(total, (0, size - len(total))) + np.pad(c, (0, size - len(c)))
        at = np.flatnonzero(total)
        yield pd.DataFrame({"id": at, "count": total[at]})

    counts = toks.select("ids").mapInPandas(tally, "id long, count long").groupBy("id").agg(F.sum("count").alias("count")).toPandas()
    freq = np.zeros(int(counts["id"].max()) + 1 if len(counts) else 1, np.int64)
    freq[counts["id"]] = counts["count"]
    freq = normalize(freq)
    spark.createDataFrame(pd.DataFrame({"id": np.flatnonzero(freq), "freq": freq[freq > 0]}), "id long, freq long").coalesce(1).write.parquet(f"{to}/frequencies")
    held = spark.sparkContext.broadcast(freq)

    def blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        part, start, size, ids, names, sizes = TaskContext.get().partitionId(), 0, 0, [], [], []

        def pack() -> pd.DataFrame:
            return pd.DataFrame({"part": [part], "start": [start], "doc_ids": [list(names)], "lengths": [list(sizes)], "payload": [encode(np.concatenate([unpacked(b) for b in ids]), held.value)]})

        for pdf in batches:
            for name, count, b in zip(pdf["id"], pdf["n"], pdf["ids"]):
                if ids and size + count > BLOCK:
                    yield pack()
                    start += size
                    size, ids, names, sizes = 0, [], [], []
                ids.append(b)
                names.append(name)
                sizes.append(int(count))
                size += int(count)
        if ids:
            yield pack()

    key = F.col("id").cast(df.schema[id_col].dataType)
    rows = toks.repartitionByRange(n, key, "h").sortWithinPartitions(key, "h").select("id", "n", "ids")
    rows.mapInPandas(blocks, "part int, start long, doc_ids array<string>, lengths array<long>, payload binary").write.parquet(f"{to}/blocks")
    ends = spark.read.parquet(f"{to}/blocks").groupBy("part").agg(F.sum(F.aggregate("lengths", F.lit(0).cast("long"), lambda a, x: a + x)).alias("n")).collect()
    starts, at = [], 0
    for p, c in sorted((r[0], r[1]) for r in ends):
        starts.append((p, at))
        at += c
    spark.createDataFrame(starts, "part int, first long").coalesce(1).write.parquet(f"{to}/checkpoints")


def read_ids(spark: SparkSession, at: str, kind: str = "long") -> DataFrame:
    """(doc_id, start, n_tokens, ids) decoded from the files; ids as little-endian unsigned 32-bit integers."""
    table = spark.read.parquet(f"{at}/frequencies").toPandas()
    freq = np.zeros(int(table["id"].max()) + 1 if len(table) else 1, np.int64)
    freq[table["id"]] = table["freq"]
    held = spark.sparkContext.broadcast(freq)

    def open_blocks(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        symbol = np.repeat(np.arange(len(held.value), dtype=np.uint32), held.value)
        for pdf in batches:
            for start, names, sizes, payload in zip(pdf["start"], pdf["doc_ids"], pdf["lengths"], pdf["payload"]):
                ids, ends = decode(payload, held.value, symbol).astype("<u4"), np.cumsum(sizes)
                first = ends - np.asarray(sizes)
                yield pd.DataFrame({"doc_id": names, "start": start + first, "n_tokens": sizes, "ids": [ids[a:b].tobytes() for a, b in zip(first, ends)]})

    starts = F.broadcast(spark.read.parquet(f"{at}/checkpoints"))  # one row a partition of the writer
    found = spark.read.parquet(f"{at}/blocks").join(starts, "part").select((F.col("first") + F.col("start")).alias("start"), "doc_ids", "lengths", "payload")
    return found.mapInPandas(open_blocks, "doc_id string, start long, n_tokens long, ids binary").withColumn("doc_id", F.col("doc_id").cast(kind))


def op8_token_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    to = scratch(spark)
    write_ids(documents(spark, sf_dir).select("doc_id", "text"), public_tokenizers.path(VOCABULARY), to)
    return read_ids(spark, to).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))
