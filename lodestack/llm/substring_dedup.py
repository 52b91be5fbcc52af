"""6. Removal of repeated word passages with prefix-partitioned suffix trees.

Words are hashed to 64-bit symbols. A window's anchor is its least run of `gram` words (leftmost first); it is the
same wherever the window recurs, so windows whose anchor occurs once cannot repeat and their suffixes are pruned
after one aggregated count. The other suffixes, to the depth of a window, are dealt to groups by prefixes of variable
length: one gram of words, and where the suffixes of a prefix exceed a group, two grams, three, then the
whole window. A group is bounded, so each task builds its subtrees in memory, one prefix after another:
leaves sorted, internal nodes from the neighbours' common prefixes. Leaves below nodes as deep as a window start
repeats; runs of them in a text are its maximal repeats. A whole window more frequent than a group is one deep node
by its exact count, and its suffixes are spread over the tasks. Equal whole texts are counted first and enter once.

Texts are told apart by 128 bits of hashes of their SHA-256. Null, empty and short texts lose nothing; a repeat inside
one text counts; repeated rows are removed whole if they have a window. Removed words leave one space between the kept
ones. Extra columns are kept.
"""

from __future__ import annotations

import itertools
import uuid
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, materialize, scratch, slices

WINDOW, GRAM, GROUP, HEAVY, HOT = 35, 8, 1 << 16, 1 << 22, 1 << 20
P, HIGH = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xFFFFFFFF00000000)
KEY = ["__a", "__b"]


def split(text: str | None) -> list[bytes]:
    """Words between ASCII white space (0x20, 0x09 to 0x0D), as UTF-8."""
    return (text or "").encode("utf-8", "surrogatepass").split()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


class _Ids(dict):
    """Hash of each word; holds a bounded number of words."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 1 << 18:
            self.clear()
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


_ids = _Ids()


def grams(texts, gram: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the runs of `gram` words (a power of two) of the texts laid end to end, and the texts' bounds.

    Runs across a bound are present too: positions are valid only as starts of windows inside a text.
    """
    cut = [split(t) for t in texts]
    bounds = np.cumsum([0, *map(len, cut)])
    g = np.fromiter(map(_ids.__getitem__, itertools.chain.from_iterable(cut)), np.uint64, int(bounds[-1]))
    size = 1
    while size < gram:
        g = _mix(g[:-size] * P + g[size:]) if len(g) > size else g[:0]
        size *= 2
    return g, bounds


def window_starts(bounds: np.ndarray, window: int) -> np.ndarray:
    """All positions where a window of one text starts."""
    n = np.maximum(np.diff(bounds) - window + 1, 0)
    return np.arange(int(n.sum())) + np.repeat(bounds[:-1] - (np.cumsum(n) - n), n)


def anchors(g: np.ndarray, span: int) -> np.ndarray:
    """For each position that of the least gram (by its high bits) among the next `span`, leftmost first."""
    low, out, size = np.uint64((1 << 24) - 1), [], 1 << 23
    for first in range(0, len(g) - span + 1, size):  # positions within a piece take 24 bits, whatever the length
        part = g[first:first + size + span - 1]
        x, wide = (part & ~low) | np.arange(len(part), dtype=np.uint64), 1
        while wide < span:
            step = min(wide, span - wide)
            x = np.minimum(x[:-step], x[step:])
            wide += step
        out.append((x & low).astype(np.int64) + first)
    return np.concatenate(out) if out else np.zeros(0, np.int64)


def shape(window: int) -> int:
    """Words of a gram: a power of two of which four and a part fill a window."""
    return min(GRAM, 1 << max(0, (window // 4).bit_length() - 1))


def symbols(g: np.ndarray, at: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The suffixes at `at` to the depth of a window: first gram, second and third (32 bits each), and the rest."""
    last = window - gram
    k12 = (g[np.minimum(at + gram, at + last)] & HIGH) | (g[np.minimum(at + 2 * gram, at + last)] >> np.uint64(32))
    rest = g[at + last]
    for d in range(3 * gram, last, gram):
        rest = _mix(rest * P + g[at + d])
    return g[at], k12, rest


def prefixes(k0: np.ndarray, k12: np.ndarray, rest: np.ndarray) -> list[np.ndarray]:
    """Hashes of the prefixes of each length."""
    third = _mix(k0 * P + k12)
    return [k0, _mix(k0 * P + (k12 >> np.uint64(32))), third, _mix(third * P + rest)]


def subtree(keys: list[np.ndarray]) -> np.ndarray:
    """Internal nodes (depth in symbols, first leaf, last leaf) of the tree over sorted suffixes, one column a symbol."""
    n, out = len(keys[0]), []
    same, outer = np.ones(max(0, n - 1), bool), None
    levels = []
    for k in keys:
        same = same & (k[1:] == k[:-1])
        levels.append(same)
    for depth in range(len(levels), 0, -1):
        edge = np.diff(np.concatenate([[0], levels[depth - 1].astype(np.int8), [0]]))
        node = np.stack([np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)])
        if outer is not None and node.size:  # a node with the leaves of a deeper one is that one
            node = node[:, ~np.isin(node[0] * (n + 1) + node[1], outer)]
        found = node[0] * (n + 1) + node[1]
        outer = found if outer is None else np.concatenate([outer, found])
        out.append(np.stack([np.full(node.shape[1], depth), *node]))
    return np.concatenate(out, axis=1).T


def text_keys(text: Column) -> list[Column]:
    whole = F.sha2(F.coalesce(text, F.lit("")).cast("binary"), 256)
    return [F.xxhash64(whole).alias("__a"), F.xxhash64(F.lit(1), whole).alias("__b")]


def _bucketed(df: DataFrame) -> DataFrame:
    """df written bucketed by its text keys, so that joins on them move nothing; the catalog entry is dropped at once."""
    spark = df.sparkSession
    name = f"texts_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    df.write.bucketBy(n, *KEY).option("path", scratch(spark)).saveAsTable(name)
    out = spark.table(name)
    out.schema  # resolved before the entry goes; the files stay
    spark.sql(f"DROP TABLE {name}")
    return out


def starts_of(once: DataFrame, window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(__a, __b, __starts): the windows that also start elsewhere, of a bucketed table of distinct texts (__a, __b, t)."""
    gram = shape(window)
    span, spark = window - gram + 1, once.sparkSession

    def find(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "t"):
                g, bounds = grams(part["t"], gram)
                start = window_starts(bounds, window)
                at = anchors(g, span)[start]
                of = np.searchsorted(bounds, start, "right") - 1
                new = np.flatnonzero(np.diff(at, prepend=-1))
                edge = np.searchsorted(of[new], np.arange(len(part) + 1))
                values = g[at[new]].view(np.int64)
                some = np.flatnonzero(np.diff(edge))
                yield pd.DataFrame({"__a": part["__a"].to_numpy()[some], "__b": part["__b"].to_numpy()[some], "gs": [values[edge[i]:edge[i + 1]] for i in some]})

    found = materialize(once.mapInPandas(find, "__a long, __b long, gs array<long>")).select(*KEY, F.explode("gs").alias("g"))
    often = materialize(found.groupBy("g").count().filter("count > 1"))
    # anchors that are more than one in HOT of all, so fewer than HOT of them, are broadcast, so that no key meets in one task
    hot = max(4096, found.count() // HOT)
    many = F.broadcast(often.filter(F.col("count") > hot).select("g"))
    live = found.join(many, "g", "left_semi").unionByName(found.join(many, "g", "left_anti").join(often.filter(F.col("count") <= hot).select("g"), "g", "left_semi"))
    live = _bucketed(live.groupBy(*KEY).agg(F.collect_set("g").alias("gs")))
    both = once.join(live, KEY).select(*KEY, "t", "gs")

    # the sizes of groups and tables of prefixes: at most HEAVY prefixes can exceed a group
    most = (live.agg(F.sum(F.size("gs"))).first()[0] or 0) * span
    group = max(group, most // HEAVY)
    buckets = 1 << max(12, (16 * most // group).bit_length())

    def live_suffixes(part: pd.DataFrame):
        """Positions laid end to end, their bounds, and the symbols of the suffixes that may repeat."""
        g, bounds = grams(part["t"], gram)
        start = window_starts(bounds, window)
        value = g[anchors(g, span)[start]].view(np.int64)
        of = np.searchsorted(bounds, start, "right") - 1
        sets = [np.asarray(x, np.int64) for x in part["gs"]]
        known = np.unique(_mix(np.concatenate(sets).view(np.uint64) * P + np.repeat(np.arange(len(sets)), [len(x) for x in sets]).astype(np.uint64)))
        value = _mix(value.view(np.uint64) * P + of.astype(np.uint64))  # the anchor and its text
        new = np.flatnonzero(np.diff(value, prepend=value[:1] + np.uint64(1)))
        keep = np.repeat(known[np.minimum(np.searchsorted(known, value[new]), len(known) - 1)] == value[new], np.diff(np.append(new, len(value))))
        start, of = start[keep], of[keep]
        return start - bounds[of], of, symbols(g, start, window, gram)

    def level(parts: list[np.ndarray], heavy: list[np.ndarray]) -> np.ndarray:
        """The number of prefixes of each suffix that exceed a group."""
        out, on = np.zeros(len(parts[0]), np.int64), np.ones(len(parts[0]), bool)
        for h, big in zip(parts, heavy):
            on = on & np.isin((h % np.uint64(buckets)).astype(np.int64), big)
            out += on
        return out

    # a task sends the counts that reach `least`; what it keeps back is less than that for each bucket and task
    least, heavy = max(1, group // (4 * int(spark.conf.get("spark.sql.shuffle.partitions")))), []
    while len(heavy) < 3:
        held = spark.sparkContext.broadcast(heavy)

        def sizes(batches: Iterator[pd.DataFrame], held=held) -> Iterator[pd.DataFrame]:
            total = np.zeros(buckets, np.int64)
            for pdf in batches:
                for part in slices(pdf, "t"):
                    _, _, k = live_suffixes(part)
                    parts, depth = prefixes(*k), len(held.value)
                    on = level(parts, held.value) == depth
                    total += np.bincount((parts[depth][on] % np.uint64(buckets)).astype(np.int64), minlength=buckets)
            at = np.flatnonzero(total >= least)
            yield pd.DataFrame({"bucket": np.append(at, -1), "n": np.append(total[at], 1)})

        counts = materialize(both.mapInPandas(sizes, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")))
        tasks = counts.filter("bucket < 0").agg(F.sum("n")).first()[0] or 0
        big = counts.filter((F.col("bucket") >= 0) & (F.col("n") + tasks * (least - 1) > group)).select("bucket").toPandas()["bucket"].to_numpy(np.int64)
        if not len(big):
            break
        heavy.append(np.sort(big))
    held, frequent = spark.sparkContext.broadcast(heavy), None
    if len(heavy) == 3:  # whole windows, counted exactly
        def whole(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for part in slices(pdf, "t"):
                    _, _, k = live_suffixes(part)
                    parts = prefixes(*k)
                    on = level(parts, held.value) == 3
                    value, first, count = np.unique(parts[3][on], return_index=True, return_counts=True)
                    yield pd.DataFrame({"h": value.view(np.int64), "k": k[0][on][first].view(np.int64), "n": count})

        rows = both.mapInPandas(whole, "h long, k long, n long").groupBy("h", "k").agg(F.sum("n").alias("n")).filter(F.col("n") > group).select("h", "k").toPandas()
        rows = rows.sort_values("h")
        frequent = spark.sparkContext.broadcast((rows["h"].to_numpy(np.int64), rows["k"].to_numpy(np.int64)))

    def suffixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for part in slices(pdf, "t"):
                p, of, k = live_suffixes(part)
                parts = prefixes(*k)
                depth = level(parts, held.value)
                if frequent is not None and len(frequent.value[0]):
                    h, first = frequent.value
                    i = np.minimum(np.searchsorted(h, parts[3].view(np.int64)), len(h) - 1)
                    depth[(depth == 3) & (h[i] == parts[3].view(np.int64)) & (first[i] == k[0].view(np.int64))] = 4
                yield pd.DataFrame({"k0": k[0].view(np.int64), "k12": k[1].view(np.int64), "rest": k[2].view(np.int64),
                                    "__a": part["__a"].to_numpy()[of], "__b": part["__b"].to_numpy()[of], "at": p * 8 + depth})

    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    s = both.mapInPandas(suffixes, "k0 long, k12 long, rest long, __a long, __b long, at long")
    depth = F.col("at").bitwiseAND(F.lit(7))
    to = (F.when(depth == 0, F.xxhash64("k0")).when(depth == 1, F.xxhash64("k0", F.shiftright("k12", 32))).when(depth == 2, F.xxhash64("k0", "k12"))
          .when(depth == 3, F.xxhash64("k0", "k12", "rest")).otherwise(F.xxhash64("__a", "__b", "at")))
    s = s.repartition(n, to).sortWithinPartitions("k0", "k12", "rest")

    def trees(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        """One subtree a batch of whole prefixes; leaves under nodes of a window's depth."""
        def leaves(pdf: pd.DataFrame) -> pd.DataFrame:
            hit = (pdf["at"].to_numpy() & 7) == 4
            nodes = subtree([pdf[c].to_numpy() for c in ("k0", "k12", "rest")])
            deep = nodes[nodes[:, 0] == 3]
            edge = np.zeros(len(pdf) + 1, np.int64)
            np.add.at(edge, deep[:, 1], 1)
            np.add.at(edge, deep[:, 2] + 1, -1)
            hit |= np.cumsum(edge)[:-1] > 0
            found = pdf.loc[hit, KEY]
            return found.assign(p=(pdf["at"].to_numpy()[hit] >> 3).astype(np.int32))

        held_rows = None
        for pdf in batches:
            pdf = pdf if held_rows is None else pd.concat([held_rows, pdf], ignore_index=True)
            # the last prefix may go on; its frequent windows are decided and need not be held
            k0, k12, rest, d = (pdf[c].to_numpy() for c in ("k0", "k12", "rest", "at"))
            d = d[1:] & 7
            new = k0[1:] != k0[:-1]
            for least, k in ((1, k12 >> 32), (2, k12), (3, rest)):
                new |= (d >= least) & (k[1:] != k[:-1])
            cut = int(np.flatnonzero(new)[-1]) + 1 if new.any() else 0
            tail = pdf.iloc[cut:]
            sure = (tail["at"].to_numpy() & 7) == 4
            yield leaves(pd.concat([pdf.iloc[:cut], tail[sure]]) if sure.any() else pdf.iloc[:cut])
            held_rows = tail[~sure]
        if held_rows is not None and len(held_rows):
            yield leaves(held_rows)

    return s.mapInPandas(trees, "__a long, __b long, p int").groupBy(*KEY).agg(F.collect_list("p").alias("__starts"))


def spans(starts, window: int = WINDOW) -> list[tuple[int, int]]:
    """Maximal repeats of a text as (first word, words), from the windows that repeat."""
    s = np.unique(np.asarray(starts, np.int64))
    if not len(s):
        return []
    new = np.flatnonzero(np.diff(s, prepend=s[0] - 2) > 1)
    last = s[np.append(new[1:], len(s)) - 1]
    return [(int(a), int(b - a + window)) for a, b in zip(s[new], last)]


def kept(text: str | None, starts, whole: bool, window: int = WINDOW) -> tuple[list[bytes], int]:
    words = split(text)
    if whole and len(words) >= window:
        return [], len(words)
    if starts is None or not len(starts):
        return words, len(words)
    edge = np.zeros(len(words) + 1, np.int32)
    for a, n in spans(starts, window):
        edge[a] += 1
        edge[a + n] -= 1
    keep = np.cumsum(edge)[:-1] == 0
    return list(itertools.compress(words, keep)), len(words)


def distinct_cuts(df: DataFrame, text_col: str = "text", window: int = WINDOW, group: int = GROUP) -> DataFrame:
    """(__a, __b, kept, n, k): kept text, words and kept words of each distinct text.

    The distinct texts are written bucketed by their keys, so that the later joins move positions, not texts.
    """
    rows = df.select(*text_keys(F.col(text_col)), F.coalesce(F.col(text_col), F.lit("")).alias("t"))
    once = _bucketed(rows.groupBy(*KEY).agg(F.first("t").alias("t"), F.count("*").alias("c")))

    @F.pandas_udf("kept string, n long, k long")
    def cut(text: pd.Series, starts: pd.Series, whole: pd.Series) -> pd.DataFrame:
        done = [kept(t, s, w, window) for t, s, w in zip(text, starts, whole)]
        return pd.DataFrame({"kept": [b" ".join(w).decode("utf-8", "surrogatepass") for w, _ in done], "n": [n for _, n in done], "k": [len(w) for w, _ in done]})

    out = once.join(starts_of(once.select(*KEY, "t"), window, group), KEY, "left").withColumn("__cut", cut("t", "__starts", F.col("c") > 1))
    return out.select(*KEY, "__cut.kept", "__cut.n", "__cut.k")


def remove_repeats(df: DataFrame, text_col: str = "text", window: int = WINDOW, out: str = "kept_text", group: int = GROUP) -> DataFrame:
    """df with the kept text, and __n_words and __n_kept."""
    cuts = distinct_cuts(df, text_col, window, group)
    a, b = text_keys(F.col(text_col))
    m = df.withColumn("__a", a).withColumn("__b", b).join(cuts, KEY)
    return m.select(*[c for c in df.columns if c != out], F.col("kept").alias(out), F.col("n").alias("__n_words"), F.col("k").alias("__n_kept"))


def op6_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir)
    cuts = distinct_cuts(docs).select(*KEY, F.col("n").alias("n_words"), (F.col("n") - F.col("k")).alias("n_removed"), F.sha2("kept", 256).alias("kept_sha256"))
    return docs.select("doc_id", *text_keys(F.col("text"))).join(cuts, KEY).drop(*KEY)
