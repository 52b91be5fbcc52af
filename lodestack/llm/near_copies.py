"""Near copies: SimHash links by covering tables and MinHash candidates, each verified by the Jaccard likeness of whole shingle sets.

A row's set holds the distinct 64-bit hashes of its shingles (words as in simhash.py; fewer words than one shingle
form one shingle, no words the empty set). Equal sets are merged first. Sets whose SimHash fingerprints differ in at most
RADIUS bits are candidates by simhash.links, none of them missed. Copies of a likeness near 0.8 differ in more bits, so
BANDS bands of WIDTH minima add their keys: a pair of likeness J shares one with probability 1 - (1 - J^WIDTH)^BANDS, 0.9994 at 0.8.
Rows of a key are linked as a star, never as pairs, and the stars' components are only a bound: inside each of them
all pairs of sets are compared exactly, but for pairs that verified links join already. Chance keys join nothing.
No task holds more than about `block` sets. Cost is quadratic only in the sets of a candidate component that the
first rounds of comparisons leave outside its largest verified part.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize
from .simhash import RADIUS, components, fingerprint, links, shingle_hashes

SIMILARITY, WIDTH, BANDS, BLOCK = 0.8, 8, 40, 128
_r = np.random.default_rng(20)
_MUL, _ADD = (_r.integers(0, 1 << 32, (WIDTH * BANDS, 1), np.uint64).astype(np.uint32) for _ in range(2))
_MUL |= np.uint32(1)


def shingle_set(text: str | None, words_per_shingle: int) -> np.ndarray:
    """Sorted distinct shingle hashes of one text."""
    parts = [np.unique(h) for h in shingle_hashes(text, words_per_shingle)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)


def band_keys(s: np.ndarray) -> np.ndarray:
    """One 64-bit key of each band; none for the empty set, which only equals itself."""
    if not len(s):
        return np.zeros(0, np.int64)
    low, least = (s >> np.uint64(32)).astype(np.uint32), np.full(len(_MUL), 0xFFFFFFFF, np.uint32)
    for at in range(0, len(low), 512):  # a block of products stays in the cache
        np.minimum(least, (low[at:at + 512] * _MUL + _ADD).min(1), out=least)
    return np.array([xxhash.xxh64_intdigest(b.tobytes()) for b in least.reshape(BANDS, WIDTH)], np.uint64).view(np.int64)


def alike(sets: list[np.ndarray], similarity: float) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs a < b of sets with |A & B| >= similarity * |A | B|, from exact counts."""
    n, sizes = len(sets), np.array([len(s) for s in sets], np.int64)
    at, rows = np.concatenate(sets), np.repeat(np.arange(n), sizes)
    _, col, count = np.unique(at, return_inverse=True, return_counts=True)
    shared = count[col] > 1  # a shingle of one set is in no intersection
    rows, col = rows[shared], col[shared]
    order = np.argsort(col, kind="stable")
    rows, col = rows[order], np.unique(col[order], return_inverse=True)[1]
    both, width = np.zeros((n, n), np.int64), 1 << 13
    for lo in range(0, int(col[-1]) + 1 if len(col) else 0, width):
        i, j = np.searchsorted(col, (lo, lo + width))
        m = np.zeros((n, width), np.float32)
        m[rows[i:j], col[i:j] - lo] = 1
        both += (m @ m.T).astype(np.int64)
    a, b = np.triu_indices(n, 1)
    inter = both[a, b]
    near = inter >= similarity * (sizes[a] + sizes[b] - inter) - 1e-9
    return a[near], b[near]


def fingerprint_links(prints: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(a, b): stars over __set whose components are those of all pairs of (__set, __fp) rows with fingerprints within the radius."""
    least = materialize(prints.groupBy("__fp").agg(F.min("__set").alias("root")))
    same = prints.join(least, "__fp").filter("__set <> root").select(F.col("root").alias("a"), F.col("__set").alias("b"))
    near = links(least.select("__fp"), radius)
    for end in ("a", "b"):
        near = near.join(least.select(F.col("__fp").alias(end), F.col("root").alias(f"{end}_")), end)
    return same.unionByName(near.select(F.col("a_").alias("a"), F.col("b_").alias("b")))


def candidates(keys: DataFrame, linked: DataFrame | None = None) -> DataFrame:
    """(v, c): candidate components over __set, from keys (__set, __keys) and links (a, b) of sets."""
    keyed = keys.select("__set", F.posexplode("__keys").alias("band", "key"))
    stars = materialize(keyed.groupBy("band", "key").agg(F.min("__set").alias("a"), F.count("*").alias("n")).filter("n > 1"))
    # a set's stars, at most one a band, are joined at their least root, so that a large group has about one edge a set and not one a band
    roots = keyed.join(stars, ["band", "key"]).filter("__set <> a").groupBy("__set").agg(F.array_sort(F.collect_set("a")).alias("roots"))
    ends = F.concat(F.array("__set"), F.slice("roots", 2, BANDS))
    edges = roots.select(F.col("roots")[0].alias("a"), F.explode(ends).alias("b"))
    return components((edges if linked is None else edges.unionByName(linked)).distinct())


def _compare(groups: DataFrame, hashes: DataFrame, similarity: float) -> DataFrame:
    """(a, b): within each group of groups (__set, group), stars over the components of its verified pairs."""

    def stars(pdf: pd.DataFrame) -> pd.DataFrame:
        ids = pdf["__set"].to_numpy()
        a, b = alike([np.frombuffer(x, np.uint64) for x in pdf["hashes"]], similarity)
        root = np.arange(len(ids))
        while True:  # each set takes the least root of its neighbours
            new = root.copy()
            np.minimum.at(new, a, root[b])
            np.minimum.at(new, b, root[a])
            new = new[new]
            if (new == root).all():
                break
            root = new
        member = root != np.arange(len(ids))
        return pd.DataFrame({"a": ids[member], "b": ids[root[member]]})

    return materialize(groups.join(hashes, "__set").groupBy("group").applyInPandas(stars, "a long, b long").distinct())


def verified(members: DataFrame, hashes: DataFrame, similarity: float = SIMILARITY, block: int = BLOCK) -> DataFrame:
    """(v, c): the components over all pairs with the similarity, from candidate components (__set, c) and (__set, hashes).

    A component above `block` sets is first cut into blocks in two ways, which joins most of a group of near copies at
    linear cost. Its sets outside the largest part joined so are then compared with all others, block by block.
    """
    sizes = materialize(members.groupBy("c").agg(F.count("*").alias("n")))

    def dealt(seed: int, n):
        return F.pmod(F.xxhash64("__set", F.lit(seed)), F.ceil(n).cast("int")).cast("string")

    def named(*parts):
        return F.concat_ws(":", F.col("c").cast("string"), *parts)

    rows = members.join(sizes, "c")
    cut = F.when(F.col("n") <= block, F.array(named(F.lit("all")))).otherwise(F.array(*[named(F.lit(str(i)), dealt(i, F.col("n") / block)) for i in (1, 2)]))
    edges = _compare(rows.select("__set", F.explode(cut).alias("group")), hashes, similarity)
    joined = components(edges)
    rows = rows.filter(F.col("n") > block).join(joined.select(F.col("v").alias("__set"), F.col("c").alias("part")), "__set", "left")
    rows = materialize(rows.withColumn("part", F.coalesce("part", "__set")))
    if rows.isEmpty():
        return joined
    largest = rows.groupBy("c", "part").agg(F.count("*").alias("main")).groupBy("c").agg(F.max(F.struct("main", "part")).alias("m"))
    rows = rows.join(largest, "c").select("*", F.ceil(F.col("m.main") * 2 / block).alias("mains"), F.ceil((F.col("n") - F.col("m.main")) * 2 / block).alias("others"))
    rows = rows.filter("others > 0").withColumn("is_main", F.col("part") == F.col("m.part"))
    rows = rows.withColumn("own", F.when(F.col("is_main"), F.concat(F.lit("m"), dealt(3, F.col("mains")))).otherwise(F.concat(F.lit("o"), dealt(3, F.greatest("others", F.lit(1))))))
    others = F.transform(F.sequence(F.lit(0), F.col("others") - 1), lambda i: F.concat(F.lit("o"), i.cast("string")))
    mains = F.transform(F.sequence(F.lit(0), F.col("mains") - 1), lambda i: F.concat(F.lit("m"), i.cast("string")))
    rows = rows.withColumn("other", F.explode(F.when(F.col("is_main"), others).otherwise(F.concat(others, mains))))
    return components(edges.unionByName(_compare(rows.select("__set", named(F.least("own", "other"), F.greatest("own", "other")).alias("group")), hashes, similarity)))


def keep_one(df: DataFrame, words_per_shingle: int = 5, similarity: float = SIMILARITY, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """One row of each component of verified near copies (least id first), with the columns of df.

    Rows without words have equal, empty sets: one of them is kept.
    """
    k = words_per_shingle

    @F.pandas_udf("digest binary, __fp long, __keys array<long>")
    def keys(texts: pd.Series) -> pd.DataFrame:
        rows = []
        for t in texts:
            parts = list(shingle_hashes(t, k))
            s = np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.uint64)
            rows.append((xxhash.xxh3_128_digest(s.tobytes()), fingerprint(parts), band_keys(s)))
        return pd.DataFrame(rows, columns=["digest", "__fp", "__keys"])

    @F.pandas_udf("binary")
    def hashes(texts: pd.Series) -> pd.Series:
        return pd.Series([shingle_set(t, k).tobytes() for t in texts], dtype="object")

    rows = materialize(df.withColumn("__row", F.monotonically_increasing_id()).withColumn("__k", keys(text_col)))
    key = F.struct(F.col(id_col).isNull().alias("none"), F.col(id_col).alias("id"), F.col("__row").alias("row"))
    # a set is named by the row that stands for it
    sets = rows.groupBy("__k.digest").agg(F.min(key).alias("least"))
    sets = materialize(sets.select("least", F.col("least.row").alias("__set")))
    firsts = rows.join(sets.select(F.col("__set").alias("__row")), "__row")
    firsts = materialize(firsts.select(F.col("__row").alias("__set"), "__k.__fp", "__k.__keys"))
    worded = firsts.filter(F.size("__keys") > 0)  # the empty set only equals itself
    parts = materialize(candidates(firsts.select("__set", "__keys"), fingerprint_links(worded.select("__set", "__fp"))))
    texts = rows.select(F.col("__row").alias("v"), F.col(text_col).alias("__t")).join(parts, "v")
    whole = materialize(texts.select(F.col("v").alias("__set"), hashes("__t").alias("hashes")))
    linked = verified(parts.withColumnRenamed("v", "__set"), whole, similarity, block)
    heads = sets.join(linked, F.col("__set") == F.col("v"), "left").groupBy(F.coalesce("c", "__set").alias("c")).agg(F.min("least").alias("head"))
    return rows.join(heads.select(F.col("head.row").alias("__row")), "__row").select(*df.columns)
