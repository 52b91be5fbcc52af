"""9. Benchmark decontamination with a broadcast hash set of normalised test n-grams, in DataFrame functions only.

Texts are lower-cased (A-Z) and cut into words of letters and digits (any code point beyond ASCII counts). Every
run of `window` item words, or a shorter item's whole sequence, is a window. Each document's runs of the window
lengths that occur are scanned against the set: the join on the window's hash compares the window itself too,
which verifies hits. The set is broadcast only if its counted rows are within `limit` and its bytes within BYTES; beyond them, the join shuffles.

Null and empty texts have no words and no hits; items without words have no windows. Items of equal text all count.
Repeated rows each get a row. An item without id counts among the items but is not listed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import ascii_lower, bind, documents, materialize

WINDOW, LIMIT, BYTES = 10, 2_000_000, 256 << 20
WORD = r"([^\x00-\x2F\x3A-\x60\x7B-\x7F]+)"


def words(text: Column) -> Column:
    return F.regexp_extract_all(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(WORD), 1)


def runs(w: Column, size: int | Column) -> Column:
    """The words' runs of one length, as (p, w) structs."""
    n = F.size(w) - size + 1

    def run(i: Column) -> Column:  # slice() copies the whole array each time
        return F.concat_ws(" ", *[F.get(w, i + (j - 1)) for j in range(size)]) if isinstance(size, int) else F.array_join(F.slice(w, i, size), " ")

    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.struct(i.alias("p"), run(i).alias("w")))).otherwise(F.array().cast("array<struct<p:int,w:string>>"))


def item_windows(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """(w, len, items): each window text with the ids of its items, as structs since a set drops nulls."""
    w = items.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("ws")).filter(F.size("ws") > 0)
    w = w.withColumn("len", F.least(F.size("ws"), F.lit(window)))
    w = w.select("item", "len", F.explode(runs(F.col("ws"), F.col("len"))).alias("r")).select("item", "len", "r.w")
    return w.groupBy("w", "len").agg(F.collect_set(F.struct("item")).alias("items"))


def scan(df: DataFrame, items: DataFrame, text_col: str = "text", window: int = WINDOW, limit: int = LIMIT) -> DataFrame:
    """(__row, n_words, n_hit, n_items, items, spans) and first values of df's columns, one per row of df."""
    known = item_windows(items, window)
    size = F.length("w") + 32 + F.aggregate("items", F.lit(0), lambda a, x: a + F.coalesce(F.length(x["item"]), F.lit(0)) + 24)
    stats = known.groupBy("len").agg(F.count("*").alias("count"), F.sum(size).alias("bytes")).collect()  # at most `window` rows
    sizes = sorted(r["len"] for r in stats) or [window]
    if sum(r["count"] for r in stats) <= limit and sum(r["bytes"] for r in stats) <= BYTES:
        known = F.broadcast(known)
    flat = df.withColumn("__ws", words(F.col(text_col))).withColumn("__row", F.monotonically_increasing_id())
    own = [c for c in df.columns if c != text_col]
    runs_of = F.array_compact(F.concat(F.array(F.struct(F.lit(0).alias("p"), F.lit("").alias("w"))), *[runs(F.col("__ws"), s) for s in sizes]))
    cut = flat.select("__row", *own, F.size("__ws").cast("long").alias("n_words"), F.explode(runs_of).alias("r"))
    hits = cut.select("__row", *own, "n_words", F.col("r.p").alias("__p"), F.col("r.w").alias("__w")).join(known.withColumnRenamed("w", "__w"), "__w", "left")
    hits = hits.filter(F.col("len").isNotNull() | (F.col("__p") == 0))
    out = hits.groupBy("__row").agg(
        *[F.first(c).alias(c) for c in own], F.first("n_words").alias("n_words"),
        F.collect_set(F.when(F.col("len").isNotNull() & (F.col("__p") > 0), F.struct(F.col("__p").alias("p"), F.col("len").alias("n")))).alias("spans"),
        F.flatten(F.collect_set(F.when(F.col("__p") > 0, F.col("items")))).alias("items"))
    covered = F.array_distinct(F.flatten(F.transform("spans", lambda s: F.sequence(s["p"], s["p"] + s["n"] - 1))))
    out = out.withColumn("__items", F.array_distinct("items")).withColumn("n_items", F.size("__items").cast("long"))
    listed = F.array_sort(F.array_compact(F.transform("__items", lambda x: x["item"])))
    return out.withColumn("items", listed).drop("__items").withColumn("n_hit", F.size(covered).cast("long"))


def decontaminate(df: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", **more) -> DataFrame:
    """df without the documents that a window hits, known by 128 bits of hashes of id and text. A null id is kept only if its text has no hit."""
    parts = [F.col(id_col).isNull(), F.col(id_col), F.col(text_col)]  # rows of equal id and text share their fate
    keyed = df.withColumn("__a", F.xxhash64(*parts)).withColumn("__b", F.xxhash64(F.lit(1), *parts))
    bad = scan(keyed.select("__a", "__b", text_col), items, text_col, **more).filter("n_hit > 0").select("__a", "__b").distinct()
    bad = materialize(bad)  # its size is known, so that a small one is broadcast and no text moves
    return keyed.join(bad, ["__a", "__b"], "left_anti").select(*df.columns)


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = scan(documents(spark, sf_dir).select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"))
