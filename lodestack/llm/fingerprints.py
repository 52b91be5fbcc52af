"""1. Order MinHash fingerprints, sensitive to edit distance, in DataFrame functions only.

Pieces are runs of up to 24 non-space code points; longer runs, as in scripts without spaces, are cut into single code points, so
that an insertion changes only what is near it. Elements are k-mers of pieces, each numbered by its occurrence among equal
k-mers, so that repeats count. The `sketch` elements of least base hash represent a long text (a bottom sketch, all
elements of a short one). Hash function j of m independent ones orders them anew; for each j the l least elements are
taken, put back into text order and hashed to one value. Likeness is the share of equal values.

Null and empty texts, and texts of white space only, have the fingerprint of m zeros and are 1.0 alike with
each other; fewer than k pieces form one k-mer, so a text of up to k pieces has one element and any edit of it gives 0.
Equal texts have equal fingerprints whatever their row. Repeated rows each get a row; ties of doc_id are ordered by the
text's hash. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import bind, documents

K, L, M, SKETCH = 3, 2, 32, 64
PIECE = r"((?<![^\x20\x09-\x0D])[^\x20\x09-\x0D]{1,24}+(?![^\x20\x09-\x0D])|[^\x20\x09-\x0D])"


def _elements(pieces: Column, k: int) -> Column:
    """Sorted (base hash, position) of each occurrence-numbered k-mer."""
    last = F.greatest(F.size(pieces) - F.lit(k - 1), F.lit(1))
    mers = F.transform(F.sequence(F.lit(1), last), lambda i: F.struct(F.xxhash64(*[F.get(pieces, i + (j - 1)) for j in range(k)]).alias("h"), i.alias("p")))

    def numbered(s: Column) -> Column:
        first = F.filter(F.sequence(F.lit(0), F.size(s) - 1), lambda i: (i == 0) | (F.get(s, i)["h"] != F.get(s, i - 1)["h"]))

        def runs(f: Column) -> Column:
            return F.flatten(F.transform(f, lambda a, r: F.transform(
                F.sequence(a, F.coalesce(F.get(f, r + 1), F.size(s)) - 1),
                lambda i: F.struct(F.xxhash64(F.get(s, i)["h"], i - a).alias("b"), F.get(s, i)["p"].alias("p")))))

        return bind(first, runs)

    return F.sort_array(bind(F.sort_array(mers), numbered))


def signature(text: Column, k: int = K, l: int = L, m: int = M, sketch: int = SKETCH) -> Column:
    """array<int> of m values for a text column."""
    pieces = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(PIECE), 1)

    def of(e: Column) -> Column:
        def all_of(bases: Column) -> Column:
            def one(j: Column) -> Column:
                def least(v: Column) -> Column:
                    def taken(*values: Column) -> Column:
                        if len(values) < l:
                            return bind(F.array_min(F.filter(v, lambda x: x > values[-1]) if values else v), lambda t: taken(*values, t))
                        at = [F.get(e, F.array_position(v, t).cast("int") - 1) for t in values]  # null where a text has fewer elements
                        return F.hash(F.transform(F.array_sort(F.array_compact(F.array(*[F.struct(x["p"].alias("p"), x["b"].alias("b")) if i == 0 else F.when(values[i].isNotNull(), F.struct(x["p"].alias("p"), x["b"].alias("b"))) for i, x in enumerate(at)]))), lambda x: x["b"]))

                    return taken()

                return bind(F.transform(bases, lambda b: F.xxhash64(b, j)), least)

            return F.transform(F.sequence(F.lit(0), F.lit(m - 1)), one)

        return bind(F.transform(e, lambda x: x["b"]), all_of)

    return bind(pieces, lambda p: F.when(F.size(p) == 0, F.array_repeat(F.lit(0), m)).otherwise(bind(F.slice(_elements(p, k), 1, sketch), of)))


def as_text(sig: Column) -> Column:
    return F.array_join(F.transform(sig, lambda x: F.lpad(F.lower(F.hex(x.cast("long").bitwiseAND(F.lit(0xFFFFFFFF)))), 8, "0")), "")


def likeness(a: Column, b: Column, m: int = M) -> Column:
    """Share of equal values."""
    return F.size(F.filter(F.arrays_zip(a.alias("a"), b.alias("b")), lambda x: x["a"] == x["b"])) / F.lit(float(m))


def fingerprint(df: DataFrame, text_col: str = "text", k: int = K, l: int = L, m: int = M, sketch: int = SKETCH, out: str = "fingerprint") -> DataFrame:
    """df with its fingerprints (array<int>) in the column out, which replaces one of that name."""
    return df.withColumn(out, signature(F.col(text_col), k, l, m, sketch))


def with_next(df: DataFrame, id_col: str, *cols: str) -> DataFrame:
    """df with __next, a struct of cols of the row after it by id (after the last: the first); ties follow the text's hash, cols[0].

    Ids are cut at approximate quantiles into buckets, and the rows at a bucket's lower bound are also sent to the bucket
    before, behind its own: one exchange carries each text once and no join is needed. The driver and the plan hold the bounds only,
    eight a shuffle partition, as one value that is searched by halving. Null ids come first; rows of one id stay together.
    """
    buckets = 8 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ids = F.col(id_col)
    found = df.agg(F.percentile_approx(ids, [i / buckets for i in range(buckets)], 20 * buckets).alias("q"), F.min(ids).alias("least"), F.count_if(ids.isNull()).alias("nulls")).first()
    bounds = np.array(sorted({*(found["q"] or []), *([found["least"]] if found["least"] is not None else [])}) or [0])
    edges = F.lit(bounds)

    def halve(s: Column, _: Column) -> Column:
        middle = F.shiftright(s["lo"] + s["hi"], 1)
        return F.when(F.get(edges, middle) <= ids, F.struct(middle.alias("lo"), s["hi"].alias("hi"))).otherwise(F.struct(s["lo"].alias("lo"), middle.alias("hi")))

    # lo is the last bound at or below the id, hi the first above it
    span = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))
    at = F.when(ids.isNull(), F.lit(0)).otherwise(F.aggregate(F.sequence(F.lit(1), F.lit(max(1, len(bounds).bit_length()))), span, halve)["lo"])
    first = ids.isNull() if found["nulls"] else ids == F.lit(bounds[0].item())  # the first of all rows are the nulls, if any
    bound = F.when(F.col("__at") == 0, first).otherwise(F.get(edges, F.col("__at")) == ids)
    rows = df.withColumn("__at", at)
    before = F.pmod(F.col("__at") - 1, F.lit(len(bounds)))
    sent = F.when(bound, F.array(F.struct(F.col("__at").alias("b"), F.lit(False).alias("copy")), F.struct(before.alias("b"), F.lit(True).alias("copy")))).otherwise(F.array(F.struct(F.col("__at").alias("b"), F.lit(False).alias("copy"))))
    rows = rows.withColumn("__to", F.explode(sent)).withColumn("__b", F.col("__to.b")).withColumn("__copy", F.col("__to.copy"))
    order = Window.partitionBy("__b").orderBy("__copy", id_col, F.xxhash64(cols[0]))
    return rows.withColumn("__next", F.lead(F.struct(*cols)).over(order)).filter(~F.col("__copy")).drop("__at", "__to", "__b", "__copy")


def op1_order_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = with_next(fingerprint(docs, "text", out="a"), "doc_id", "text", "a").withColumn("n_chars", F.char_length("text").cast("long"))
    quarter = F.floor(F.col("n_chars") / 4).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), F.col("n_chars").cast("int") - quarter), F.substring(F.col("__next.text"), F.lit(1), quarter))
    own = fingerprint(both.withColumn("edited", edited), "edited", out="e")
    return own.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), as_text(F.col("a")).alias("fingerprint"), as_text(F.col("e")).alias("edited_fingerprint"),
        likeness(F.col("a"), F.col("e")).alias("near_edited"), likeness(F.col("a"), F.col("__next.a")).alias("near_next"))
