"""10. Mixing sources to target weights by the cube method of balanced sampling.

A source's target over its size is the rate of each of its documents: the whole part is taken for certain, the
fraction is an inclusion probability. Within blocks of at most about `block` documents of one source, the flight phase
moves three fractional probabilities at a time along the null space of the constraints (document count, words)
until two are left; these survivors form blocks of their own, until one block a source is left. Its last `LAND`
documents stay out of the flight; landing takes the choice of them and the two survivors that comes nearest the expected words.

A row is known by the hash of its contents and its number among equal rows, which alone decide blocks, order and seeds: reruns
agree whatever the layout. Equal rows are alike, so it does not matter which of them is taken.

Weights 5, 2, 1 repeat over the sources by code point, null last; targets stop at `most` times a source's size and
the excess is dealt out by weight until none is above. Null and empty texts have size 0 and follow their
source's rate. Repeated rows are drawn one by one. An empty table gives an empty result. Sources are a table like any other;
it is broadcast only while it has at most `BROADCAST` rows.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import SPACE_WORDS, documents, materialize, ranked

WEIGHTS, SHARE, MOST, BLOCK, LAND, EPS, BROADCAST = (5.0, 2.0, 1.0), 1.5, 2.0, 2000, 10, 1e-9, 200_000


def targets(sources: DataFrame, source_col: str, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """sources (source_col, z: its size) with target.

    A target is the least of weight times a common level and most times the size; each round raises the level by the excess of
    the sources above. A round is one aggregate, and rounds end when none is newly above.
    """
    rows, _ = ranked(sources, F.col(source_col).isNull(), F.col(source_col), name="__i")
    w = F.element_at(F.array(*map(F.lit, weights)), (F.col("__i") % len(weights) + 1).cast("int"))
    rows = rows.withColumn("__w", w).withColumn("__most", F.col("z") * F.lit(float(most)))
    level, above = 0.0, -1
    while True:
        over = F.col("__w") * F.lit(level) > F.col("__most") if above >= 0 else F.lit(False)
        got = rows.agg(F.sum("z"), F.sum(F.when(over, F.col("__most")).otherwise(0.0)), F.sum(F.when(over, 0.0).otherwise(F.col("__w"))), F.count_if(over)).first()
        if got[3] == above or not got[2]:
            break
        above, level = got[3], (share * got[0] - got[1]) / got[2]
    return rows.withColumn("target", F.least(F.col("__w") * F.lit(level), F.col("__most"))).drop("__w", "__most")


def flight(p: np.ndarray, size: np.ndarray, rng) -> np.ndarray:
    """Move p within the null space of (1, size) until at most two entries are fractional."""
    p, live = p.astype(float), []
    for i in range(len(p)):
        if EPS < p[i] < 1 - EPS:
            live.append(i)
        while len(live) == 3:
            a, b, c = live
            u = np.array([size[b] - size[c], size[c] - size[a], size[a] - size[b]], float)
            if not u.any():
                u = np.array([1.0, -1.0, 0.0])
            q = p[live]
            up = min((1 - x) / v if v > 0 else x / -v for x, v in zip(q, u) if v)
            down = min(x / v if v > 0 else (1 - x) / -v for x, v in zip(q, u) if v)
            q = q + u * (up if rng.random() * (up + down) < down else -down)
            p[live] = np.where(q < EPS, 0.0, np.where(q > 1 - EPS, 1.0, q))
            live = [x for x in live if EPS < p[x] < 1 - EPS]
    return p


def land(p: np.ndarray, size: np.ndarray) -> np.ndarray:
    """The few fractional entries: the choice nearest the expected words, then the expected count."""
    live = [i for i in range(len(p)) if EPS < p[i] < 1 - EPS]
    out = p.copy()
    if live:
        z = size[live]
        choice = np.array(list(itertools.product((0.0, 1.0), repeat=len(live))))
        off, count = np.abs(choice @ z - p[live] @ z), np.abs(choice.sum(1) - p[live].sum())
        out[live] = choice[np.lexsort((np.arange(len(choice)), count, off))[0]]
    return np.round(out)


def settle(p: np.ndarray, size: np.ndarray, rng, last: bool) -> np.ndarray:
    """Flight of a block; the last block of a source lands, with its last documents kept for that."""
    if not last:
        return flight(p, size, rng)
    keep = max(0, len(p) - LAND)
    return land(np.concatenate([flight(p[:keep], size[:keep], rng), p[keep:]]), size)


def numbered(rows: DataFrame) -> DataFrame:
    """rows (__row, __h, ...) with __no, the number among rows of equal __h; large groups are numbered by input partition."""
    part = F.shiftright("__row", 33)
    often = materialize(rows.groupBy("__h").count().filter("count > 1").select("__h"))
    again = materialize(rows.select("__h", "__row").join(often, "__h", "left_semi").withColumn("__part", part))
    sizes = again.groupBy("__h", "__part").agg(F.count("*").alias("n"))
    before = Window.partitionBy("__h").orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.withColumn("__first", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    inside = F.row_number().over(Window.partitionBy("__h", "__part").orderBy("__row"))
    again = again.withColumn("__in", inside).join(sizes, ["__h", "__part"]).select("__row", (F.col("__first") + F.col("__in") - 1).alias("__no"))
    return rows.join(again, "__row", "left").withColumn("__no", F.coalesce("__no", F.lit(0)).cast("long"))


def mix(df: DataFrame, size_col: str = "__size", source_col: str = "source", block: int = BLOCK, **law) -> DataFrame:
    """df with source_size, target and times (how often the row is taken)."""
    base = df.drop("source_size", "target", "times")
    sources = materialize(base.groupBy(source_col).agg(F.sum(size_col).alias("z"), F.count("*").alias("__n")))
    table = materialize(targets(sources, source_col, **law))
    rate = F.when(F.col("z") > 0, F.col("target") / F.col("z")).otherwise(0.0)
    table = table.select(F.col(source_col).alias("__s"), F.col("z").alias("source_size"), "target", rate.alias("__rate"), "__n", "__i")
    stats = table.agg(F.count("*"), F.max("__n")).first()
    table = F.broadcast(table) if stats[0] <= BROADCAST else table
    h = F.xxhash64(*[F.col(c) for c in sorted(base.columns)])
    out = base.join(table, F.col(source_col).eqNullSafe(F.col("__s"))).drop("__s").withColumn("__h", h)
    out = materialize(out.withColumn("__row", F.monotonically_increasing_id()))
    p = out.select("__row", "__h", "__i", "__n", F.col(size_col).alias("__z"), (F.col("__rate") - F.floor("__rate")).alias("__p"))
    undecided, done, level, most = numbered(p.filter((F.col("__p") > EPS) & (F.col("__p") < 1 - EPS))), None, 0, stats[1] or 0

    def fly(last: bool, level: int):
        def group(pdf: pd.DataFrame) -> pd.DataFrame:
            pdf = pdf.sort_values(["__h", "__no"], kind="stable")
            seed = [level, int(pdf["__i"].iloc[0]), int(pdf["__b"].iloc[0])]
            pdf["__p"] = settle(pdf["__p"].to_numpy(), pdf["__z"].to_numpy(float), np.random.default_rng(seed), last)
            return pdf
        return group

    while True:
        last = most <= block
        blocks = F.lit(0) if last else F.pmod(F.xxhash64("__h", "__no", F.lit(level)), F.greatest(F.ceil(F.col("__n") / block), F.lit(1)))
        dealt = undecided.withColumn("__b", blocks.cast("long"))
        moved = materialize(dealt.groupBy("__i", "__b").applyInPandas(fly(last, level), dealt.schema)).drop("__b")
        settled = moved.filter((F.col("__p") <= EPS) | (F.col("__p") >= 1 - EPS))
        done = settled if done is None else done.unionByName(settled)
        if last:
            break
        undecided = moved.filter((F.col("__p") > EPS) & (F.col("__p") < 1 - EPS)).withColumn("__n", F.ceil(F.col("__n") / block).cast("long") * 2)
        most, level = -(-most // block) * 2, level + 1
    out = out.join(done.select("__row", F.col("__p").alias("__pick")), "__row", "left")
    times = (F.floor(F.col("__rate") + EPS) + F.coalesce(F.round("__pick"), F.lit(0))).cast("int")
    return out.withColumn("times", times).drop("__row", "__h", "__i", "__n", "__rate", "__pick")


def with_size(df: DataFrame, text_col: str = "text") -> DataFrame:
    return df.withColumn("__size", F.coalesce(F.regexp_count(F.col(text_col), F.lit(SPACE_WORDS)), F.lit(0)).cast("long"))


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = with_size(documents(spark, sf_dir).select("doc_id", "source", "text")).drop("text")
    out = mix(docs)
    return out.select("doc_id", F.col("__size").alias("size"), "source_size", "target", (F.col("times") * F.col("__size")).cast("long").alias("taken"))
