"""Chunk quality: the chain of drop reasons, exact dedupe within a document, where-filters and base scoping."""

from __future__ import annotations

from functools import reduce
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as T


def quality_reason(chunks: DataFrame, min_tokens: int = 30, min_chars: int = 80, min_alpha: float = 0.4, text_col: str = "text") -> DataFrame:
    """chunks with reason (null: kept), the first check that fails in this order: too_short, low_alpha_ratio,
    references_section, bibliography_chunk, single_citation, page_artifact, url_soup, leading_page_artifact.

    Chunks with mathematics pass the first two. A null text is empty. The columns section, token_count and has_math are used where
    there are; without them the section is empty, tokens are counted and mathematics is looked for.
    """
    have = set(chunks.columns)
    raw = F.coalesce(F.col(text_col), F.lit(""))
    section = F.lower(T.strip(F.coalesce(F.col("section"), F.lit("")))) if "section" in have else F.lit("")

    def short(t: Column, n: Column) -> Column:
        return (n < min_tokens) & (F.length(t) < min_chars)

    def by_lines(s: Column, rows: Column) -> Column:
        """The checks of the lines, once the cheap ones pass; what a later one needs is evaluated only there."""
        dated = F.size(F.filter(rows, lambda x: x.rlike(T.YEAR)))
        words = F.filter(F.split(s, f"[{T.WS}]+"), lambda w: w != "")
        soup = T.bind(words, lambda w: (F.size(w) >= 3) & (F.size(F.filter(w, lambda x: x.rlike(T.URL_WORD))) * 10 >= F.size(w) * 8))
        rest = T.strip(F.array_join(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), "\n"))
        return (F.when((F.size(rows) >= 3) & (dated >= 3) & (dated * 2 >= F.size(rows)), "bibliography_chunk")
                .when(s.rlike(T.OPENER) & s.rlike(T.YEAR) & (s.rlike(T.DOI) | s.rlike(T.ARXIV) | s.rlike(T.URL)), "single_citation")
                .when(s.rlike(T.PAGE), "page_artifact")
                .when(soup, "url_soup")
                .when((F.size(rows) >= 2) & T.strip(F.get(rows, F.lit(0))).rlike(T.PAGE) & T.bind(rest, lambda r: short(r, T.token_count(r))), "leading_page_artifact"))

    def reason(s: Column) -> Column:
        math = F.coalesce(F.col("has_math"), F.lit(False)) if "has_math" in have else T.has_math(raw)
        tokens = F.when(F.col("token_count") > 0, F.col("token_count")).otherwise(T.token_count(s)) if "token_count" in have else T.token_count(s)
        return (F.when(short(s, tokens) & ~math, "too_short")
                .when((s != "") & (T.alpha_ratio(s) < min_alpha) & ~math, "low_alpha_ratio")
                .when(reduce(lambda a, b: a | b, [F.contains(section, F.lit(n)) for n in T.REFERENCE_NAMES]), "references_section")
                .otherwise(T.bind(T.text_lines(s), lambda rows: by_lines(s, rows))))

    return chunks.withColumn("reason", T.bind(T.strip(raw), reason))


def drop_breakdown(chunks: DataFrame) -> DataFrame:
    """(reason, n) of the chunks that quality_reason drops."""
    return quality_reason(chunks).filter("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def dedupe_chunks(chunks: DataFrame, doc_col: str = "doc_id", order_col: str = "chunk_index", text_col: str = "text") -> DataFrame:
    """The first chunk (with its own text) of each trimmed text within its document: a mergeable minimum, so no sort."""
    rest = [c for c in chunks.columns if c not in (doc_col, order_col)]
    key = F.struct(F.col(order_col), *[F.col(c) for c in rest])
    return chunks.groupBy(doc_col, F.xxhash64(T.strip(text_col)).alias("__h"), T.strip(text_col).alias("__t")).agg(F.min(key).alias("__r")).select(doc_col, f"__r.{order_col}", *[f"__r.{c}" for c in rest])


def where(filter_: dict[str, Any] | None, columns: list[str]) -> Column:
    """A metadata filter as an expression: bare equality, $eq, $ne, $in, $and, $or.

    Keys that are no columns are ignored; an empty $in is false; an empty filter is true.
    """
    def one(key: str, value: Any) -> Column | None:
        if key in ("$and", "$or"):
            parts = [p for p in (whole(v) for v in value) if p is not None]
            if not parts:
                return None
            return reduce((lambda a, b: a & b) if key == "$and" else (lambda a, b: a | b), parts)
        if key not in columns:
            return None
        if not isinstance(value, dict):
            return F.col(key) == F.lit(value)
        made = [F.col(key) == F.lit(v) if op == "$eq" else ~F.col(key).eqNullSafe(F.lit(v)) if op == "$ne" else (F.col(key).isin(*v) if v else F.lit(False))
                for op, v in value.items() if op in ("$eq", "$ne", "$in")]
        return reduce(lambda a, b: a & b, made) if made else None

    def whole(f: dict[str, Any]) -> Column | None:
        parts = [p for p in (one(k, v) for k, v in f.items()) if p is not None]
        return reduce(lambda a, b: a & b, parts) if parts else None

    made = whole(filter_ or {})
    return F.lit(True) if made is None else F.coalesce(made, F.lit(False))


def scope(chunks: DataFrame, user: str | None = None, source_types: list[str] | None = None, doc_ids: list | None = None, filter_: dict | None = None) -> DataFrame:
    """Live chunks of a user, narrowed before any ranking: what Parquet can skip is pushed to the scan."""
    out = chunks.filter(~F.coalesce(F.col("excluded"), F.lit(False))) if "excluded" in chunks.columns else chunks
    if user is not None:
        out = out.filter(F.col("user_id") == user)
    if source_types is not None:
        out = out.filter(F.col("source_type").isin(*source_types) if source_types else F.lit(False))
    if doc_ids is not None:
        out = out.filter(F.col("doc_id").isin(*doc_ids) if doc_ids else F.lit(False))
    return out.filter(where(filter_, out.columns)) if filter_ else out
