"""Text to chunks: sections, references cut, pages, paragraph packing, prefixes, memory import."""

from __future__ import annotations

import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import portions

CHUNK = "chunk_id string, doc_id string, user_id string, title string, text string, embedding_text string, section string, subsection string, chunk_index int, token_count int, source_type string, has_math boolean, excluded boolean"


def line_chunks(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode(T.lines(F.col("text"))).alias("chunk_index", "text"))


def document_lines(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, start, line): lines with the offset of their first character."""
    rows = docs.select("doc_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("line_no", "line"))
    before = Window.partitionBy("doc_id").orderBy("line_no").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("start", F.coalesce(F.sum(F.length("line") + 1).over(before), F.lit(0)).cast("long"))


def headings(docs: DataFrame) -> DataFrame:
    """(doc_id, line_no, level, title) of every heading line; no shuffle."""
    rows = docs.select("doc_id", F.posexplode(T.lines(F.coalesce("text", F.lit("")))).alias("line_no", "line"))
    return rows.withColumn("h", T.heading(F.col("line"))).filter("h is not null").select("doc_id", "line_no", "h.level", "h.title")


def section_spans(docs: DataFrame) -> DataFrame:
    """(doc_id, start, end, section, subsection): spans that tile [0, length); a new section resets the subsection.

    Text before the first heading has no section; a document without headings is one span; empty documents have none.
    """
    size = F.length(F.coalesce("text", F.lit("")))
    marks = document_lines(docs).withColumn("h", T.heading(F.col("line"))).filter((F.col("h").isNotNull()) | (F.col("line_no") == 0))
    by = Window.partitionBy("doc_id").orderBy("line_no")
    up = by.rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("group", F.count(F.when(F.col("h.level") == 1, 1)).over(up)).withColumn("section", F.last(F.when(F.col("h.level") == 1, F.col("h.title")), True).over(up))
    inner = Window.partitionBy("doc_id", "group").orderBy("line_no").rowsBetween(Window.unboundedPreceding, 0)
    marks = marks.withColumn("subsection", F.last(F.when(F.col("h.level") == 2, F.col("h.title")), True).over(inner))
    marks = marks.withColumn("end", F.lead("start").over(by)).join(docs.select("doc_id", size.cast("long").alias("n")).filter("n > 0"), "doc_id")
    return marks.select("doc_id", "start", F.coalesce("end", "n").alias("end"), "section", "subsection")


def references_offset(docs: DataFrame, least: int = 5, gap: int = 2) -> DataFrame:
    """(doc_id, cut): offset where the references start, null where there are none.

    The earliest heading line of references; else the first of `least` citation lines with at most `gap` other
    non-blank lines between one and the next.
    """
    rows = document_lines(docs).withColumn("s", T.strip(F.col("line")))
    named = rows.filter(T.opens_references(F.col("line"))).groupBy("doc_id").agg(F.min("start").alias("named"))
    by = Window.partitionBy("doc_id").orderBy("line_no")
    cites = rows.filter("s <> ''").withColumn("i", F.row_number().over(by)).filter(T.is_citation(F.col("s")))
    cites = cites.withColumn("new", F.coalesce(F.col("i") - F.lag("i").over(by) - 1 > gap, F.lit(True)))
    cites = cites.withColumn("run", F.count(F.when(F.col("new"), 1)).over(by))
    runs = cites.groupBy("doc_id", "run").agg(F.count("*").alias("n"), F.min("start").alias("start")).filter(F.col("n") >= least)
    runs = runs.groupBy("doc_id").agg(F.min("start").alias("run_start"))
    return docs.select("doc_id").join(named, "doc_id", "left").join(runs, "doc_id", "left").select("doc_id", F.coalesce("named", "run_start").alias("cut"))


def page_of(offsets: DataFrame, pages: DataFrame) -> DataFrame:
    """offsets (doc_id, offset) with page, from pages (doc_id, start, end, page).

    An as-of join: the last span that starts at or before the offset, so a gap belongs to the page before it and what lies past the
    end to the last; an offset before the first span has the first page; without spans it is null.
    """
    cuts = pages.select("doc_id", F.col("start").alias("offset"), "page", F.lit(0).alias("kind"))
    asked = offsets.select("*", F.lit(1).alias("kind"))
    both = asked.unionByName(cuts, allowMissingColumns=True)
    by = Window.partitionBy("doc_id").orderBy("offset", "kind")
    seen = F.last(F.when(F.col("kind") == 0, F.col("page")), True).over(by.rowsBetween(Window.unboundedPreceding, 0))
    first = F.first(F.when(F.col("kind") == 0, F.col("page")), True).over(by.rowsBetween(0, Window.unboundedFollowing))
    return both.withColumn("__page", F.coalesce(seen, first)).filter("kind = 1").drop("kind", "page").withColumnRenamed("__page", "page")


def page_spans(pages: DataFrame) -> DataFrame:
    """(doc_id, page, start, end) of pages (doc_id, page, text) joined by a blank line; blank pages are skipped."""
    by = Window.partitionBy("doc_id").orderBy("page").rowsBetween(Window.unboundedPreceding, -1)
    kept = pages.filter(T.strip(F.coalesce("text", F.lit(""))) != "").withColumn("n", F.length("text"))
    start = F.coalesce(F.sum(F.col("n") + 2).over(by), F.lit(0)).cast("long")
    return kept.withColumn("start", start).select("doc_id", "page", "start", (F.col("start") + F.col("n")).alias("end"))


def chapter_fill(chunks: DataFrame) -> DataFrame:
    """chunks with chapter: the last clean section label up to the chunk."""
    by = Window.partitionBy("doc_id").orderBy("chunk_index").rowsBetween(Window.unboundedPreceding, 0)
    label = T.heading_label(F.col("section"))
    return chunks.withColumn("chapter", F.last(F.when(label != "", label), True).over(by))


_MATH = re.compile(r"\$\$.*?\$\$|\\begin\{(equation|align|eqnarray|gather)(\*?)\}.*?\\end\{\1\2\}", re.S)


def paragraphs(text: str) -> list[str]:
    """Trimmed parts between blank lines, but for blank lines inside display mathematics."""
    inside = [m.span() for m in _MATH.finditer(text)]
    at, out = 0, []
    for m in re.finditer(r"\n{2,}", text):
        if not any(a < m.start() < b for a, b in inside):
            out.append(text[at:m.start()])
            at = m.end()
    return [p for p in map(str.strip, [*out, text[at:]]) if p]


def _tokens(text: str) -> int:
    return max(1, len(text) // 4)


class _Packer:
    """Units gathered up to a budget; finished chunks in `done`."""

    def __init__(self, budget: int, overlap: int):
        self.budget, self.overlap, self.done, self.held, self.size = budget, overlap, [], [], 0

    def close(self) -> list[str]:
        held, self.held, self.size = self.held, [], 0
        if held:
            self.done.append("\n\n".join(held))
        return held

    def add(self, unit: str, carry: bool) -> None:
        n = _tokens(unit)
        if self.held and self.size + n > self.budget:
            left = self.close()
            while carry and left and self.size + _tokens(left[-1]) <= self.overlap:
                self.size += _tokens(left[-1])
                self.held.insert(0, left.pop())
        self.held.append(unit)
        self.size += n


def pack(parts: list[str], max_tokens: int = 400, overlap_tokens: int = 60) -> list[str]:
    """Paragraphs packed greedily; a chunk repeats the last paragraphs of the one before up to the overlap.

    A paragraph above the budget is packed by its lines without overlap, or kept whole if it holds display mathematics.
    """
    p = _Packer(max_tokens, overlap_tokens)
    for part in parts:
        if _tokens(part) <= max_tokens:
            p.add(part, carry=True)
            continue
        p.close()
        if _MATH.search(part):
            p.done.append(part)
        else:
            for line in filter(None, map(str.strip, part.splitlines())):
                p.add(line, carry=False)
    p.close()
    return p.done


def chunk_documents(docs: DataFrame, max_tokens: int = 400, overlap_tokens: int = 60, cut_references: bool = False) -> DataFrame:
    """Chunks (see CHUNK) of docs (doc_id, text, and user_id, title, source_type where there are).

    Each document's section spans are packed for themselves; a text that yields nothing is one chunk; empty ones have none.
    A chunk's embedding text carries [title] [section] [subsection] in front. Rows of one document meet, no others.
    """
    have = set(docs.columns)
    base = docs.filter(T.strip(F.coalesce("text", F.lit(""))) != "")
    if cut_references:
        base = base.join(references_offset(base.select("doc_id", "text")), "doc_id").withColumn("text", F.when(F.col("cut") > 0, F.expr("substring(text, 1, cut)")).otherwise(F.col("text"))).drop("cut")
    spans = section_spans(base.select("doc_id", "text")).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "section", "subsection"))).alias("spans"))

    def given(name: str, default: str) -> Column:
        return F.coalesce(F.col(name).cast("string"), F.lit(default)) if name in have else F.lit(default)

    rows = base.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text"), given("user_id", "default").alias("user_id"), given("title", "").alias("title"), given("source_type", "document").alias("source_type"))
    rows = rows.join(spans.withColumn("doc_id", F.col("doc_id").cast("string")), "doc_id")

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in (part for pdf in batches for part in portions(pdf)):
            out = []
            for doc, text, user, title, kind, found in part[["doc_id", "text", "user_id", "title", "source_type", "spans"]].itertuples(index=False):
                made = [(s["section"], s["subsection"], c) for s in found for c in pack(paragraphs(text[s["start"]:s["end"]]), max_tokens, overlap_tokens)] or [(None, None, text.strip())]
                for i, (section, sub, c) in enumerate(made):
                    head = " ".join(f"[{x}]" for x in (title, section, sub) if x)
                    out.append((f"{doc}:{i:04d}", doc, user, title, c, f"{head}\n\n{c}" if head else c, section, sub, i, _tokens(c), kind))
            yield pd.DataFrame(out, columns=["chunk_id", "doc_id", "user_id", "title", "text", "embedding_text", "section", "subsection", "chunk_index", "token_count", "source_type"])

    plain = CHUNK.split(", has_math")[0]
    return rows.mapInPandas(cut, plain).withColumn("has_math", T.has_math(F.col("text"))).withColumn("excluded", F.lit(False))


def memory_texts(files: DataFrame) -> DataFrame:
    """(path, n, text) memories of files (path, text): Markdown is cut at headings, other text is one a non-empty line."""
    cut = F.when(F.lower("path").rlike(r"\.(md|markdown)$"), F.split("text", r"(?m)^#{1,6}\s+")).otherwise(F.split("text", "\n"))
    parts = F.filter(F.transform(cut, T.strip), lambda x: x != "")
    return files.select("path", F.posexplode(parts).alias("n", "text"))
