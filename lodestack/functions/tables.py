"""Table functions for SQL text: chunks of a text, sections of a document's lines, a level of a descent, after register(spark).

    SELECT d.doc_id, c.* FROM documents d, LATERAL text_chunks(d.text, 400, 60) c
    SELECT * FROM document_sections(TABLE(SELECT doc_id, line_no, line FROM lines))
    SELECT * FROM beam_level(TABLE(scored), 3, 0.05, 0.3, 0.1)
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import Any

from pyspark.sql import Row, SparkSession
from pyspark.sql.functions import AnalyzeArgument, AnalyzeResult, OrderingColumn, PartitioningColumn, udtf
from pyspark.sql.types import StructType

from ..operators.chunking import _tokens, pack, paragraphs
from . import text as T

_KINDS = [re.compile(p, re.ASCII) for p in (T.MARKDOWN, T.NUMBERED, T.CAPITALS)]


def heading_of(line: str) -> tuple[int, str] | None:
    """(level, title) of a heading line, as text.heading."""
    s = line.strip()
    for kind, pattern in zip(("marked", "numbered", "capitals"), _KINDS):
        m = pattern.search(s)
        if m and kind == "capitals":
            return (1, s) if len(s) < 80 else None
        if m:
            first = len(m[1]) == 1 if kind == "marked" else "." not in m[1]
            return 1 if first else 2, m[2].strip()
    return None


def _columns(table: AnalyzeArgument, *names: str) -> StructType:
    """The schema of a table argument that must have these columns."""
    if not table.isTable:
        raise ValueError("a TABLE argument is needed")
    have = {f.name for f in table.dataType.fields}
    if missing := set(names) - have:
        raise ValueError(f"missing columns: {', '.join(sorted(missing))}")
    return table.dataType


@udtf
class TextChunks:
    """(chunk_index, text, token_count) of a text, packed as chunking.pack."""

    @staticmethod
    def analyze(text: AnalyzeArgument, max_tokens: AnalyzeArgument = None, overlap: AnalyzeArgument = None) -> AnalyzeResult:
        for a in (max_tokens, overlap):
            if a is not None and (not a.isConstantExpression or a.value is None or a.value < 0):
                raise ValueError("max_tokens and overlap are constants of at least 0")
        return AnalyzeResult(schema=StructType().add("chunk_index", "integer").add("text", "string").add("token_count", "integer"))

    def eval(self, text: str, max_tokens: int = 400, overlap: int = 60) -> Iterator[tuple]:
        if text and text.strip():
            for i, c in enumerate(pack(paragraphs(text), max_tokens, overlap) or [text.strip()]):
                yield i, c, _tokens(c)


@udtf
class DocumentSections:
    """(doc_id, start, end, section, subsection) of the lines (doc_id, line_no, line) of documents, as chunking.section_spans.

    Spark brings a document's lines together in order, whatever the caller wrote; only the open span is held.
    """

    @staticmethod
    def analyze(lines: AnalyzeArgument) -> AnalyzeResult:
        kind = _columns(lines, "doc_id", "line_no", "line")["doc_id"].dataType
        return AnalyzeResult(schema=StructType().add("doc_id", kind).add("start", "long").add("end", "long").add("section", "string").add("subsection", "string"),
                             partitionBy=[PartitioningColumn("doc_id")], orderBy=[OrderingColumn("line_no")])

    def __init__(self) -> None:
        self.at, self.open = 0, None

    def eval(self, lines: Row) -> Iterator[tuple]:
        line, found = lines["line"] or "", heading_of(lines["line"] or "")
        if self.open is None:
            self.open = (lines["doc_id"], 0, None, None)
        if found:
            doc, start, section, sub = self.open
            if self.at > start:
                yield doc, start, self.at, section, sub
            self.open = (doc, self.at, found[1], None) if found[0] == 1 else (doc, self.at, section, found[1])
        self.at += len(line) + 1

    def terminate(self) -> Iterator[tuple]:
        if self.open is not None and self.at - 1 > self.open[1]:
            doc, start, section, sub = self.open
            yield doc, start, self.at - 1, section, sub


@udtf
class BeamLevel:
    """A level's considered nodes (query_id, node_id, label, score) with kept: the rule of taxonomy.beam_descend for one level.

    Rows of a query come best first, ties by label and node; the last score and the count are all that is held, as the best row comes first.
    """

    @staticmethod
    def analyze(scored: AnalyzeArgument, beam: AnalyzeArgument, least: AnalyzeArgument, floor: AnalyzeArgument, gap: AnalyzeArgument) -> AnalyzeResult:
        kinds = _columns(scored, "query_id", "node_id", "label", "score")
        return AnalyzeResult(schema=StructType().add("query_id", kinds["query_id"].dataType).add("node_id", kinds["node_id"].dataType).add("score", "double").add("kept", "boolean"),
                             partitionBy=[PartitioningColumn("query_id")], orderBy=[OrderingColumn("score", ascending=False), OrderingColumn("label"), OrderingColumn("node_id")])

    def __init__(self) -> None:
        self.n, self.last, self.low, self.cut = 0, None, False, False

    def eval(self, scored: Row, beam: int, least: Any, floor: Any, gap: Any) -> Iterator[tuple]:
        s, least, floor, gap = float(scored["score"]), float(least), float(floor), float(gap)
        self.n += 1
        self.low = self.low or (self.n == 1 and s < floor)
        self.cut = self.cut or s < least or (gap > 0 and self.last is not None and self.last - s >= gap)
        self.last = s
        yield scored["query_id"], scored["node_id"], s, self.n == 1 or (not self.low and self.n <= int(beam) and not self.cut)


def register(spark: SparkSession) -> list[str]:
    """Make the table functions known to the session; their names."""
    found = {"text_chunks": TextChunks, "document_sections": DocumentSections, "beam_level": BeamLevel}
    for name, f in found.items():
        spark.udtf.register(name, f)
    return list(found)
