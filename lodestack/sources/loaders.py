"""Documents from files: dispatch by extension, a folder at a time, errors kept beside the rows."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# The kinds of files and the largest that is read.
KINDS, LARGEST = ("pdf", "docx", "md", "markdown", "txt"), 50 << 20
SCHEMA = "path string, kind string, text string, pages array<struct<page:int,start:long,end:long>>, error string"
Extractor = Callable[[bytes], list[str]]


def document_id(user: Column, path: Column) -> Column:
    """16 hex digits of the SHA-1 of user and path."""
    return F.substring(F.sha1(F.concat(user, path)), 1, 16)


def plain_text(data: bytes) -> str:
    return data.decode("utf-8", "replace")


def docx_text(data: bytes) -> str:
    """The paragraphs of a word processor's file, one a line."""
    space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    return "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in root.iter(f"{space}p"))


def joined(pages: list[str]) -> tuple[str, list[tuple[int, int, int]]]:
    """Pages joined by a blank line, without page-number lines and blank pages, and each kept page's span."""
    number = re.compile(r"(?:Page\s*)?\d+(?:\s*of\s*\d+)?\s*", re.I)
    out, spans, at = [], [], 0
    for i, page in enumerate(pages, 1):
        text = "\n".join(x for x in page.split("\n") if not number.fullmatch(x.strip()))
        if text.strip():
            out.append(text)
            spans.append((i, at, at + len(text)))
            at += len(text) + 2
    return "\n\n".join(out), spans


def load_document(path: str, data: bytes, pdf: Extractor | None = None) -> tuple[str, list[tuple[int, int, int]]]:
    """Text and page spans of one file; ValueError for another kind, or a PDF without an extractor of its pages."""
    kind = path.rsplit(".", 1)[-1].lower() if "." in path else ""
    if kind not in KINDS:
        raise ValueError(f"no loader for .{kind}")
    if kind == "pdf":
        if pdf is None:
            raise ValueError("a PDF needs an extractor of its pages")
        return joined(pdf(data))
    return (docx_text(data) if kind == "docx" else plain_text(data)), []


def load_folder(spark: SparkSession, folder: str, user: str = "default", pdf: Extractor | None = None, largest: int = LARGEST) -> DataFrame:
    """(doc_id, user_id, title, source_type, path, kind, text, pages, error) of all files of the kinds below the folder.

    Files above `largest` bytes are left out before they are read; a file that fails has its error and a null text.
    """
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(folder).filter((F.col("length") <= largest) & kind.isin(*KINDS))

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf_ in batches:
            rows = []
            for path, data in zip(pdf_["path"], pdf_["content"]):
                try:
                    text, pages = load_document(path, bytes(data), pdf)
                    rows.append((text, pages, None))
                except Exception as e:  # one bad file does not stop a folder
                    rows.append((None, [], f"{type(e).__name__}: {e}"))
            yield pd.DataFrame({"path": pdf_["path"], "kind": pdf_["path"].str.rsplit(".", n=1).str[-1].str.lower(), "text": [r[0] for r in rows],
                                "pages": pd.Series([[{"page": p, "start": a, "end": b} for p, a, b in r[1]] for r in rows], dtype="object"), "error": [r[2] for r in rows]})

    rows = files.select("path", "content").mapInPandas(read, SCHEMA)
    title = F.regexp_extract("path", r"([^/]+?)(?:\.[^./]+)?$", 1)
    return rows.select(document_id(F.lit(user), F.col("path")).alias("doc_id"), F.lit(user).alias("user_id"), title.alias("title"), F.lit("document").alias("source_type"), *rows.columns)
