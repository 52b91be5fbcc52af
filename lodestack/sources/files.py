"""Document files as a data source of Spark: spark.read.format("document_files") and readStream, after register(spark).

Options: path (any URI of pyarrow's file systems), user, largest (bytes; larger files are never opened), bytes (of files in one partition), settle
(seconds; a stream leaves files younger than this for a later batch, so that none of equal time is passed over). Files of other kinds are
left out; a file that fails is a row with its error and a null text. A stream goes by time of change, then path: a file that
changes comes again.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from .loaders import KINDS, LARGEST, load_document

SCHEMA = "doc_id string, user_id string, title string, source_type string, path string, kind string, text string, error string, length long"


@dataclass
class Files(InputPartition):
    """Paths with their sizes, together of about one partition's bytes."""

    files: list[tuple[str, int]]


class _Folder:
    def __init__(self, options: dict[str, str]):
        self.path, self.user = options["path"], options.get("user", "default")
        self.largest, self.bytes, self.settle = int(options.get("largest", LARGEST)), int(options.get("bytes", 32 << 20)), float(options.get("settle", 2))

    def fs(self):
        from pyarrow.fs import FileSystem

        return FileSystem.from_uri(self.path if "://" in self.path or not self.path.startswith("file:") else self.path.replace("file:", "file://", 1))

    def listed(self) -> list[tuple[int, str, int]]:
        """(time of change in ns, path, size) of the files to read, in this order."""
        from pyarrow.fs import FileSelector, FileType

        fs, root = self.fs()
        found = fs.get_file_info(FileSelector(root, recursive=True, allow_not_found=True))
        return sorted((f.mtime_ns or 0, f.path, f.size) for f in found if f.type == FileType.File and f.extension.lower() in KINDS and f.size <= self.largest)

    def dealt(self, files: list[tuple[int, str, int]]) -> list[Files]:
        out, size = [], 0
        for _, path, n in files:
            if not out or size + n > self.bytes:
                out.append(Files([]))
                size = 0
            out[-1].files.append((path, n))
            size += n
        return out

    def read(self, partition: Files) -> Iterator[tuple]:
        fs, _ = self.fs()
        for path, n in partition.files:
            name, kind = path.rsplit("/", 1)[-1], path.rsplit(".", 1)[-1].lower()
            key = hashlib.sha1(f"{self.user}{path}".encode()).hexdigest()[:16]
            text = error = None
            try:
                with fs.open_input_stream(path) as f:
                    text = load_document(path, f.read())[0]
            except Exception as e:  # one bad file does not stop a folder
                error = f"{type(e).__name__}: {e}"
            yield key, self.user, name.rsplit(".", 1)[0], "document", path, kind, text, error, n


class FileReader(_Folder, DataSourceReader):
    def partitions(self) -> list[Files]:
        return self.dealt(self.listed()) or [Files([])]


class FileStream(_Folder, DataSourceStreamReader):
    """Offsets are (time, path) of the last file of a batch."""

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        ready = [f for f in self.listed() if f[0] <= (time.time() - self.settle) * 1e9]
        return {"time": ready[-1][0], "path": ready[-1][1]} if ready else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        low, high = (start["time"], start["path"]), (end["time"], end["path"])
        return self.dealt([f for f in self.listed() if low < f[:2] <= high])

    def commit(self, end: dict) -> None:
        pass


class DocumentFiles(DataSource):
    @classmethod
    def name(cls) -> str:
        return "document_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FileReader:
        return FileReader(self.options)

    def streamReader(self, schema) -> FileStream:
        return FileStream(self.options)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(DocumentFiles)
