"""Folders of files as a Python data source, in batch and as a stream, and extraction as a table function.

    spark.dataSource.register(FolderSource)
    spark.read.format("corpus_folder").load("/data/reports")
    spark.readStream.format("corpus_folder").option("pattern", "*.md").load("hdfs://store/reports")

Each folder right under the root is a partition, listed by a task of its own; contents aren't read. The stream gives the files whose time of change lies
between two offsets, so a changed file comes again. Paths are those that pyarrow's file systems know, and must be reachable from every executor.
"""

from __future__ import annotations

import os
import time
from collections.abc import Iterator
from dataclasses import dataclass
from datetime import UTC, datetime
from fnmatch import fnmatch

from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "path string, relative_path string, filename string, extension string, size_bytes long, modified_at timestamp"


@dataclass
class Folder(InputPartition):
    """Files of a folder: all below it, or its own only; changed after `after` and not after `until` (nanoseconds)."""

    path: str
    deep: bool
    after: int = -1
    until: int = 1 << 62


def _listed(path: str, deep: bool):
    """(file system, entries) of a folder, which may be gone."""
    from pyarrow import fs

    system, inner = fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))
    return system, system.get_file_info(fs.FileSelector(inner, allow_not_found=True, recursive=deep))


class _Listing:
    def __init__(self, options: dict[str, str]):
        self.root = options["path"].rstrip("/")
        self.pattern = options.get("pattern", "*")
        self.deep = options.get("recursive", "true").lower() == "true"

    def folders(self) -> list[Folder]:
        from pyarrow import fs

        below = [e for e in _listed(self.root, False)[1] if e.type == fs.FileType.Directory] if self.deep else []
        return [Folder(self.root, False), *(Folder(f"{self.root}/{e.base_name}", True) for e in sorted(below, key=lambda e: e.path))]

    def files(self, part: Folder) -> Iterator[tuple]:
        from pyarrow import fs

        own = part.path[len(self.root) :].strip("/")
        _, entries = _listed(part.path, part.deep)
        base = _inner(part.path)
        for e in entries:
            if e.type == fs.FileType.File and fnmatch(e.base_name, self.pattern) and part.after < e.mtime_ns <= part.until:
                relative = "/".join(x for x in (own, e.path[len(base) :].strip("/")) if x)
                dot = e.base_name.rfind(".")
                when = datetime.fromtimestamp(e.mtime_ns // 1000 / 1e6, UTC)
                yield f"{self.root}/{relative}", relative, e.base_name, e.base_name[dot:].lower() if dot > 0 else "", e.size, when


def _inner(path: str) -> str:
    from pyarrow import fs

    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else os.path.abspath(path))[1].rstrip("/")


class FolderReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.listing = _Listing(options)

    def partitions(self) -> list[Folder]:
        return self.listing.folders()

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.listing.files(partition)


class FolderStream(DataSourceStreamReader):
    """Offsets are times of change in nanoseconds. What changed in the last `settle` seconds waits, as more of it may come with the same time."""

    def __init__(self, options: dict[str, str]):
        self.listing = _Listing(options)
        self.settle = float(options.get("settle", "2"))

    def initialOffset(self) -> dict:
        return {"until": -1}

    def latestOffset(self) -> dict:
        return {"until": time.time_ns() - int(self.settle * 1e9)}

    def partitions(self, start: dict, end: dict) -> list[Folder]:
        return [Folder(f.path, f.deep, start["until"], end["until"]) for f in self.listing.folders()]

    def read(self, partition: Folder) -> Iterator[tuple]:
        return self.listing.files(partition)


class FolderSource(DataSource):
    """Options: path, pattern (of names), recursive (true), settle (seconds, streams)."""

    @classmethod
    def name(cls) -> str:
        return "corpus_folder"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options)

    def streamReader(self, schema) -> FolderStream:
        return FolderStream(self.options)


@F.udtf(returnType="elem_idx int, type string, level int, text string")
class ExtractElements:
    """extract_elements(branch, text): the elements of a text by the branch's parser (see extract.register_extractor); none for a branch without one or a null text."""

    def eval(self, branch: str, text: str):
        from corpusloom.sources.extract import EXTRACTORS

        if text and branch in EXTRACTORS:
            for i, (kind, level, element) in enumerate(EXTRACTORS[branch](text)):
                yield i, kind, level, element


def register(spark: SparkSession) -> None:
    """The data source corpus_folder and the table function extract_elements, for SQL too: SELECT f.path, e.* FROM f, LATERAL extract_elements(f.branch, f.text) e."""
    spark.dataSource.register(FolderSource)
    spark.udtf.register("extract_elements", ExtractElements)
