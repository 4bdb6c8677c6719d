"""Names, sizes and times of a vault's files as a data source; contents are not read, links are passed over.

``spark.dataSource.register(VaultFiles)`` once, then
``spark.read.format("vault_files").load(root)``.  A partition is a run of
folders of notes; a filter on mtime_ms is applied where files are listed.
Roots may be paths or file:, hdfs: and s3: addresses that pyarrow opens.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, Filter, GreaterThan, GreaterThanOrEqual, InputPartition

from ..functions import text as T

SCHEMA = "folder string, name string, path string, size bigint, mtime_ms bigint"
#: Folders of a partition.
FOLDERS = 200


def opened(root: str) -> tuple[fs.FileSystem, str]:
    """(file system, path in it) of a root."""
    if root.startswith("file:"):
        return fs.LocalFileSystem(), urlparse(root).path
    return fs.FileSystem.from_uri(root) if "://" in root else (fs.LocalFileSystem(), os.path.abspath(root))


def _entries(system: fs.FileSystem, path: str) -> list[fs.FileInfo]:
    """What a folder holds, by name, without links."""
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    local = isinstance(system, fs.LocalFileSystem)
    return sorted((f for f in found if not (local and os.path.islink(f.path))), key=lambda f: f.base_name)


class Folders(InputPartition):
    def __init__(self, paths: list[str]) -> None:
        self.paths = paths


class VaultFilesReader(DataSourceReader):
    def __init__(self, root: str, depth: int, size: int) -> None:
        self.root, self.depth, self.size, self.least = root, depth, size, None

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Lower bounds of mtime_ms are taken; Spark applies the rest."""
        for f in filters:
            if isinstance(f, (GreaterThan, GreaterThanOrEqual)) and f.attribute == ("mtime_ms",):
                bound = f.value + (1 if isinstance(f, GreaterThan) else 0)
                self.least = bound if self.least is None else max(self.least, bound)
            else:
                yield f

    def partitions(self) -> list[InputPartition]:
        system, path = opened(self.root)
        level, found = [path], [path]
        for _ in range(self.depth):
            level = [e.path for folder in level for e in _entries(system, folder) if e.type == fs.FileType.Directory]
            found += level
        return [Folders(found[i : i + self.size]) for i in range(0, len(found), self.size)]

    def read(self, partition: Folders) -> Iterator[tuple]:
        system, _ = opened(self.root)
        for folder in partition.paths:
            for e in _entries(system, folder):
                at = int(e.mtime_ns // 1_000_000) if e.mtime_ns is not None else None
                if e.type == fs.FileType.File and (self.least is None or at is not None and at >= self.least):
                    yield os.path.basename(folder), e.base_name, e.path, e.size, at


class VaultFiles(DataSource):
    """Options: path, depth (levels of folders below it, 2) and folders (of a partition)."""

    @classmethod
    def name(cls) -> str:
        return "vault_files"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return VaultFilesReader(self.options["path"], int(self.options.get("depth", 2)), int(self.options.get("folders", FOLDERS)))


def list_files(spark: SparkSession, root: str, *, since_ms: int | None = None, depth: int = 2) -> DataFrame:
    """(folder, name, path, size, mtime_ms) of a vault's files, those changed at or after since_ms only."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(VaultFiles)
    files = spark.read.format("vault_files").option("depth", depth).load(root)
    return files if since_ms is None else files.where(F.col("mtime_ms") >= since_ms)


def note_files(files: DataFrame) -> DataFrame:
    """The notes among listed files."""
    return files.where(F.col("name") == "video.md")


def frame_files(files: DataFrame, *, least_digits: int = 1) -> DataFrame:
    """(folder, frame_ms, path) of the JPEGs, ending in any case, that are named by their milliseconds."""
    stem = F.regexp_extract("name", r"(?i)^([0-9]+)\.jpg$", 1)
    rows = files.where((F.length(stem) >= least_digits) & ~T.escapes_folder(F.col("folder")))
    return rows.select("folder", stem.try_cast("bigint").alias("frame_ms"), "path").where(F.col("frame_ms").isNotNull())


def bundle_files(files: DataFrame) -> DataFrame:
    """(folder, files) of each folder: the names in order."""
    return files.groupBy("folder").agg(F.array_sort(F.collect_list("name")).alias("files"))
