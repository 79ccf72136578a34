"""Directory trees as a Spark data source that knows what kind of thing an entry is.

`spark.read.format("walk")` lists the regular files below a folder that all executors see.
Links are never followed and never listed, be they to files or to folders; a folder
that is excluded is not opened. The driver opens folders from the top only until there
are enough of them to deal out; each task walks what lies below its own.
"""

from __future__ import annotations

import json
import os
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: Folders dealt out to a task, and how many tasks are wanted at least.
FOLDERS, TASKS = 16, 64
_BATCH_BYTES = 8 << 20


def excluded(folder: str, patterns: tuple) -> bool:
    """Whether a folder's path begins with a pattern without its slash."""
    return any(folder.startswith(p.rstrip("/")) for p in patterns)


def _opened(root: str, folder: str, patterns: tuple) -> tuple[list[str], list[tuple[str, int]]]:
    """(folders, regular files with their sizes) directly in a folder; what cannot be opened is empty."""
    folders, files = [], []
    try:
        with os.scandir(os.path.join(root, folder)) as entries:
            for e in entries:
                path = f"{folder}/{e.name}" if folder else e.name
                if e.is_dir(follow_symlinks=False):
                    if not excluded(path, patterns):
                        folders.append(path)
                elif e.is_file(follow_symlinks=False):
                    files.append((path, e.stat(follow_symlinks=False).st_size))
    except OSError:
        return [], []
    return sorted(folders), sorted(files)


class _Folders(InputPartition):
    """Folders to walk, or files that the driver has seen above them."""

    def __init__(self, folders: list, files: list):
        self.folders, self.files = folders, files


class WalkReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root, self.patterns = options["path"], tuple(json.loads(options.get("exclude", "[]")))

    def partitions(self) -> list[_Folders]:
        folders, files = [""], []
        while folders and len(folders) < TASKS:
            below: list[str] = []
            for f in folders:
                more, found = _opened(self.root, f, self.patterns)
                below += more
                files += found
            folders = below
        size = max(1, min(FOLDERS, len(folders) // TASKS))
        parts = [_Folders(folders[k : k + size], []) for k in range(0, len(folders), size)]
        return parts + [_Folders([], files[k : k + 50_000]) for k in range(0, len(files), 50_000)]

    def read(self, partition: _Folders) -> Iterator[tuple]:
        yield from partition.files
        todo = list(reversed(partition.folders))
        while todo:
            folders, files = _opened(self.root, todo.pop(), self.patterns)
            yield from files
            todo += reversed(folders)


class Walk(DataSource):
    """(path relative to the root, size). Options: `path`; `exclude`, a JSON list of folders' beginnings."""

    @classmethod
    def name(cls) -> str:
        return "walk"

    def schema(self) -> str:
        return "path string, size long"

    def reader(self, schema) -> WalkReader:
        return WalkReader(self.options)


def listed(spark: SparkSession, root: str, exclude: tuple = ()) -> DataFrame:
    """(path, size) of the regular files below a folder."""
    spark.dataSource.register(Walk)
    return spark.read.format("walk").option("path", root).option("exclude", json.dumps(list(exclude))).load()


def _contents(root: str):
    schema = pa.schema([("path", pa.string()), ("content", pa.binary()), ("size", pa.int64())])

    def read(path: str) -> bytes | None:
        try:  # what has become a link meanwhile is not followed either
            with open(os.open(os.path.join(root, path), os.O_RDONLY | os.O_NOFOLLOW), "rb") as f:
                return f.read()
        except OSError:
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            held = 0
            for path, size in zip(batch.column("path").to_pylist(), batch.column("size").to_pylist()):
                rows.append((path, read(path), size))
                held += size
                if held > _BATCH_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)
                    rows, held = [], 0
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), schema)], schema=schema)

    return run


def with_contents(files: DataFrame, root: str) -> DataFrame:
    """(path, content, size) of listed files, null where one cannot be read; paths are dealt out evenly first."""
    n = max(2 * files.sparkSession.sparkContext.defaultParallelism, 8)
    return files.select("path", "size").repartition(n, F.col("path")).mapInArrow(_contents(root), "path string, content binary, size long")
