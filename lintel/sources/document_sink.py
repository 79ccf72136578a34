"""One text document written by the executors.

`df.write.format("joined_document")` takes sorted rows (section, value). Each task writes
the values of its partition, a file for each section it meets; the commit joins these
files in the order of the partitions, between fixed texts, and moves the result to its
place. The driver copies bytes in pieces and never holds a row; a task that runs twice
leaves a file that nobody joins. A write that fails leaves what was there before, and
at most a folder with a leading underscore, where tasks were still writing.
"""

from __future__ import annotations

import json
import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from lintel.sources.git_store import store_of

_PIECE = 4 << 20


@dataclass
class _Written(WriterCommitMessage):
    """(section, partition, file) of what a task wrote."""

    parts: list


class DocumentWriter(DataSourceWriter):
    def __init__(self, options: dict):
        self.path, self.between = options["path"], options.get("between", ",\n")
        self.texts = json.loads(options["texts"])
        self.folder = posixpath.join(posixpath.dirname(self.path), f"_{posixpath.basename(self.path)}-{uuid.uuid4().hex}")

    def write(self, iterator: Iterator) -> _Written:
        store, folder = store_of(self.folder)
        task = TaskContext.get()
        k, attempt = task.partitionId(), task.taskAttemptId()
        store.create_dir(folder, recursive=True)
        parts, out, now, first = [], None, None, True
        try:
            for section, value in iterator:
                if section != now:
                    if out:
                        out.close()
                    now, first = section, True
                    name = f"{folder}/{section}-{k}-{attempt}"
                    out = store.open_output_stream(name)
                    parts.append((section, k, name))
                out.write(("" if first else self.between).encode() + value.encode())
                first = False
        finally:
            if out:
                out.close()
        return _Written(parts)

    def commit(self, messages: list) -> None:
        store, path = store_of(self.path)
        _, folder = store_of(self.folder)
        parts = sorted(p for m in messages if m for p in m.parts)
        store.create_dir(folder, recursive=True)
        with store.open_output_stream(f"{folder}/whole") as out:
            for section, text in enumerate(self.texts):
                out.write(text.encode())
                for k, (_, _, name) in enumerate(p for p in parts if p[0] == section):
                    if k:
                        out.write(self.between.encode())
                    with store.open_input_stream(name) as part:
                        while piece := part.read(_PIECE):
                            out.write(piece)
        store.move(f"{folder}/whole", path)
        store.delete_dir(folder)

    def abort(self, messages: list) -> None:
        store, folder = store_of(self.folder)
        store.create_dir(folder, recursive=True)
        store.delete_dir(folder)


class JoinedDocument(DataSource):
    """Options: `path`; `texts`, a JSON list of what stands in front of each section and behind the last; `between` two values."""

    @classmethod
    def name(cls) -> str:
        return "joined_document"

    def writer(self, schema, overwrite: bool) -> DocumentWriter:
        return DocumentWriter(self.options)


def write_document(rows: DataFrame, path: str, texts: list[str], order: list, between: str = ",\n") -> None:
    """Writes the `value`s of rows (section, value and what `order` names) between texts, one more than there are sections."""
    spark = rows.sparkSession
    spark.dataSource.register(JoinedDocument)
    ranged = rows.orderBy("section", *order).select(F.col("section").cast("int").alias("section"), "value")
    ranged.write.format("joined_document").option("path", path).option("texts", json.dumps(texts)).option("between", between).mode("overwrite").save()
