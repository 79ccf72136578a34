"""Tables in shards of the shared folder, each shard an SQLite file, for clusters without a database server.

A row's shard is a hash of its keys. A write makes new files of the shards it
touches, one task a shard, and one small record, replaced in one step, names the
files that are the table: a task that is run twice, or a driver that dies, changes
nothing that a reader sees. The files of the last but one record are kept, so a
reader that began before a write ends with what it began with. Conditions and
groups are the work of the shards' SQL, side by side; only their results are merged.
"""

from __future__ import annotations

import json
import os
import shutil
import sqlite3
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lintel.sources.shared import shared_dir

#: Spark's types of the tables' SQL types.
_TYPES = {"BIGINT": "bigint", "INTEGER": "int", "VARCHAR": "string", "TIMESTAMP": "timestamp", "DOUBLE": "double"}


def _stored(kind: str, column):
    """A column as SQLite holds it: times in microseconds."""
    return F.unix_micros(column) if kind == "timestamp" else column.cast("int") if kind == "boolean" else column


class Shards:
    """The interface of `database.Database` as far as tables with keys go."""

    def __init__(self, spark: SparkSession, root: str | None = None, shards: int | None = None):
        self.spark = spark
        root = root or f"{shared_dir(spark)}/shards"
        if "://" in root.removeprefix("file://"):
            raise RuntimeError("shards need a shared folder that is mounted; spark.lintel.database may name a database instead")
        self.root = "/" + root.removeprefix("file:").lstrip("/")
        self.shards = shards or int(spark.conf.get("spark.sql.shuffle.partitions"))

    def _folder(self, table: str) -> str:
        return f"{self.root}/{table.lower()}"

    def _record(self, table: str) -> dict:
        with open(f"{self._folder(table)}/record") as f:
            return json.load(f)

    def _save(self, table: str, record: dict) -> None:
        fresh = f"{self._folder(table)}/record.{uuid.uuid4().hex}"
        with open(fresh, "w") as f:
            json.dump(record, f)
            f.flush()
            os.fsync(f.fileno())
        os.replace(fresh, f"{self._folder(table)}/record")

    def tables(self) -> set[str]:
        """Upper-case names."""
        found = os.listdir(self.root) if os.path.isdir(self.root) else []
        return {x.upper() for x in found if os.path.exists(f"{self.root}/{x}/record")}

    def create(self, table: str, columns: dict[str, str]) -> None:
        """A table with these columns and a primary key, unless it is there."""
        if table.upper() not in self.tables():
            os.makedirs(self._folder(table), exist_ok=True)
            self._save(table, {"columns": columns, "files": [None] * self.shards, "before": []})

    def drop(self, table: str) -> None:
        if table.upper() in self.tables():
            os.remove(f"{self._folder(table)}/record")
            shutil.rmtree(self._folder(table))

    def upsert(self, df: DataFrame, table: str, keys: tuple[str, ...]) -> int:
        """Rows of `df` instead of those with the same keys; its keys must be distinct. How many rows were written."""
        record, folder = self._record(table), self._folder(table)
        files, names = record["files"], df.columns
        made = f"CREATE TABLE {table} ({', '.join(f'{c} {t}' for c, t in record['columns'].items())}) WITHOUT ROWID"
        others = [c for c in names if c not in keys]
        change = f"UPDATE SET {', '.join(f'{c} = excluded.{c}' for c in others)}" if others else "NOTHING"
        put = f"INSERT INTO {table} ({', '.join(names)}) VALUES ({', '.join('?' for _ in names)}) ON CONFLICT ({', '.join(keys)}) DO {change}"
        where = [names.index(k) for k in keys]

        def write(batches):
            shard, con, path, rows, last = None, None, None, 0, None

            def checked(values):
                nonlocal last
                for row in values:
                    key = [row[k] for k in where]
                    if key == last:
                        raise ValueError(f"keys are not distinct: {key}")
                    last = key
                    yield row

            def done():
                con.commit()
                con.close()
                return pa.RecordBatch.from_pydict({"shard": pa.array([shard], pa.int64()), "file": [os.path.basename(path)], "rows": pa.array([rows], pa.int64())})

            for batch in batches:
                of = batch.column("__shard").to_numpy()
                at = 0
                while at < len(of):  # rows come by shard
                    end = at + int(of[at:].searchsorted(of[at], "right"))
                    if shard != of[at]:
                        if con is not None:
                            yield done()
                        shard, rows, last, path = int(of[at]), 0, None, f"{folder}/{int(of[at])}-{uuid.uuid4().hex}"
                        if files[shard]:
                            shutil.copyfile(f"{folder}/{files[shard]}", path)
                        con = sqlite3.connect(path)
                        con.execute("PRAGMA journal_mode = OFF")  # nobody knows the file before it is whole
                        if not files[shard]:
                            con.execute(made)
                    part = batch.slice(at, end - at)
                    con.executemany(put, checked(zip(*[part.column(c).to_pylist() for c in names])))
                    rows += end - at
                    at = end
            if con is not None:
                yield done()

        kinds = dict(df.dtypes)
        by = F.pmod(F.xxhash64(*[F.col(k).cast("string") for k in keys]), F.lit(len(files))).cast("int")
        rows = df.select(by.alias("__shard"), *[_stored(kinds[c], F.col(c)).alias(c) for c in names])
        rows = rows.repartitionById(len(files), F.col("__shard")).sortWithinPartitions("__shard", *keys)
        new = rows.mapInArrow(write, "shard bigint, file string, rows bigint").collect()  # a row a shard
        now = list(files)
        for r in new:
            now[r.shard] = r.file
        self._save(table, record | {"files": now, "before": files})
        for f in set(record["before"]) - set(files) - {None}:
            os.remove(f"{folder}/{f}")
        return sum(r.rows for r in new)

    def query(self, table: str, sql: str, schema: str) -> DataFrame:
        """What a SELECT gives in each shard."""
        folder, files = self._folder(table), [f for f in self._record(table)["files"] if f]
        out = self.spark.createDataFrame([], schema)
        if not files:
            return out
        kinds = {c: {"bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "timestamp": pa.timestamp("us", "UTC")}.get(t, pa.string()) for c, t in out.dtypes}

        def read(batches):
            for batch in batches:
                for k in batch.column("id").to_pylist():
                    con = sqlite3.connect(f"file:{folder}/{files[k]}?mode=ro&immutable=1", uri=True)
                    rows = con.execute(sql)
                    while part := rows.fetchmany(10_000):
                        yield pa.RecordBatch.from_arrays([pa.array(v, pa.int64()).cast(t) if pa.types.is_timestamp(t) else pa.array(v, t) for v, t in zip(zip(*part), kinds.values())], list(kinds))
                    con.close()

        return self.spark.range(0, len(files), 1, len(files)).mapInArrow(read, out.schema)

    def frame(self, table: str) -> DataFrame:
        columns = {c: _TYPES[t.split()[0].split("(")[0]] for c, t in self._record(table)["columns"].items() if c != "PRIMARY KEY"}
        return self.query(table, f"SELECT {', '.join(columns)} FROM {table}", ", ".join(f"{c} {t}" for c, t in columns.items()))

    def grouped(self, table: str, by: tuple[str, ...], largest: dict[str, str], where: str) -> DataFrame:
        """Rows that fit by group: `n`, and the largest value of some columns; each shard groups its own rows."""
        kinds = dict(self.frame(table).dtypes)
        most = ", ".join(f"max({c}) AS {name}" for name, c in largest.items())
        parts = self.query(table, f"SELECT {', '.join(by)}, count(*) AS n, {most} FROM {table} WHERE {where} GROUP BY {', '.join(by)}", ", ".join([*(f"{c} {kinds[c]}" for c in by), "n bigint", *(f"{name} {kinds[c]}" for name, c in largest.items())]))
        return parts.groupBy(*by).agg(F.sum("n").alias("n"), *[F.max(name).alias(name) for name in largest])
