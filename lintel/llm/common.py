"""Shared plumbing of the training-data operators.

Texts travel between Python and the JVM as Arrow batches. `pieces` cuts a batch
into runs of rows of bounded size, so that the numpy temporaries of an operator
are bounded whatever the batch holds; one row is never cut.

Big intermediate arrays travel through shuffles as *parcels*: one binary row
holding packed numpy arrays, addressed to a shard. A shard is one partition of
the shuffle, so its memory is the input divided by the number of shuffle
partitions, which the cluster sets to fit its executors.
"""

from __future__ import annotations

import ctypes
import gc
import os
import pickle
import sys
import tempfile
import time
import zipfile
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of text handled at a time by the vectorised kernels.
PIECE_BYTES = 1 << 20
BATCH_ROWS = "1500"
_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"
_ROOT = Path(__file__).resolve().parents[2]
_shipped: set[str] = set()


def _return_memory() -> None:
    """Lets freed arrays go back to the system, but for some 16 MB.

    Workers live on between tasks; what the C library keeps of their largest
    moment would count against the executor for as long.
    """
    pa.set_memory_pool(pa.system_memory_pool())
    libc = ctypes.CDLL(None)
    if hasattr(libc, "mallopt"):  # only glibc has it
        m_trim_threshold, m_mmap_threshold = -1, -3
        libc.mallopt(m_mmap_threshold, 4 << 20)
        libc.mallopt(m_trim_threshold, 16 << 20)


if "pyspark.worker" in sys.modules:  # in executors' Python processes only
    _return_memory()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the driver's tables, read by Spark so that any store works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ship(spark: SparkSession) -> None:
    """Get a session ready for the operators' Python parts.

    Arrow batches of whole texts get `BATCH_ROWS` rows unless the session has
    chosen a number, for both ends hold a batch at a time. Executors without
    this package on their path are sent it.
    """
    if spark.conf.get(_ROWS) == "10000":  # Spark's own default
        spark.conf.set(_ROWS, BATCH_ROWS)
    on_path = os.environ.get("PYTHONPATH", "").split(os.pathsep)
    app = spark.sparkContext.applicationId
    if str(_ROOT) in on_path or app in _shipped:
        return
    _shipped.add(app)
    out = Path(tempfile.mkdtemp()) / "lintel_src.zip"
    with zipfile.ZipFile(out, "w") as z:
        for p in sorted((_ROOT / "lintel").rglob("*.py")):
            z.write(p, p.relative_to(_ROOT))
    spark.sparkContext.addPyFile(str(out))


def checkpoint(df: DataFrame, free: bool = False) -> DataFrame:
    """Cut the lineage in the folder all executors share.

    With `free`, the driver's garbage is collected, upon which Spark's cleaner
    drops the shuffle files of what has been cut off.

    The folder is `spark.checkpoint.dir`. Only where that is unset, as in a
    local test session, a temporary one is used.
    """
    shared_dir(df.sparkSession)
    out = df.checkpoint(eager=True)
    del df
    if free:
        gc.collect()
        out.sparkSession.sparkContext._jvm.System.gc()
    return out


def free_shuffles(spark: SparkSession, wait: float = 1.2) -> None:
    """Waits until the shuffle files of what has been cut off are gone, before the next ones take their disk.

    Spark lets go of a finished query a moment later than it ends, and its cleaner
    works on its own: two rounds with a pause do.
    """
    for _ in range(2):
        gc.collect()
        spark.sparkContext._jvm.System.gc()
        time.sleep(wait)


def give_back() -> None:
    """Hands what a finished task's largest moment took back to the system; the worker lives on."""
    libc = ctypes.CDLL(None)
    if hasattr(libc, "malloc_trim"):
        libc.malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The session's checkpoint folder."""
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp())
    return sc._jsc.sc().getCheckpointDir().get()


def partitions(spark: SparkSession) -> int:
    """The number of shuffle partitions, by which shards and blocks are counted."""
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def block_of(id_col, n: int):
    """A block number in 0..n-1 of an integer id; null ids go by block 0."""
    x = F.coalesce(id_col.cast("long"), F.lit(0))
    mixed = x.bitwiseXOR(F.shiftright(x, 7)).bitwiseXOR(F.shiftright(x, 17))
    return F.pmod(mixed, F.lit(n)).cast("int")


def pieces(batch: pa.RecordBatch, col: int | str, most: int = PIECE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive row slices of a batch with at most `most` text bytes, or one row."""
    if batch.num_rows == 0:
        return
    _, off = flat(batch.column(col))
    start = 0
    while start < batch.num_rows:
        stop = int(np.searchsorted(off, off[start] + most, side="right")) - 1
        stop = min(max(stop, start + 1), batch.num_rows)
        yield batch.slice(start, stop - start)
        start = stop


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The UTF-8 bytes of a string column and the row offsets into them; null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.type not in (pa.large_string(), pa.large_binary()):
        column = column.cast(pa.large_binary() if pa.types.is_binary(column.type) else pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, b"" if pa.types.is_large_binary(column.type) else "")
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    buf = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return buf[off[0] : off[-1]], off - off[0]


def words_of(texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
    """Words `[^\\x20\\x09-\\x0D]+` of each text, flattened, and the text index of each."""
    lists = pc.ascii_split_whitespace(pc.fill_null(texts, ""))
    values = lists.flatten()
    counts = np.diff(np.asarray(lists.offsets))
    row = np.repeat(np.arange(len(lists)), counts)
    real = pc.greater(pc.binary_length(values), 0)
    if pc.all(real).as_py() is False:
        row = row[np.asarray(real)]
        values = values.filter(real)
    return values, row


def codes_of(values: pa.Array) -> tuple[np.ndarray, pa.Array]:
    """Exact integer codes of strings, and the dictionary."""
    d = values.dictionary_encode()
    if isinstance(d, pa.ChunkedArray):
        d = d.combine_chunks()
    return np.asarray(d.indices), d.dictionary


def pack(*arrays) -> bytes:
    """A parcel of numpy arrays or plain values, with its raw size in front."""
    raw = pickle.dumps(arrays, protocol=5)
    return len(raw).to_bytes(8, "little") + pa.compress(raw, codec="zstd", asbytes=True)


def unpack(parcel: bytes) -> tuple:
    """What `pack` was given."""
    size = int.from_bytes(parcel[:8], "little")
    return pickle.loads(pa.decompress(memoryview(parcel)[8:], size, codec="zstd", asbytes=True))


PARCELS = pa.schema([("kind", pa.int32()), ("to", pa.int32()), ("parcel", pa.binary())])
PARCEL_DDL = "kind int, to int, parcel binary"


def parcel_batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    """Rows (kind, shard or block, parcel)."""
    columns = zip(*rows) if rows else ([], [], [])
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, PARCELS.types)], schema=PARCELS)


def beside(rows: DataFrame, parcels: DataFrame, n: int) -> DataFrame:
    """Rows with a block number `b` and parcels (kind, to, parcel), each block in the partition of its number.

    Unlike a cogroup by `b` this neither hashes two blocks into one partition nor
    sorts the rows.
    """
    both = rows.unionByName(parcels.withColumnRenamed("to", "b"), allowMissingColumns=True)
    return both.repartitionById(n, F.col("b"))


def apart(batches, names: list[str]) -> tuple[pa.Table | None, list[tuple[int, bytes]]]:
    """(the rows with these columns, (kind, parcel) pairs) of one partition of `beside`."""
    rows, parcels = [], []
    for batch in batches:
        kind = batch.column("kind")
        is_row = pc.is_null(kind)
        rows.append(batch.select(names).filter(is_row))
        other = batch.filter(pc.invert(is_row))
        parcels += zip(other.column("kind").to_pylist(), other.column("parcel").to_pylist())
    return (pa.Table.from_batches(rows) if rows else None), parcels


def runs_of(values: np.ndarray):
    """Slices of equal values of a sorted array."""
    cuts = np.flatnonzero(values[1:] != values[:-1]) + 1
    edges = [0, *cuts.tolist(), len(values)]
    return [slice(a, b) for a, b in zip(edges[:-1], edges[1:]) if b > a]


def distinct(values: np.ndarray) -> np.ndarray:
    """Ascending distinct values, by a sort: faster than hashing for integers."""
    values = np.sort(values)
    return values[np.concatenate([[True], values[1:] != values[:-1]])] if len(values) else values


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
