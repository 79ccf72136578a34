"""Exact-substring dedup with a logarithmic family of sparse suffix arrays.

Every byte covered by a 50-byte string that also starts in a document with a
smaller id is removed. Matches are found on a *sparse* suffix array: of each
31 consecutive positions the one whose 20-byte gram hashes least is an anchor,
so any 50 equal bytes hold the same anchor at the same place, and only about one
suffix in 16 is indexed. All 50-byte strings through an anchor's gram lie in its
surroundings, the 30 bytes before it to the 50 after its start.

Anchors are dealt by gram to shards. A shard takes them in batches of ascending
document id: a batch gets its sorted array, is scanned against the levels there
are, and joins them; two levels of one size merge into the next, so n batches
leave at most log2(n) + 1 levels. Arrays hold 40 bits of the gram's hash instead of
its bytes: their scan only says which grams may recur in several documents.

What is removed is decided on bytes. Anchors whose grams recur go back to their
documents for their surroundings, and these are compared: equal ones are removed
from all but the smallest id, and of those that differ each 50-byte string is
compared by itself. Bytes are grouped by hashes and then checked against their
group's first; where a hash puts unlike bytes together they are sorted instead.

Before anything is sent, equal surroundings that a task or a block holds are
compared among themselves, and only those of the smallest id go on, so that a
passage in a third of all documents is sent by each task once.

Rounds: texts to anchors; anchors to shards; recurring anchors to texts and back;
all spans to texts. Texts are moved once in each of the last two.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm import common
from lintel.llm.common import mix64, pack, unpack

LENGTH = 50  # bytes of a match
GRAM = 20
SPAN = LENGTH - GRAM + 1  # positions of which one is an anchor
BEFORE = LENGTH - GRAM  # bytes before an anchor that a match through it can reach
WIDE = BEFORE + LENGTH
_MULT = mix64(np.arange(1, 24, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
#: Anchors gathered by a task before it sends a parcel to each shard.
FLUSH = 300_000


def _words_at(buf: np.ndarray, n: int) -> np.ndarray:
    """The 8 bytes from each of the first n positions as integers; zeros follow the end."""
    out = np.empty(n + 8, np.uint64)
    padded = np.zeros(n + 24, np.uint8)
    padded[: len(buf)] = buf
    for k in range(8):
        part = padded[k : k + (n + 8 - k + 7) // 8 * 8].view("<u8")
        out[k::8] = part[: len(out[k::8])]
    return out[:n]


def anchors_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, gram hash) of the anchors of texts laid end to end."""
    n = len(buf)
    if n < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    w = _words_at(buf, n + 24)
    h = w[:n] * _MULT[0]
    h += w[8 : n + 8] * _MULT[1]
    h += w[GRAM - 8 : n + GRAM - 8] * _MULT[2]
    h ^= h >> np.uint64(32)
    h *= _MULT[3]
    h ^= h >> np.uint64(29)
    h |= np.uint64(1)
    m = h
    for k in (1, 2, 4, 8):
        m = np.minimum(m[:-k], m[k:])
    k = SPAN - 16
    m = np.minimum(m[:-k], m[k:])
    least = np.zeros(n + SPAN - 1, np.uint64)  # of the window that starts at p, at p + SPAN - 1
    least[SPAN - 1 : SPAN - 1 + len(m)] = m
    for e in off[1:]:  # windows that would leave their text do not count
        least[max(0, e - LENGTH + 1) + SPAN - 1 : e + SPAN - 1] = 0
    x = least
    for k in (1, 2, 4, 8):
        x = np.maximum(x[:-k], x[k:])
    k = SPAN - 16
    x = np.maximum(x[:-k], x[k:])
    at = np.flatnonzero(x == h)
    return at, mix64(h[at])


def surroundings(buf: np.ndarray, at: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(the WIDE bytes around anchors, zero outside the text, how far the text reaches to the left, and to the right)."""
    padded = np.zeros(len(buf) + WIDE, np.uint8)
    padded[BEFORE : BEFORE + len(buf)] = buf
    around = np.lib.stride_tricks.sliding_window_view(padded, WIDE)[at].copy()
    left, right = np.minimum(BEFORE, at - start), np.minimum(LENGTH, end - at)
    cut = np.flatnonzero((left < BEFORE) | (right < LENGTH))
    place = np.arange(WIDE)[None, :] - BEFORE
    around[cut] *= ((place >= -left[cut, None]) & (place < right[cut, None])).astype(np.uint8)
    return around, left.astype(np.uint8), right.astype(np.uint8)


def _grouped(order: np.ndarray, key: np.ndarray):
    """Yields (key, the part of `order` with it); `order` sorts `key`."""
    sorted_ = key[order]
    cuts = np.flatnonzero(np.diff(sorted_)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(key[part[0]]), part


def _runs(row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct values of an ascending array and how often each comes."""
    if not len(row):
        return row, row
    first = np.flatnonzero(np.concatenate([[True], row[1:] != row[:-1]]))
    return row[first], np.diff(np.append(first, len(row)))


def row_hashes(rows: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of bytes."""
    wide = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), np.uint8)
    wide[:, : rows.shape[1]] = rows
    v, h = wide.view("<u8"), np.zeros(len(rows), np.uint64)
    for k in range(v.shape[1]):
        h += v[:, k] * _MULT[k]
    return mix64(h)


def row_codes(rows: np.ndarray) -> np.ndarray:
    """Equal integers for equal rows of bytes, unequal ones for others; by hash, checked on the bytes."""
    if not len(rows):
        return np.zeros(0, np.int64)
    h = row_hashes(rows)
    order = np.argsort(h, kind="stable")
    new = np.concatenate([[True], h[order[1:]] != h[order[:-1]]])
    run = np.cumsum(new) - 1
    first = order[np.flatnonzero(new)]
    again = np.flatnonzero(~new)
    if len(again) and (rows[order[again]] != rows[first[run[again]]]).any():  # unlike bytes of one hash
        packed = np.ascontiguousarray(rows).view(f"V{rows.shape[1]}")[:, 0]
        return np.unique(packed, return_inverse=True)[1].reshape(-1)
    out = np.empty(len(rows), np.int64)
    out[order] = run
    return out


def least_of(code: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """The smallest id among the entries of each entry's code."""
    least = np.full(int(code.max()) + 1 if len(code) else 0, np.iinfo(np.int64).max)
    np.minimum.at(least, code, ids)
    return least[code]


def extents(around: np.ndarray, left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Surroundings with how far they reach, as rows of bytes."""
    return np.concatenate([around, left[:, None].astype(np.uint8), right[:, None].astype(np.uint8)], axis=1)


class Owners:
    """The documents of a parcel: id, text hash (which tells rows of one id apart) and block."""

    def __init__(self, ids, keys, blocks):
        self.ids, self.keys, self.blocks = ids, keys, blocks

    def parcel(self, row: np.ndarray, *columns) -> bytes:
        """Columns of entries in ascending row order, with the documents they belong to."""
        which, counts = _runs(row)
        return pack(self.ids[which], self.keys[which], self.blocks[which].astype(np.int32), counts.astype(np.uint32), *columns)

    @staticmethod
    def opened(parcels: list[bytes]):
        """(owners, row of each entry, columns) of several parcels together."""
        parts = [unpack(p) for p in parcels]
        owners = Owners(*(np.concatenate([p[k] for p in parts]) for k in range(3)))
        counts = np.concatenate([p[3] for p in parts])
        row = np.repeat(np.arange(len(counts)), counts)
        return owners, row, [np.concatenate([p[k] for p in parts]) for k in range(4, len(parts[0]))]


class Levels:
    """The family of sorted arrays of one shard.

    An entry is (surroundings, gram, smallest id); a level's size is the number of
    batches in it, always a power of two.
    """

    def __init__(self):
        self.levels: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    @staticmethod
    def suffix_array(wide, gram, ids):
        """Sorted, one entry for equal surroundings, with their smallest id."""
        order = np.lexsort((ids, wide))
        wide, gram, ids = wide[order], gram[order], ids[order]
        first = np.concatenate([[True], wide[1:] != wide[:-1]]) if len(wide) else np.zeros(0, bool)
        return wide[first], gram[first], ids[first]

    def scan(self, wide: np.ndarray) -> np.ndarray:
        """Which of the surroundings a level has."""
        out = np.zeros(len(wide), bool)
        for _, known, _, _ in self.levels:
            at = np.minimum(np.searchsorted(known, wide), len(known) - 1)
            out |= known[at] == wide
        return out

    def add(self, wide, gram, ids) -> np.ndarray:
        """Takes a batch of ids above all before; which entries a smaller id covers."""
        array = self.suffix_array(wide, gram, ids)
        at = np.searchsorted(array[0], wide)
        found = array[2][at] < ids
        if self.levels:
            order = np.argsort(wide)  # so that the scan walks both arrays forward
            hit = np.empty(len(wide), bool)
            hit[order] = self.scan(wide[order])
            found |= hit
        size = 1
        while self.levels and self.levels[-1][0] == size:
            _, *other = self.levels.pop()
            array = self.suffix_array(*(np.concatenate([x, y]) for x, y in zip(other, array)))
            size *= 2
        self.levels.append((size, *array))
        return found


def _recurring(ids: np.ndarray, gram: np.ndarray, batches: int, stored: list[tuple[int, np.ndarray, np.ndarray]] = ()) -> np.ndarray:
    """The grams that several ids have, at least one of them among the entries; `stored` has (size, grams, ids) of known levels."""
    order = np.argsort(ids, kind="stable")
    levels, hit, at = Levels(), np.zeros(len(ids), bool), 0
    for size, known, owners in sorted(stored, key=lambda x: -x[0]):
        levels.levels.append((size, *Levels.suffix_array(known, known, owners)))
    for k in range(batches):
        stop = len(order) * (k + 1) // batches
        if 0 < stop < len(order):  # an id is not cut in two
            stop = int(np.searchsorted(ids[order], ids[order[stop - 1]], side="right"))
        part = order[at:stop]
        if len(part):
            hit[part] = levels.add(gram[part], gram[part], ids[part])
        at = max(at, stop)
    return common.distinct(gram[hit])


def _among_sorted(values: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The positions of the x that are among ascending values."""
    if not len(values):
        return np.zeros(0, np.int64)
    return np.flatnonzero(values[np.minimum(np.searchsorted(values, x), len(values) - 1)] == x)


def _window_matches(ids: np.ndarray, left, right, around: np.ndarray):
    """(entry, first byte, end) relative to the anchor of spans that a smaller id shares."""
    hit = np.zeros((len(ids), SPAN + 1), bool)
    for o in range(SPAN):
        can = np.flatnonzero((o >= BEFORE - left) & (o <= right - GRAM))
        if len(can) > 1:
            hit[can, o] = least_of(row_codes(around[can, o : o + LENGTH]), ids[can]) < ids[can]
    flat = hit.reshape(-1)
    before = np.concatenate([[False], flat[:-1]])
    opens, closes = np.flatnonzero(flat & ~before), np.flatnonzero(~flat & before)
    if len(closes) < len(opens):
        closes = np.append(closes, len(flat))
    entry = opens // (SPAN + 1)
    return entry, opens % (SPAN + 1) - BEFORE, (closes - 1) % (SPAN + 1) - BEFORE + LENGTH


_PARCELS = pa.schema([("kind", pa.int32()), ("to", pa.int32()), ("parcel", pa.binary())])
_DDL = "kind int, to int, parcel binary"


def _batch(rows: list[tuple[int, int, bytes]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*rows) if rows else ([], [], []), _PARCELS.types)], schema=_PARCELS)


def _table_texts(table: pa.Table):
    """(ids, text hashes, bytes, offsets) of a group of documents."""
    buf, off = common.flat(table.column("t"))
    return table.column("i").to_numpy(zero_copy_only=False), table.column("k").to_numpy(), buf, off


def _place(ids, keys, owners: Owners) -> tuple[np.ndarray, np.ndarray]:
    """(document, owner) pairs of equal id and text hash; repeated rows all get theirs."""
    a = np.rec.fromarrays([ids, keys])
    b = np.rec.fromarrays([owners.ids, owners.keys])
    _, inverse = np.unique(np.concatenate([a, b]), return_inverse=True)
    mine, theirs = inverse[: len(a)], inverse[len(a) :]
    order = np.argsort(theirs, kind="stable")
    lo, hi = (np.searchsorted(theirs[order], mine, side=s) for s in ("left", "right"))
    n = hi - lo
    doc = np.repeat(np.arange(len(a)), n)
    within = np.arange(len(doc)) - np.repeat(np.cumsum(n) - n, n)
    return doc, order[np.repeat(lo, n) + within]


def _entries(ids, keys, parcels: list[bytes]):
    """(document, columns) of the parcels' entries that belong to these documents."""
    owners, row, columns = Owners.opened(parcels)
    doc, owner = _place(ids, keys, owners)
    counts = np.bincount(row, minlength=len(owners.ids))
    first = np.cumsum(counts) - counts
    n = counts[owner]
    entry_doc = np.repeat(doc, n)
    entry = np.repeat(first[owner], n) + np.arange(len(entry_doc)) - np.repeat(np.cumsum(n) - n, n)
    return entry_doc, [c[entry] for c in columns]


def _without(part: pa.RecordBatch, doc, start, end, schema: pa.Schema) -> pa.RecordBatch:
    """The rows of a piece without the given spans of their bytes."""
    buf, off = common.flat(part.column("t"))
    edge = np.zeros(len(buf) + 1, np.int32)
    np.add.at(edge, off[doc] + start, 1)
    np.add.at(edge, np.minimum(off[doc] + end, off[doc + 1]), -1)
    gone = np.cumsum(edge[:-1], dtype=np.int32) > 0
    opens, closes = gone.copy(), gone.copy()  # first and last bytes of runs, which end with their text
    opens[1:] &= ~gone[:-1]
    closes[:-1] &= ~gone[1:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))]
    opens[inner] |= gone[inner]
    closes[inner - 1] |= gone[inner - 1]
    a, b = np.flatnonzero(opens), np.flatnonzero(closes) + 1
    owner = np.searchsorted(off, a, side="right") - 1
    flat = (np.stack([a, b], 1) - off[owner][:, None]).reshape(-1)
    counts = 2 * np.bincount(owner, minlength=part.num_rows)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(flat, pa.int64()))
    kept = buf[~gone]
    total = np.concatenate([[0], np.cumsum(~gone, dtype=np.int32)])[off]
    kept = pa.Array.from_buffers(pa.binary(), part.num_rows, [None, pa.py_buffer(total.astype(np.int32)), pa.py_buffer(kept)])
    return pa.RecordBatch.from_arrays([part.column("i"), pa.array(np.diff(off), pa.int64()), lists, kept], schema=schema)


def _documents(docs: DataFrame, id_col: str, text: str, n: int) -> DataFrame:
    """(i, t, k, b): ids, texts, text hashes and blocks."""
    src = docs.select(docs[f"`{id_col}`"].try_cast("long").alias("i"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("t"))
    return src.withColumns({"k": F.xxhash64("t"), "b": common.block_of(src["i"], n)})


def removed_spans(docs: DataFrame, id_col: str = "doc_id", text: str = "text", batches: int = 8) -> DataFrame:
    """What of each text also starts in a smaller id.

    One row per input row: the id, `n_bytes`, `spans` (starts and ends of the
    maximal removed runs, in bytes, alternating) and `kept` (the other bytes). A
    null text counts as empty. Rows of one id never remove from each other; a row
    without an id, or with one that is no integer, neither removes nor loses
    anything. Texts shorter than 50 bytes stay. An empty table gives an empty one.
    Other columns are left out.
    """
    spark = docs.sparkSession
    common.ship(spark)
    n = common.partitions(spark)
    return _removed(_documents(docs, id_col, text, n), n, batches)[0].withColumnRenamed("i", id_col)


class Family:
    """The index family in a folder, so that batches can be added in later runs.

    The folder holds the texts of all batches and the levels: tables of anchors,
    each of a power of two batches, whose sizes all differ after a batch has been
    added. A batch is scanned against the levels; of earlier texts only those are
    read again that share a gram with it.
    """

    def __init__(self, spark, folder: str, id_col: str = "doc_id", text: str = "text"):
        self.spark, self.folder, self.id_col, self.text = spark, folder, id_col, text
        self.path = spark._jvm.org.apache.hadoop.fs.Path(folder)
        self.store = self.path.getFileSystem(spark._jsc.hadoopConfiguration())

    def _names(self, kind: str) -> list[str]:
        path = self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/{kind}")
        return sorted(x.getPath().getName() for x in self.store.listStatus(path)) if self.store.exists(path) else []

    def levels(self) -> list[tuple[int, str]]:
        """(batches, name) of the levels."""
        return [(int(name.split("-")[1]), name) for name in self._names("levels") if not name.startswith(("_", "."))]

    def add(self, docs: DataFrame, batches: int = 1) -> DataFrame:
        """What `removed_spans` says of a batch after all earlier ones.

        Its ids must be above all ids before. Rows without an id lose nothing and
        are not kept. A run that is lost before its level is complete can be
        repeated: a batch counts once its level is there.
        """
        common.ship(self.spark)
        done = self.levels()
        number = sum(size for size, _ in done)
        shards = [int(x.split("-")[1]) for x in self._names("shards") if x.startswith("n-")]
        n = shards[0] if shards else common.partitions(self.spark)
        if not shards:
            self.store.mkdirs(self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.folder}/shards/n-{n}"))
        src = _documents(docs, self.id_col, self.text, n)
        src.where("i IS NOT NULL").write.mode("overwrite").parquet(f"{self.folder}/texts/{number:08d}")
        own = self.spark.read.parquet(f"{self.folder}/texts/{number:08d}")
        old = texts = None
        if done:
            texts = self.spark.read.parquet(*[f"{self.folder}/texts/{k:08d}" for k in range(number)])
            low, high = own.agg(F.min("i")).first()[0], texts.agg(F.max("i")).first()[0]
            if low is not None and high is not None and low <= high:
                raise ValueError(f"ids of a batch must be above {high}")
            for size, name in done:
                table = self.spark.read.parquet(f"{self.folder}/levels/{name}").select((F.lit(_LEVEL) + size).alias("kind"), "to", "parcel")
                old = table if old is None else old.unionByName(table)
        out, anchors = _removed(src, n, batches, old, texts)
        size, gone = 1, []
        new = anchors.where(F.col("kind") == _ANCHORS)
        while done and done[-1][0] == size:
            _, name = done.pop()
            gone.append(name)
            new = new.unionByName(self.spark.read.parquet(f"{self.folder}/levels/{name}"))
            size *= 2
        new = new.repartitionById(n, F.col("to")).mapInArrow(_merged, _DDL)
        temp = f"{self.folder}/levels/_{number:08d}"
        new.write.mode("overwrite").parquet(temp)
        fs = self.spark._jvm.org.apache.hadoop.fs.Path
        for name in gone:  # the new level takes their place
            self.store.delete(fs(f"{self.folder}/levels/{name}"), True)
        self.store.rename(fs(temp), fs(f"{self.folder}/levels/{99999999 - size:08d}-{size}"))
        return out.withColumnRenamed("i", self.id_col)


def _merged(batches):
    """A shard's entries of several levels as one array in gram order."""
    parcels, shard = [], None
    for batch in batches:
        for to, p in zip(batch.column("to").to_pylist(), batch.column("parcel").to_pylist()):
            shard = to
            parcels.append(p)
    if parcels:
        owners, row, columns = Owners.opened(parcels)
        yield _batch([(_ANCHORS, shard, owners.parcel(row, *columns))])


#: Kinds of parcels: spans to blocks; anchors to shards, or back; anchors of a level of so many batches more.
_SPANS, _ANCHORS, _LEVEL = 0, 1, 2


def _removed(src: DataFrame, n: int, batches: int, levels: DataFrame | None = None, texts: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(rows as of `removed_spans`, the anchors' parcels) of documents after those of some levels, whose texts are given."""
    names = ["i", "t", "k", "b"]
    SPANS, ANCHORS = _SPANS, _ANCHORS

    def spans_of(owners: Owners, row, entries: np.ndarray, start: np.ndarray, end: np.ndarray) -> list:
        """Spans of entries, by block."""
        block = owners.blocks[row[entries]]
        order = np.lexsort((row[entries], block))
        return [(SPANS, b, owners.parcel(row[entries[part]], start[part].astype(np.uint32), end[part].astype(np.uint32))) for b, part in _grouped(order, block)]

    def among(owners: Owners, row, pos, left, right, around) -> tuple[np.ndarray, list]:
        """(entries of the smallest id of their surroundings, the others' spans as parcels)."""
        ids = owners.ids[row]
        covered = least_of(row_codes(extents(around, left, right)), ids) < ids
        at = np.flatnonzero(covered)
        pos = pos.astype(np.int64)
        return np.flatnonzero(~covered), spans_of(owners, row, at, pos[at] - left[at], pos[at] + right[at])

    def anchor_parcels(batches_in):
        docs_of, found, held, base = [], [], 0, 0

        def parcels():
            nonlocal docs_of, found, held, base
            owners = Owners(*(np.concatenate([d[k] for d in docs_of]) for k in range(3)))
            row, pos, gram, left, right, around = (np.concatenate([x[k] for x in found]) for k in range(6))
            docs_of, found, held, base = [], [], 0, 0
            stay, out = among(owners, row, pos, left, right, around)
            row, pos, gram = row[stay], pos[stay], gram[stay]
            # spans travel with the anchors up to the shards, their block in front
            out = [(SPANS, int(np.uint64(b) % np.uint64(n)), pack(b, p)) for _, b, p in out]
            shard = (gram % np.uint64(n)).astype(np.uint32)
            for s, part in _grouped(np.argsort(shard, kind="stable"), shard):
                g = gram[part] >> np.uint64(24)
                out.append((ANCHORS, s, owners.parcel(row[part], g.astype(np.uint32), (g >> np.uint64(32)).astype(np.uint8), pos[part].astype(np.uint32))))
            return _batch(out)

        for batch in batches_in:
            batch = batch.filter(pc.is_valid(batch.column("i")))
            for part in common.pieces(batch, "t", 1 << 19):
                buf, off = common.flat(part.column("t"))
                at, gram = anchors_of(buf, off)
                row = np.searchsorted(off, at, side="right") - 1
                around, left, right = surroundings(buf, at, off[row], off[row + 1])
                docs_of.append((part.column("i").to_numpy(), part.column("k").to_numpy(), part.column("b").to_numpy()))
                found.append((row + base, at - off[row], gram, left, right, around))
                base += part.num_rows
                held += len(at)
                if held > FLUSH:
                    yield parcels()
        if held:
            yield parcels()

    def match(batches_in):
        held: dict[int, list] = {}
        for batch in batches_in:
            for kind, p in zip(batch.column("kind").to_pylist(), batch.column("parcel").to_pylist()):
                if kind == SPANS:
                    block, inner = unpack(p)
                    yield _batch([(SPANS, block, inner)])
                else:
                    held.setdefault(kind, []).append(p)
        if ANCHORS not in held:
            return
        opened = {}
        for kind in sorted(held):
            owners, row, (g0, g1, pos) = Owners.opened(held.pop(kind))
            opened[kind] = owners, row, g0.astype(np.uint64) | g1.astype(np.uint64) << np.uint64(32), pos
        stored = [(kind - _LEVEL, gram, owners.ids[row]) for kind, (owners, row, gram, _) in opened.items() if kind > _LEVEL]
        owners, row, gram, _ = opened[ANCHORS]
        again = _recurring(owners.ids[row], gram, batches, stored)
        for owners, row, gram, pos in opened.values():
            open_ = _among_sorted(again, gram)
            block = owners.blocks[row[open_]]
            order = np.lexsort((row[open_], block))
            yield _batch([(ANCHORS, b, owners.parcel(row[open_[part]], pos[open_[part]], gram[open_[part]])) for b, part in _grouped(order, block)])

    def fetch(batches_in):
        table, asked = common.apart(batches_in, names)
        if table is None or not asked:
            return
        table = table.filter(pc.is_valid(table.column("i"))).combine_chunks()
        if not table.num_rows:
            return
        ids, keys, buf, off = _table_texts(table)
        doc, (pos, gram) = _entries(ids, keys, [p for _, p in asked])
        owners, at = Owners(ids, keys, table.column("b").to_numpy()), off[doc] + pos
        order = np.argsort(doc, kind="stable")
        doc, pos, gram, at = doc[order], pos[order], gram[order], at[order]
        stays = []
        for lo in range(0, len(doc), FLUSH):  # some at a time, for memory
            some = slice(lo, lo + FLUSH)
            around, left, right = surroundings(buf, at[some], off[doc[some]], off[doc[some] + 1])
            stay, out = among(owners, doc[some], pos[some], left, right, around)
            stays.append((doc[some][stay], pos[some][stay], gram[some][stay], left[stay], right[stay], around[stay]))
            yield _batch([(SPANS, int(np.uint64(b) % np.uint64(n)), pack(b, p)) for _, b, p in out])
        doc, pos, gram, left, right, around = (np.concatenate([x[k] for x in stays]) for k in range(6))
        shard = (gram % np.uint64(n)).astype(np.uint32)
        order = np.lexsort((doc, shard))
        for s, part in _grouped(order, shard):
            yield _batch([(ANCHORS, s, owners.parcel(doc[part], pos[part].astype(np.uint32), left[part], right[part], around[part]))])

    def settle(batches_in):
        parcels = []
        for batch in batches_in:
            for kind, p in zip(batch.column("kind").to_pylist(), batch.column("parcel").to_pylist()):
                if kind == SPANS:
                    block, inner = unpack(p)
                    yield _batch([(SPANS, block, inner)])
                else:
                    parcels.append(p)
        if not parcels:
            return
        owners, row, (pos, left, right, around) = Owners.opened(parcels)
        del parcels
        stay, out = among(owners, row, pos, left, right, around)
        yield _batch(out)
        row, pos, left, right, around = row[stay], pos[stay].astype(np.int64), left[stay], right[stay], around[stay]
        entry, first, end = _window_matches(owners.ids[row], left.astype(int), right.astype(int), around)
        yield _batch(spans_of(owners, row, entry, pos[entry] + first, pos[entry] + end))

    result = pa.schema([("i", pa.int64()), ("n_bytes", pa.int64()), ("spans", pa.list_(pa.int64())), ("kept", pa.binary())])

    def cut(batches_in):
        table, spans = common.apart(batches_in, names)
        if table is None:
            return
        table = table.combine_chunks()
        doc = start = end = np.zeros(0, np.int64)
        if spans and table.num_rows:
            ids, keys = np.asarray(table.column("i").fill_null(0)), table.column("k").to_numpy()
            doc, (start, end) = _entries(ids, keys, [p for _, p in spans])
            real = np.asarray(pc.is_valid(table.column("i").combine_chunks()))[doc]
            doc, start, end = doc[real], start[real], end[real]
            order = np.argsort(doc, kind="stable")
            doc, start, end = doc[order], start[order], end[order]
        base = 0
        for batch in table.to_batches():
            for part in common.pieces(batch, "t"):
                lo, hi = np.searchsorted(doc, [base, base + part.num_rows])
                yield _without(part, doc[lo:hi] - base, start[lo:hi].astype(np.int64), end[lo:hi].astype(np.int64), result)
                base += part.num_rows

    def asked_ids(batches_in):
        for batch in batches_in:
            for p in batch.column("parcel").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(common.distinct(unpack(p)[0]))], ["i"])

    anchors = src.mapInArrow(anchor_parcels, _DDL)
    everything, known = anchors, src
    if levels is not None:
        anchors = common.checkpoint(anchors)
        everything = anchors.unionByName(levels)
    spark = src.sparkSession
    first = common.checkpoint(everything.repartitionById(n, F.col("to")).mapInArrow(match, _DDL))
    common.free_shuffles(spark)
    asked = first.where(F.col("kind") == ANCHORS)
    if texts is not None:
        again = asked.select("parcel").mapInArrow(asked_ids, "i long").distinct()
        known = src.unionByName(texts.join(again, "i", "left_semi").select(src.columns))
    fetched = common.beside(known, asked, n).mapInArrow(fetch, _DDL)
    second = common.checkpoint(fetched.repartitionById(n, F.col("to")).mapInArrow(settle, _DDL))
    common.free_shuffles(spark)
    spans = first.where(F.col("kind") == SPANS).unionByName(second)
    return common.beside(src, spans, n).mapInArrow(cut, "i long, n_bytes long, spans array<long>, kept binary"), anchors
