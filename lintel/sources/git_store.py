"""Git repositories as Spark data sources: objects and references, read where they lie.

`spark.read.format("git")` gives the objects of a repository, `git_refs` its branches,
tags and HEAD. Packs are read in byte ranges, loose objects by their folders, each in a task of
its own; a task finds the bases of its deltas by seeking in the same pack. Nothing is
checked out or cloned, and the driver only lists names and sizes.
"""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import OrderedDict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

#: The kinds of packed objects, by number; 6 and 7 are deltas to an offset and to an id.
KINDS = {1: "commit", 2: "tree", 3: "blob", 4: "tag"}
TO_OFFSET, TO_ID = 6, 7
SPLIT_BYTES = 64 << 20
CACHE_BYTES = 32 << 20
#: Folders of loose objects for a task, of 256 at most.
FOLDERS = 32
_BATCH_BYTES = 4 << 20
_SCHEMA = pa.schema([("oid", pa.string()), ("type", pa.string()), ("size", pa.int64()), ("content", pa.binary())])


def store_of(path: str) -> tuple[fs.FileSystem, str]:
    """The file system of a path and the path in it; without a scheme it is a folder that all executors see."""
    return fs.FileSystem.from_uri(path) if re.match(r"[a-z0-9]+:/", path) else (fs.LocalFileSystem(), path)


def _git_dir(store: fs.FileSystem, path: str) -> str:
    """The repository itself, also where its working tree is named."""
    inner = path.rstrip("/") + "/.git"
    return inner if store.get_file_info(inner).type == fs.FileType.Directory else path.rstrip("/")


def _listed(store: fs.FileSystem, folder: str, deep: bool = False) -> list[fs.FileInfo]:
    return sorted(store.get_file_info(fs.FileSelector(folder, allow_not_found=True, recursive=deep)), key=lambda f: f.path)


def _text(store: fs.FileSystem, path: str) -> str:
    if store.get_file_info(path).type != fs.FileType.File:
        return ""
    with store.open_input_file(path) as f:
        return f.read().decode("utf-8", "replace")


def apply_delta(base: bytes, delta: bytes) -> bytes:
    """What a delta makes of its base."""
    at = 0

    def number() -> int:
        nonlocal at
        out = shift = 0
        while True:
            b = delta[at]
            at += 1
            out |= (b & 127) << shift
            shift += 7
            if b < 128:
                return out

    want, size = number(), number()
    if want != len(base):
        raise ValueError("a delta does not fit its base")
    out = bytearray()
    while at < len(delta):
        op = delta[at]
        at += 1
        if op >= 128:  # a copy: the low seven bits tell which bytes of offset and length follow
            field = [0] * 7
            for k in range(7):
                if op >> k & 1:
                    field[k] = delta[at]
                    at += 1
            start, n = int.from_bytes(field[:4], "little"), int.from_bytes(field[4:], "little") or 0x10000
            out += base[start : start + n]
        elif op:
            out += delta[at : at + op]
            at += op
        else:
            raise ValueError("an unknown step in a delta")
    if len(out) != size:
        raise ValueError("a delta gives another length than it says")
    return bytes(out)


class Pack:
    """One pack and its index."""

    def __init__(self, store: fs.FileSystem, path: str):
        with store.open_input_file(path.removesuffix(".pack") + ".idx") as f:
            raw = f.read()
        if raw[:4] == b"\xfftOc":
            n = int.from_bytes(raw[8 + 255 * 4 : 8 + 256 * 4], "big")
            ids = 8 + 1024
            self.ids = raw[ids : ids + 20 * n]
            small = np.frombuffer(raw, ">u4", n, ids + 24 * n).astype(np.int64)
            far = small >= 1 << 31
            if far.any():  # offsets beyond 2 GB stand in a table of their own
                large = np.frombuffer(raw, ">u8", int(far.sum()), ids + 28 * n).astype(np.int64)
                small[far] = large[small[far] - (1 << 31)]
            self.offsets = small
        else:
            n = int.from_bytes(raw[255 * 4 : 1024], "big")
            rows = np.frombuffer(raw, np.dtype([("at", ">u4"), ("id", "V20")]), n, 1024)
            self.offsets, self.ids = rows["at"].astype(np.int64), rows["id"].tobytes()
        self.file = store.open_input_file(path)
        order = np.argsort(self.offsets, kind="stable")
        self.by_offset, self.order = self.offsets[order], order
        self.ends = np.append(self.by_offset[1:], self.file.size() - 20)
        self.cache: OrderedDict[int, tuple[str, bytes]] = OrderedDict()
        self.cached = 0

    def oid(self, k: int) -> str:
        return self.ids[20 * k : 20 * k + 20].hex()

    def offset_of(self, oid: bytes) -> int:
        low, high = 0, len(self.offsets)
        while low < high:
            mid = (low + high) // 2
            if self.ids[20 * mid : 20 * mid + 20] < oid:
                low = mid + 1
            else:
                high = mid
        if self.ids[20 * low : 20 * low + 20] != oid:
            raise KeyError(f"the base {oid.hex()} of a delta is not in its pack")
        return int(self.offsets[low])

    def _raw(self, offset: int) -> tuple[int, int, int | None, bytes]:
        """(kind, size as it says, offset of its base, its compressed bytes)."""
        k = int(np.searchsorted(self.by_offset, offset))
        raw = self.file.read_at(int(self.ends[k]) - offset, offset)
        kind, size, shift, at = raw[0] >> 4 & 7, raw[0] & 15, 4, 1
        while raw[at - 1] >= 128:
            size |= (raw[at] & 127) << shift
            shift += 7
            at += 1
        base = None
        if kind == TO_OFFSET:
            back = raw[at] & 127
            while raw[at] >= 128:
                at += 1
                back = (back + 1) << 7 | raw[at] & 127
            at += 1
            base = offset - back
        elif kind == TO_ID:
            base = self.offset_of(raw[at : at + 20])
            at += 20
        return kind, size, base, raw[at:]

    def kind(self, offset: int) -> str:
        """An object's type, by its chain's headers alone."""
        while True:
            kind, _, base, _ = self._raw(offset)
            if base is None:
                return KINDS[kind]
            offset = base

    def read(self, offset: int) -> tuple[str, bytes]:
        """(type, content) of the object at an offset, its chain of deltas applied."""
        chain: list[tuple[int, bytes]] = []
        while offset not in self.cache:
            kind, _, base, body = self._raw(offset)
            if base is None:
                self._keep(offset, (KINDS[kind], zlib.decompress(body)))
                break
            chain.append((offset, zlib.decompress(body)))
            offset = base
        self.cache.move_to_end(offset)
        out = self.cache[offset]
        for at, delta in reversed(chain):
            out = (out[0], apply_delta(out[1], delta))
            self._keep(at, out)
        return out

    def _keep(self, offset: int, found: tuple[str, bytes]) -> None:
        self.cache[offset] = found
        self.cached += len(found[1])
        while self.cached > CACHE_BYTES and len(self.cache) > 1:
            self.cached -= len(self.cache.popitem(last=False)[1][1])


class _Part(InputPartition):
    """A byte range of a pack, or the loose objects of some folders."""

    def __init__(self, path: str, start: int = 0, stop: int = 0, folders: tuple = ()):
        self.path, self.start, self.stop, self.folders = path, start, stop, folders


class ObjectReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]
        self.split = int(options.get("split_bytes", SPLIT_BYTES))
        self.types = {t for t in options.get("types", "").split(",") if t} or set(KINDS.values())
        self.most = int(options["max_bytes"]) if "max_bytes" in options else None

    def partitions(self) -> list[_Part]:
        store, path = store_of(self.path)
        base = _git_dir(store, path) + "/objects"
        parts = []
        for f in _listed(store, f"{base}/pack"):
            if f.path.endswith(".pack"):
                parts += [_Part(f.path, a, min(a + self.split, f.size)) for a in range(0, f.size, self.split)]
        loose = [f.path for f in _listed(store, base) if re.fullmatch("[0-9a-f]{2}", f.base_name)]
        parts += [_Part(base, folders=tuple(loose[k : k + FOLDERS])) for k in range(0, len(loose), FOLDERS)]
        return parts

    def read(self, partition: _Part) -> Iterator[pa.RecordBatch]:
        store, _ = store_of(self.path)
        rows: list[tuple] = []
        held = 0
        for row in self._loose(store, partition.folders) if partition.folders else self._packed(store, partition):
            rows.append(row)
            held += len(row[3] or b"")
            if held > _BATCH_BYTES or len(rows) >= 5000:
                yield _batch(rows)
                rows, held = [], 0
        if rows:
            yield _batch(rows)

    def _content(self, oid: str, kind: str, content: bytes) -> tuple:
        return oid, kind, len(content), None if self.most is not None and len(content) > self.most else content

    def _loose(self, store: fs.FileSystem, folders: tuple) -> Iterator[tuple]:
        for folder in folders:
            for f in _listed(store, folder):
                if not re.fullmatch("[0-9a-f]{38}", f.base_name):
                    continue
                with store.open_input_file(f.path) as s:
                    head, _, content = zlib.decompress(s.read()).partition(b"\0")
                kind = head.split(b" ")[0].decode()
                if kind in self.types:
                    yield self._content(folder[-2:] + f.base_name, kind, content)

    def _packed(self, store: fs.FileSystem, part: _Part) -> Iterator[tuple]:
        pack = Pack(store, part.path)
        low, high = np.searchsorted(pack.by_offset, [part.start, part.stop])
        every = self.types >= set(KINDS.values())
        for k in range(low, high):
            at = int(pack.by_offset[k])
            if every or pack.kind(at) in self.types:
                yield self._content(pack.oid(int(pack.order[k])), *pack.read(at))


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), _SCHEMA)], schema=_SCHEMA)


class GitObjects(DataSource):
    """(oid, type, size, content) of all objects; one that lies in two packs comes twice.

    Options: `path`; `types`, a list like "commit,tree"; `max_bytes`, beyond which contents are
    null; `split_bytes` of a pack for a task.
    """

    @classmethod
    def name(cls) -> str:
        return "git"

    def schema(self) -> str:
        return "oid string, type string, size long, content binary"

    def reader(self, schema) -> ObjectReader:
        return ObjectReader(self.options)


class RefReader(DataSourceReader):
    def __init__(self, options: dict):
        self.path = options["path"]

    def read(self, partition) -> Iterator[tuple]:
        store, path = store_of(self.path)
        base = _git_dir(store, path)
        found: dict[str, str] = {}
        for line in _text(store, f"{base}/packed-refs").splitlines():
            if m := re.fullmatch(r"([0-9a-f]{40}) (\S.*)", line):
                found[m[2]] = m[1]
        for f in _listed(store, f"{base}/refs", deep=True):
            if f.type == fs.FileType.File:
                found[f.path[len(base) + 1 :]] = _text(store, f.path).strip()
        found["HEAD"] = _text(store, f"{base}/HEAD").strip()
        for name in sorted(found):
            value, target = found[name], None
            for _ in range(5):  # a reference may name another one
                if not (value or "").startswith("ref: "):
                    break
                target = value[5:]
                value = found.get(target, "")
            yield name, value if re.fullmatch("[0-9a-f]{40}", value or "") else None, target


class GitRefs(DataSource):
    """(name, oid, target): HEAD, branches and tags; loose references stand before packed ones."""

    @classmethod
    def name(cls) -> str:
        return "git_refs"

    def schema(self) -> str:
        return "name string, oid string, target string"

    def reader(self, schema) -> RefReader:
        return RefReader(self.options)


def register(spark) -> None:
    """Makes both formats known to a session."""
    spark.dataSource.register(GitObjects)
    spark.dataSource.register(GitRefs)


def object_id(kind: str, content: bytes) -> str:
    """The id by which an object is stored."""
    return hashlib.sha1(f"{kind} {len(content)}".encode() + b"\0" + content).hexdigest()
