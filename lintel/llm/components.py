"""Connected components of a graph given as an edge table, by hooking and jumping.

Each partition hands in spanning stars of its own components. From then on every
node has one owner, a shard of some SHARD_EDGES edges, which keeps one parent for
it, a smaller node of its component. In a round a shard contracts what it holds
and was sent: its nodes take the smallest node in reach as parent, and of two
parents the larger is hooked to the smaller by an edge to its owner; then parents
are asked for theirs, once a shard, and nodes jump there. The rounds end when no
parent changes and no edge is left. A node with many neighbours is a parent in many
shards, and is never brought together with them.

Edges travel as parcels. The number of shards follows the number of edges, so that
a small graph takes a few tasks and a large one many; the steps are the same.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm import common
from lintel.llm.common import mix64, pack, unpack

#: Edges of a shard, in the mean.
SHARD_EDGES = 1 << 18
_OWN, _EDGE, _ASK, _ANSWER = range(4)
_DDL = "kind int, to int, parcel binary, moved long"


def spanning_stars(u: np.ndarray, v: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(node, smallest node of its component) without the smallest nodes themselves."""
    node, code = np.unique(np.concatenate([u, v]), return_inverse=True)
    a, b = np.split(code.reshape(-1), 2)
    up = np.arange(len(node))
    while True:  # hook roots to smaller neighbours' roots, then shorten all paths
        x, y = up[a], up[b]
        high, low = np.maximum(x, y), np.minimum(x, y)
        apart = high != low
        if not apart.any():
            break
        np.minimum.at(up, high[apart], low[apart])
        while True:
            short = up[up]
            if (short == up).all():
                break
            up = short
    own = np.flatnonzero(up != np.arange(len(node)))
    return node[own], node[up[own]]


def owner_of(node: np.ndarray, n: int) -> np.ndarray:
    """The shard of each node."""
    return (mix64(node.view(np.uint64)) % np.uint64(n)).astype(np.int32)


def _rows(rows: list[tuple[int, int, bytes, int]]) -> pa.RecordBatch:
    kinds = (pa.int32(), pa.int32(), pa.binary(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array([r[c] for r in rows], t) for c, t in enumerate(kinds)], ["kind", "to", "parcel", "moved"])


def _dealt(kind: int, n: int, *arrays):
    """Parcels of arrays by the owner of the first one's nodes."""
    to = owner_of(arrays[0], n)
    order = np.argsort(to, kind="stable")
    return [(kind, int(to[order[r.start]]), pack(*(a[order[r]] for a in arrays)), 0) for r in common.runs_of(to[order])]


def _parent(node: np.ndarray, parent: np.ndarray, asked: np.ndarray) -> np.ndarray:
    """The parents of nodes by a sorted table, the nodes themselves where it has none."""
    if not len(node):
        return asked
    at = np.minimum(np.searchsorted(node, asked), len(node) - 1)
    return np.where(node[at] == asked, parent[at], asked)


def _received(batches) -> tuple[int | None, dict[int, list]]:
    """(the shard, parcels by kind) of one partition."""
    shard, got = None, {k: [] for k in (_OWN, _EDGE, _ASK, _ANSWER)}
    for batch in batches:
        for kind, to, p in zip(*(batch.column(c).to_pylist() for c in ("kind", "to", "parcel"))):
            shard = to
            got[kind].append(unpack(p))
    return shard, got


def _column(parts: list, c: int) -> np.ndarray:
    return np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, np.int64)


def _contract(n: int):
    """A round's first step: answers and edges are taken in, larger parents hooked, parents asked."""

    def run(batches):
        shard, got = _received(batches)
        if shard is None:
            return
        node, parent = _column(got[_OWN], 0), _column(got[_OWN], 1)
        m, g = _column(got[_ANSWER], 0), _column(got[_ANSWER], 1)
        order = np.argsort(m, kind="stable")
        jumped = _parent(m[order], g[order], parent)
        x, y = spanning_stars(np.concatenate([node, _column(got[_EDGE], 0)]), np.concatenate([jumped, _column(got[_EDGE], 1)]))
        mine = owner_of(x, n) == shard
        order = np.argsort(node)
        was = _parent(node[order], parent[order], x[mine])
        moved = int((was != y[mine]).sum() + (~mine).sum())
        out = [(_OWN, shard, pack(x[mine], y[mine]), moved)]
        out += _dealt(_EDGE, n, x[~mine], y[~mine])
        away = common.distinct(y[mine])
        away = away[owner_of(away, n) != shard]
        out += _dealt(_ASK, n, away, np.full(len(away), shard))
        yield _rows(out)

    return run


def _answer(n: int):
    """A round's second step: those asked for their parents tell them; the rest is passed on."""

    def run(batches):
        shard, got = _received(batches)
        if shard is None:
            return
        node, parent = _column(got[_OWN], 0), _column(got[_OWN], 1)
        out = [(_OWN, shard, pack(node, parent), 0)]
        out += [(_EDGE, shard, pack(*p), 0) for p in got[_EDGE]]
        asked, by = _column(got[_ASK], 0), _column(got[_ASK], 1)
        order = np.argsort(node)
        up = _parent(node[order], parent[order], asked)
        for s in np.unique(by[up != asked]):
            at = (by == s) & (up != asked)
            out.append((_ANSWER, int(s), pack(asked[at], up[at]), 0))
        yield _rows(out)

    return run


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node of the `u`, `v` edges, root being the component's smallest node.

    Self-links, repeated edges and either direction are fine, rows with a null
    are no edges; nodes without an edge to another node do not appear.
    """

    def stars(batches):
        u, v = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for batch in batches:
            u.append(batch.column("u").to_numpy())
            v.append(batch.column("v").to_numpy())
        x, y = spanning_stars(np.concatenate(u), np.concatenate(v))
        if len(x):
            yield _rows([(_EDGE, 0, pack(x, y), len(x))])

    edges = edges.select("u", "v").where("u IS NOT NULL AND v IS NOT NULL AND u <> v")
    held = common.checkpoint(edges.mapInArrow(stars, _DDL))
    count = held.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]
    n = max(1, -(-count // SHARD_EDGES))

    def deal(batches):
        for batch in batches:
            for p in batch.column("parcel").to_pylist():
                yield _rows(_dealt(_EDGE, n, *unpack(p)))

    held = held.coalesce(n).mapInArrow(deal, _DDL)  # many partitions of a small graph would cost more than they do
    while True:
        held = common.checkpoint(held.repartitionById(n, F.col("to")).mapInArrow(_contract(n), _DDL))
        if n == 1 or not held.agg(F.coalesce(F.sum("moved"), F.lit(0))).first()[0]:
            break
        held = held.repartitionById(n, F.col("to")).mapInArrow(_answer(n), _DDL)

    def told(batches):
        for batch in batches:
            for p in batch.column("parcel").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(p)], ["node", "root"])

    return held.where(F.col("kind") == _OWN).select("parcel").mapInArrow(told, "node long, root long")
