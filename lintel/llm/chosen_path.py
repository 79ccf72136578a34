"""Jaccard join of word shingles by chosen paths.

Texts with equal shingle sets form one class from the start. Of each class one
set goes through several independent runs, as many as the wanted recall takes. A
run splits a set over a tree: at a node of the tree each of the set's tokens is
chosen when its hash, seeded by the path to the node, is below 1 / (threshold x
size). Two sets with the wanted similarity share a chosen token once per node on
average or more, so a path they share survives a number of levels in a known part
of the runs, while sets without common tokens part at once.

All sets are split DEPTH times; sets that meet at a node are a bucket there. In a
bucket, sketches of 256 one-bit min-hashes are compared by brute force, set by set,
each against those not yet reached, so that a bucket of near copies costs a few
passes and gives a spanning tree of links instead of all pairs. A bucket that is
not done after EFFORT comparisons a set is a large one of unlike sets: what is left
of it is split again, level by level, until its buckets are small; at LAST levels
they are compared by pairs of chunks, each in a task of its own.

The components of the links are candidate groups, small supersets of the true
ones. Each group's texts are brought together once and compared exactly, in blocks
of bounded size: a group above one block is dealt as pairs of blocks, each on its
own. That yields exact link counts and, again, spanning trees, whose components are
the classes of the result.

Hashes are 64 bits wide, so that at n distinct shingles equal hashes of unequal
ones are expected n^2 / 2^65 times.
"""

from __future__ import annotations

import math
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm import common
from lintel.llm.common import mix64, pack, unpack
from lintel.llm.components import components, spanning_stars

WORDS = 5
THRESHOLD = 0.8
DEPTH, LAST = 3, 8
#: The chance to bring a pair at the threshold together that the number of runs is for.
RECALL = 0.995
#: Comparisons for each set of a bucket before it is split again.
EFFORT = 512
#: Sets that are split again up to which they are sent to the texts instead of the texts to them.
SENT = 100_000
#: Agreeing bits of 256 that make a pair a candidate: 4.5 deviations below what similarity 0.8 gives.
SKETCH_WORDS, SKETCH_LEAST = 4, 202
#: Texts in a block of exact comparison.
BLOCK = 1024
_MULT = mix64(np.arange(1, 80, dtype=np.uint64) * np.uint64(0xD1B54A32D192ED03)) | np.uint64(1)


def survival(threshold: float = THRESHOLD, depth: int = DEPTH) -> float:
    """The least chance that one run brings a pair at the threshold together.

    Their common tokens are each chosen with probability 1 / (threshold x size of
    the larger set), so a node they share has about one or more shared children.
    """
    q = 1.0
    for _ in range(depth):
        q = 1 - math.exp(-q)
    return q


def runs_for(recall: float, threshold: float = THRESHOLD, depth: int = DEPTH) -> int:
    """Runs until pairs at the threshold are found with this probability."""
    return math.ceil(math.log(1 - recall) / math.log(1 - survival(threshold, depth)))


RUNS = runs_for(RECALL)


def shingles_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes, text of each), by text and ascending.

    A shingle is five consecutive words, lower-cased; a text of one to four words
    has one shingle, all its words.
    """
    values, row = common.words_of(pa.compute.utf8_lower(pa.compute.fill_null(texts, "")))
    if not len(row):
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    codes, words = common.codes_of(values)
    h = mix64(pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False))[codes]
    n = len(h)
    ends = np.searchsorted(row, row, side="right")
    out = np.zeros(n, np.uint64)
    for k in range(WORDS):
        inside = np.arange(n) + k < ends
        out += np.where(inside, h[np.minimum(np.arange(n) + k, n - 1)] * _MULT[k], np.uint64(0))
    size = np.bincount(row, minlength=len(texts))
    first = np.concatenate([[True], row[1:] != row[:-1]])
    keep = (ends - np.arange(n) >= WORDS) | (first & (size[row] < WORDS))
    out, row = mix64(out[keep]), row[keep]
    order = np.argsort(out, kind="quicksort")
    order = order[np.argsort(row[order], kind="stable")]
    out, row = out[order], row[order]
    new = np.concatenate([[True], (out[1:] != out[:-1]) | (row[1:] != row[:-1])])
    return out[new], row[new]


def _starts(row: np.ndarray, n: int) -> np.ndarray:
    return np.searchsorted(row, np.arange(n + 1))


def set_hash(token: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Two 64-bit sums that tell sets apart, and the sizes, as (n, 3) integers."""
    at = _starts(row, n)
    out = np.zeros((n, 3), np.int64)
    for c in range(2):
        total = np.zeros(len(token) + 1, np.uint64)
        np.cumsum(mix64(token ^ _MULT[20 + c]), out=total[1:])
        out[:, c] = (total[at[1:]] - total[at[:-1]]).view(np.int64)
    out[:, 2] = np.diff(at)
    return out


def sketches(token: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """256 bits of each set: of min-hash i, one bit."""
    at = _starts(row, n)
    full = np.flatnonzero(np.diff(at))
    out = np.zeros((n, SKETCH_WORDS), np.uint64)
    if not len(full):
        return out
    low = (token >> np.uint64(32)).astype(np.uint32) | np.uint32(1)
    high = token.astype(np.uint32)
    for i in range(64 * SKETCH_WORDS):
        a = np.uint32(int(mix64(np.array([2 * i + 1], np.uint64))[0] & np.uint64(0xFFFFFFFF)) | 1)
        least = np.minimum.reduceat((high ^ a) * low * a, at[:-1][full])
        least ^= least >> np.uint32(15)
        least *= np.uint32(0x2C1B3C6D)
        out[full, i // 64] |= (least >> np.uint32(31)).astype(np.uint64) << np.uint64(i % 64)
    return out


def _limits(size: np.ndarray) -> np.ndarray:
    """Up to which hash a token of a set of each size is chosen."""
    limit = np.full(len(size), np.iinfo(np.uint64).max, np.uint64)
    many = size > 1
    limit[many] = (2.0**64 / np.maximum(THRESHOLD * size[many], 1.0000001)).astype(np.uint64)
    return limit


def split(token: np.ndarray, at: np.ndarray, owner: np.ndarray, path: np.ndarray, depth) -> tuple[np.ndarray, np.ndarray]:
    """(set, path) one level below each (set, path); `at` has where the sets' tokens begin, `depth` the level they are at."""
    size = np.diff(at)
    limit = _limits(size)
    count = size[owner]
    which = np.repeat(np.arange(len(owner)), count)
    t = token[np.arange(len(which)) - np.repeat(np.cumsum(count) - count - at[owner], count)]
    chosen = mix64(t ^ path[which]) <= limit[owner][which]
    t, which = t[chosen], which[chosen]
    level = np.broadcast_to(np.asarray(depth, np.uint64) + np.uint64(1), len(owner))[which]
    return owner[which], mix64((path[which] + level) ^ t * _MULT[2])


def paths_of(token: np.ndarray, row: np.ndarray, n: int, runs: int = RUNS) -> tuple[np.ndarray, np.ndarray]:
    """(set, path) of each path of DEPTH levels that each set takes in all runs; a path is a 64-bit hash."""
    at = _starts(row, n)
    owners, paths = [], []
    for r in range(runs):
        owner = np.flatnonzero(np.diff(at))
        path = np.full(len(owner), int(_MULT[40 + r]), np.uint64)
        for depth in range(DEPTH):
            owner, path = split(token, at, owner, path, depth)
        owners.append(owner)
        paths.append(path)
    return np.concatenate(owners), np.concatenate(paths)


def bucket_links(sketch: np.ndarray, effort: int | None = None) -> tuple[list[tuple[int, int]], np.ndarray]:
    """(a spanning forest of the pairs of a bucket whose sketches agree enough, sets that are not done).

    Each set reached is compared with all not yet reached, as one matrix row. With
    `effort`, the walk ends after so many comparisons for each set; those whose
    pairs were not all compared are handed back.
    """
    links, left, done = [], np.arange(len(sketch)), 0
    most = None if effort is None else effort * len(sketch)
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            if most is not None and done > most:
                return links, np.concatenate([left, np.array(queue, np.int64)])
            x = queue.pop()
            done += len(left)
            same = 64 * SKETCH_WORDS - np.bitwise_count(sketch[left] ^ sketch[x]).sum(1, dtype=np.int64)
            near = same >= SKETCH_LEAST
            links += [(x, int(y)) for y in left[near]]
            queue += left[near].tolist()
            left = left[~near]
    return links, np.zeros(0, np.int64)


def _sparse_common(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    """The numbers of common tokens of the sets of two blocks, by dense strips of shared tokens."""
    sets = [*a, *b]
    token = np.concatenate(sets) if sets else np.zeros(0, np.uint64)
    owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    code, distinct = pd.factorize(token)
    n = len(distinct)
    left = np.bincount(code[owner < len(a)], minlength=n)
    right = np.bincount(code[owner >= len(a)], minlength=n)
    shared = np.flatnonzero((left > 0) & (right > 0))
    place = np.full(n, -1)
    place[shared] = np.arange(len(shared))
    column = place[code]
    owner, column = owner[column >= 0], column[column >= 0]
    order = np.argsort(column, kind="stable")
    owner, column = owner[order], column[order]
    out = np.zeros((len(a), len(b)), np.float32)
    for lo in range(0, len(shared), 4096):
        i, j = np.searchsorted(column, [lo, lo + 4096])
        m = np.zeros((len(sets), 4096), np.float32)
        m[owner[i:j], column[i:j] - lo] = 1
        out += m[: len(a)] @ m[len(a) :].T
    return out


def _spanning(near: np.ndarray) -> list[tuple[int, int]]:
    """A spanning forest of a bipartite adjacency matrix, as (row, column) pairs."""
    rows, columns = near.shape
    seen_r, seen_c, out = np.zeros(rows, bool), np.zeros(columns, bool), []
    for r in range(rows):
        if seen_r[r] or not near[r].any():
            continue
        seen_r[r] = True
        queue = [(0, r)]
        while queue:
            side, x = queue.pop()
            if side == 0:
                new = np.flatnonzero(near[x] & ~seen_c)
                seen_c[new] = True
                out += [(x, int(y)) for y in new]
                queue += [(1, int(y)) for y in new]
            else:
                new = np.flatnonzero(near[:, x] & ~seen_r)
                seen_r[new] = True
                out += [(int(y), x) for y in new]
                queue += [(0, int(y)) for y in new]
    return out


def exact_links(a_sets, b_sets, same: bool) -> np.ndarray:
    """Which pairs of two blocks have the similarity; integers decide, so there is no rounding."""
    both = _sparse_common(a_sets, b_sets).astype(np.int64)
    total = np.array([len(s) for s in a_sets])[:, None] + np.array([len(s) for s in b_sets])[None, :] - both
    near = (10 * both >= round(10 * THRESHOLD) * total) & (both > 0)
    if same:
        np.fill_diagonal(near, False)
    return near


def near_groups(docs: DataFrame, id_col: str = "doc_id", text: str = "text", runs: int = RUNS, block: int = BLOCK) -> DataFrame:
    """One row per row with an id: id, `class_id`, `n_links`.

    `class_id` is the smallest id of the texts connected by similarity 0.8 or more
    of their sets of five-word shingles; `n_links` counts the other rows with at
    least this similarity to the row. Texts without a word (null, empty, blank) are
    linked to nothing. Rows without an id are left out. Rows of one id and unlike
    texts get rows of their own, in the class of the rows of that id, if their
    classes meet. An id that is no integer counts as missing. An empty table gives
    an empty one. Other columns are left out.
    """
    spark = docs.sparkSession
    common.ship(spark)
    n = common.partitions(spark)
    src = docs.select(docs[f"`{id_col}`"].try_cast("long").alias("i"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("t")).where("i IS NOT NULL")

    def set_keys(batches):
        for batch in batches:
            for part in common.pieces(batch, "t"):
                token, row = shingles_of(part.column("t"))
                h = set_hash(token, row, part.num_rows)
                yield pa.RecordBatch.from_arrays([part.column("i"), *(pa.array(h[:, c].copy()) for c in range(3))], ["i", "h1", "h2", "size"])

    keys = common.checkpoint(src.mapInArrow(set_keys, "i long, h1 long, h2 long, size long"))
    classes = keys.where("size > 0").groupBy("h1", "h2", "size").agg(F.min("i").alias("rep"), F.count("*").alias("members"))
    classes = common.checkpoint(classes)
    # an id may stand for several classes when it comes with several texts: the set hash is the node
    first = src.join(classes.select(F.col("rep").alias("i")).distinct(), "i", "left_semi")

    LINKS, AGAIN, CHUNKS = range(3)

    def to_nodes(names, bits, owner, path, depth: int) -> pa.RecordBatch:
        """Sets and the nodes they are at, by the node's shard; a set's sketch goes once to a shard."""
        shard = (mix64(path) % np.uint64(n)).astype(np.uint32)
        order = np.lexsort((owner, shard))
        out = []
        for r in common.runs_of(shard[order]):
            part = order[r]
            which, place = np.unique(owner[part], return_inverse=True)
            out.append((depth, int(shard[part[0]]), pack(names[which], bits[which], place.reshape(-1).astype(np.uint32), path[part])))
        return common.parcel_batch(out)

    def leaves(batches):
        node, held, sk = [], [], []
        base = 0
        for batch in batches:
            for part in common.pieces(batch, "t"):
                token, row = shingles_of(part.column("t"))
                rows = part.num_rows
                owner, path = paths_of(token, row, rows, runs)
                node.append(set_hash(token, row, rows)[:, 0].copy())
                sk.append(sketches(token, row, rows))
                held.append((owner + base, path))
                base += rows
                if base > 50_000:
                    yield to_nodes(np.concatenate(node), np.concatenate(sk), *(np.concatenate([h[k] for h in held]) for k in range(2)), DEPTH)
                    node, held, sk, base = [], [], [], 0
        if base and sum(len(h[0]) for h in held):
            yield to_nodes(np.concatenate(node), np.concatenate(sk), *(np.concatenate([h[k] for h in held]) for k in range(2)), DEPTH)

    def meet(batches):
        """Links as parcels of stars; sets of buckets that must be split again; chunks of those that cannot."""
        got, depth = [], DEPTH
        for batch in batches:
            for kind, p in zip(batch.column("kind").to_pylist(), batch.column("parcel").to_pylist()):
                got.append(unpack(p))
                depth = kind
        if not got:
            return
        base = np.cumsum([0, *(len(g[0]) for g in got)])
        names, bits = (np.concatenate([g[k] for g in got]) for k in range(2))
        owner = np.concatenate([g[2].astype(np.int64) + b for g, b in zip(got, base)])
        path = np.concatenate([g[3] for g in got])
        order = np.lexsort((names[owner], path))
        owner, path = owner[order], path[order]
        first = np.flatnonzero(np.concatenate([[True], path[1:] != path[:-1]]))
        size = np.diff(np.append(first, len(path)))
        u, v, done = [], [], set()
        for at, m in zip(first[size > 1].tolist(), size[size > 1].tolist()):
            members = np.unique(names[owner[at : at + m]], return_index=True)
            if len(members[0]) < 2:
                continue
            mark = hash(members[0].tobytes())
            if (mark, len(members[0])) in done:  # the same sets met at another node
                continue
            done.add((mark, len(members[0])))
            own = owner[at : at + m][members[1]]
            links, rest = bucket_links(bits[own], EFFORT)
            u += [names[own[x]] for x, _ in links]
            v += [names[own[y]] for _, y in links]
            if len(rest) and depth < LAST:
                yield common.parcel_batch([(AGAIN, depth, pack(names[own[rest]], np.full(len(rest), path[at])))])
            elif len(rest):
                own = own[rest]
                parts = [own[k : k + block] for k in range(0, len(own), block)]
                for x in range(len(parts)):
                    for y in range(x, len(parts)):
                        both = parts[x] if x == y else np.concatenate([parts[x], parts[y]])
                        to = int(mix64(path[at : at + 1] + np.uint64(65537 * x + y))[0] % np.uint64(n))
                        yield common.parcel_batch([(CHUNKS, to, pack(names[both], bits[both]))])
        x, y = spanning_stars(np.array(u, np.int64), np.array(v, np.int64))
        yield common.parcel_batch([(LINKS, 0, pack(x, y))])

    def meet_chunks(batches):
        for batch in batches:
            for p in batch.column("parcel").to_pylist():
                names, bits = unpack(p)
                links, _ = bucket_links(bits)
                u, v = (np.array([names[link[k]] for link in links], np.int64) for k in range(2))
                yield common.parcel_batch([(LINKS, 0, pack(*spanning_stars(u, v)))])

    def nodes(batches):
        for batch in batches:
            for p in batch.column("parcel").to_pylist():
                name, path = unpack(p)
                yield pa.RecordBatch.from_arrays([pa.array(name), pa.array(path.view(np.int64))], ["h1", "path"])

    def deeper(batches, depth: int):
        """The next level of the nodes that sets are asked to leave."""
        for batch in batches:
            for part in common.pieces(batch, "t"):
                token, row = shingles_of(part.column("t"))
                rows = part.num_rows
                asked = part.column("paths").combine_chunks() if isinstance(part.column("paths"), pa.ChunkedArray) else part.column("paths")
                owner = np.repeat(np.arange(rows), np.diff(np.asarray(asked.offsets)))
                path = asked.flatten().to_numpy().view(np.uint64)
                owner, path = split(token, _starts(row, rows), owner, path, depth)
                if len(owner):
                    yield to_nodes(set_hash(token, row, rows)[:, 0].copy(), sketches(token, row, rows), owner, path, depth + 1)

    level = first.mapInArrow(leaves, common.PARCEL_DDL)
    met = None
    for depth in range(DEPTH, LAST + 1):
        now = common.checkpoint(level.repartitionById(n, F.col("to")).mapInArrow(meet, common.PARCEL_DDL))
        met = now if met is None else met.unionByName(now)
        again = now.where(F.col("kind") == AGAIN)
        if depth == LAST or again.isEmpty():
            break
        asked = again.mapInArrow(nodes, "h1 long, path long").join(classes.select("h1", "rep"), "h1").groupBy("rep").agg(F.collect_set("path").alias("paths"))
        asked = common.checkpoint(asked)
        if asked.count() <= SENT:  # a node or two each, so some megabytes at most
            asked = F.broadcast(asked)
        level = src.join(asked, src["i"] == asked["rep"]).select("t", "paths").mapInArrow(partial(deeper, depth=depth), common.PARCEL_DDL)
    chunks = met.where(F.col("kind") == CHUNKS).repartitionById(n, F.col("to")).mapInArrow(meet_chunks, common.PARCEL_DDL)

    def as_rows(batches):
        for batch in batches:
            for p in batch.column("parcel").to_pylist():
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(p)], ["u", "v"])

    links = met.where(F.col("kind") == LINKS).unionByName(chunks).mapInArrow(as_rows, "u long, v long")
    groups = components(links)  # of set hashes
    groups = groups.unionByName(groups.select(F.col("root").alias("node"), "root").distinct())
    held = classes.join(groups, classes["h1"] == groups["node"]).select("root", "h1", "rep", "members")
    held = common.checkpoint(held)
    # a group's sets get blocks by their hash: about `block` in each
    sizes = held.groupBy("root").agg(F.greatest(F.lit(1), F.ceil(F.count("*") / block)).cast("int").alias("blocks"))
    dealt = held.join(sizes, "root").withColumn("part", F.pmod(F.xxhash64("h1"), F.col("blocks")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))
    to_pairs = dealt.select("root", "h1", "rep", "members", "part", "blocks", other.alias("with"))
    to_pairs = to_pairs.select("root", "h1", "rep", "members", "part", "blocks", F.least("part", "with").alias("x"), F.greatest("part", "with").alias("y"))
    # one text of each class, then to every pair of blocks its block is in
    texts = src.join(held.select(F.col("rep").alias("i")).distinct(), "i", "left_semi")
    brought = to_pairs.join(texts, to_pairs["rep"] == texts["i"]).select("root", "x", "y", "part", "blocks", "h1", "members", "t")
    # groups of one block are gathered in bins, a pair of blocks of a larger one stands alone
    bin_ = F.pmod(F.xxhash64("root"), F.lit(8 * n))
    blocks = brought.withColumn("g", F.when(F.col("blocks") == 1, bin_).otherwise(F.xxhash64("root", "x", "y").bitwiseOR(F.lit(1 << 62)))).drop("blocks")

    def compare(table: pa.Table) -> pa.Table:
        """All block pairs of a bin: exact links as counts, and a spanning forest."""
        table = table.combine_chunks()
        token, row = [], []
        base = 0
        for batch in table.to_batches():
            for part in common.pieces(batch, "t"):
                t, r = shingles_of(part.column("t"))
                token.append(t)
                row.append(r + base)
                base += part.num_rows
        token, row = np.concatenate(token), np.concatenate(row)
        at = _starts(row, base)
        own = set_hash(token, row, base)[:, 0]
        h1, members = table.column("h1").to_numpy(), table.column("members").to_numpy()
        good = own == h1  # an id may come with another text, whose set this is not
        root, x, y, part = (table.column(c).to_numpy() for c in ("root", "x", "y", "part"))
        order = np.lexsort((h1, part, y, x, root))
        order = order[good[order]]
        if not len(order):
            return pa.table({c: pa.array([], pa.int64()) for c in "uvn"})
        key = np.stack([root[order], x[order], y[order], part[order], h1[order]])
        new = np.concatenate([[True], (key[:, 1:] != key[:, :-1]).any(0)])  # repeated rows of one text
        order = order[new]
        cuts = np.flatnonzero((np.diff(np.stack([root[order], x[order], y[order]])) != 0).any(0)) + 1
        out: tuple[list, list, list] = ([], [], [])
        for group in np.split(order, cuts):
            if not len(group):
                continue
            one = x[group[0]] == y[group[0]]
            a = group[part[group] == x[group[0]]]
            b = a if one else group[part[group] == y[group[0]]]
            if not len(a) or not len(b):
                continue
            sets = lambda g: [token[at[k] : at[k + 1]] for k in g]
            near = exact_links(sets(a), sets(b), one)
            for g, count in ((a, near @ members[b]),) if one else ((a, near @ members[b]), (b, members[a] @ near)):
                hit = np.flatnonzero(count)
                out[0].extend(h1[g[hit]].tolist())
                out[1].extend([None] * len(hit))
                out[2].extend(count[hit].tolist())
            for p, q in _spanning(near):
                out[0].append(int(h1[a[p]]))
                out[1].append(int(h1[b[q]]))
                out[2].append(0)
        return pa.table({"u": pa.array(out[0], pa.int64()), "v": pa.array(out[1], pa.int64()), "n": pa.array(out[2], pa.int64())})

    compared = common.checkpoint(blocks.groupBy("g").applyInArrow(compare, "u long, v long, n long"))
    counts = compared.where("v IS NULL").groupBy(F.col("u").alias("h1")).agg(F.sum("n").alias("links"))
    joined = components(compared.where("v IS NOT NULL").select("u", "v")).withColumnsRenamed({"node": "h1", "root": "top"})
    known = classes.join(joined, "h1", "left").join(counts, "h1", "left").withColumn("top", F.coalesce("top", "h1"))
    lowest = known.groupBy("top").agg(F.min("rep").alias("class_id"))
    known = known.join(lowest, "top").select("h1", "h2", "size", "class_id", (F.col("members") - 1 + F.coalesce("links", F.lit(0))).alias("links"))
    out = keys.join(known, ["h1", "h2", "size"], "left")
    return out.select(F.col("i").alias(id_col), F.coalesce("class_id", "i").alias("class_id"), F.coalesce("links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text: str = "text", runs: int = RUNS) -> DataFrame:
    """The rows of `docs` with one of each group left, that with the smallest id.

    Rows without an id stay; of rows that repeat an id one text each stays.
    """
    groups = near_groups(docs, id_col, text, runs)
    gone = groups.where(F.col("class_id") < F.col(id_col)).select(F.col(id_col).alias("__gone")).distinct()
    return docs.join(gone, docs[f"`{id_col}`"] == gone["__gone"], "left_anti")
