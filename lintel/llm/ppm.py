"""Language-model scoring by prediction by partial matching.

A byte-context trie of order 5 is trained on the lower-cased bytes of the
training texts, each between a start of five NULs and an end symbol NUL, and gives
every text its log10 probability. In a context of order k a symbol seen there has
n / (T + D) and the escape to order k - 1 has D / (T + D) (method C; T is the
symbols' count and D how many differ), where the symbols already offered by the
longer context are excluded from both. Below order 0 the 256 - D bytes that were
never seen share the rest.

A byte's probability depends only on the six bytes that end at it, so a block of
texts needs each distinct six-gram once. Blocks send their grams and training
counts to shards by the last two context bytes, which puts all nodes of orders 2
to 5 that a gram can meet into one shard; orders 0 and 1 have at most 65,536
nodes and are broadcast. Contexts of two bytes that are frequent are split by the
third byte; their nodes of order 2, counted over everything, are at most HEAVY x
256 and are broadcast, too. Which ones are frequent is taken from SAMPLE texts: that
decides where work is done, not what comes out. Shards sum the counts, build their
part of the trie and answer each block in the order it asked. Words take the same
way, by hash, for the base score's counts. No table of the corpus is broadcast,
collected or held whole.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm import common
from lintel.llm.common import mix64, pack, unpack

ORDER = 5
#: Contexts of two bytes that are split at most, the share of all bytes from which on, and the texts that this is taken from.
HEAVY, HEAVY_SHARE, SAMPLE = 256, 0.001, 1000
END_WORD = "\n"  # cannot be a word, so it stands for the end token
_UPPER = np.arange(256, dtype=np.uint8)
_UPPER[65:91] += 32


def grams_of(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The six-gram that ends at each byte and at each text's end symbol, and where each text's begin.

    A gram is an integer: the symbol in its low byte, the context above it, the
    nearest byte lowest. Texts start after five NULs.
    """
    n = len(off) - 1
    size = np.diff(off)
    gap = ORDER + 1  # five NULs before each text; the end symbol is the first of the next text's gap
    stream = np.zeros(int(off[-1]) + n * gap + gap, np.uint8)
    start = off[:-1] + np.arange(n) * gap + ORDER
    which = np.repeat(start - off[:-1], size)
    stream[np.arange(len(buf)) + which] = _UPPER[buf]
    # eight bytes from each place, the first highest; of these the first six are the gram of the sixth
    wide = np.empty((len(stream) + 7) // 8 * 8, np.uint64)
    padded = np.concatenate([stream, np.zeros(16, np.uint8)])
    for k in range(8):
        wide[k::8] = padded[k : k + len(wide)].view(">u8")
    begin = np.zeros(n + 1, np.int64)
    np.cumsum(size + 1, out=begin[1:])
    real = np.repeat(start - ORDER - begin[:-1], size + 1)
    return wide[np.arange(int(begin[-1])) + real] >> np.uint64(8 * (7 - ORDER)), begin


def shard_of_gram(gram: np.ndarray, n: int, heavy: np.ndarray | None = None) -> np.ndarray:
    """The shard by two context bytes, or three where `heavy` (a flag for each two) says so."""
    context = gram >> np.uint64(8)
    two = context & np.uint64(0xFFFF)
    if heavy is not None:
        three = heavy[two.astype(np.int64)]
        two[three] = (context[three] & np.uint64(0xFFFFFF)) + np.uint64(1 << 24)
    return (mix64(two) % np.uint64(n)).astype(np.uint32)


def heavy_contexts(count: np.ndarray, most: int = HEAVY, share: float = HEAVY_SHARE) -> np.ndarray:
    """A flag for each two context bytes: the most frequent ones above a share."""
    out = np.zeros(65536, bool)
    top = np.argsort(-count, kind="stable")[:most]
    out[top] = count[top] > share * max(1, count.sum())
    return out


def shard_of_word(words: pa.Array, n: int) -> np.ndarray:
    return (pd.util.hash_array(words.to_numpy(zero_copy_only=False), categorize=False) % np.uint64(n)).astype(np.uint32)


class Node:
    """The contexts of one order in a shard: sorted, with T, D and what exclusion leaves of the parent."""

    def __init__(self, gram: np.ndarray, count: np.ndarray):
        self.gram, self.count = gram, count  # context << 8 | symbol, ascending
        context = gram >> np.uint64(8)
        first = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]])) if len(gram) else np.zeros(0, np.int64)
        self.context = context[first]
        self.total = np.add.reduceat(count, first) if len(first) else np.zeros(0, np.int64)
        self.distinct = np.diff(np.append(first, len(gram)))
        self.first = first

    @staticmethod
    def find(sorted_: np.ndarray, x: np.ndarray) -> np.ndarray:
        """Places of x in a sorted array, -1 where absent."""
        if not len(sorted_):
            return np.full(len(x), -1)
        at = np.minimum(np.searchsorted(sorted_, x), len(sorted_) - 1)
        return np.where(sorted_[at] == x, at, -1)


def shortened(gram: np.ndarray, order: int) -> np.ndarray:
    """The gram with a context of `order` bytes."""
    return gram & np.uint64((1 << 8 * (order + 1)) - 1)


def merged(gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct grams, ascending, with their counts."""
    order = np.argsort(gram)
    gram, count = gram[order], count[order]
    first = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]])) if len(gram) else np.zeros(0, np.int64)
    return gram[first], np.add.reduceat(count, first) if len(first) else count


def summed(gram: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The same without grams that were never trained on."""
    gram, count = merged(gram, count)
    return gram[count > 0], count[count > 0]


class Trie:
    """Orders 2 to 5 from a shard's grams; orders 0 and 1 as given for all, and those of order 2 that `whole` has (grams, counts)."""

    def __init__(self, gram: np.ndarray, count: np.ndarray, low: np.ndarray, whole=None, heavy: np.ndarray | None = None):
        low_gram = np.flatnonzero(low.reshape(-1)).astype(np.uint64)
        root = low.sum(0)
        seen = np.flatnonzero(root).astype(np.uint64)
        self.nodes = [Node(seen, root[seen.astype(np.int64)]), Node(low_gram, low.reshape(-1)[low_gram.astype(np.int64)])]
        for order in range(2, ORDER + 1):
            own, n = summed(shortened(gram, order), count)
            if order == 2 and whole is not None:
                light = ~heavy[(own >> np.uint64(8)).astype(np.int64)]
                own, n = summed(np.concatenate([own[light], whole[0]]), np.concatenate([n[light], whole[1]]))
            self.nodes.append(Node(own, n))
        self.left: list = [None]  # by order: (T, D) of the parent without the symbols of the node
        for order in range(1, ORDER + 1):
            node, parent = self.nodes[order], self.nodes[order - 1]
            above = Node.find(parent.gram, shortened(node.gram, order - 1))
            used = np.add.reduceat(parent.count[above], node.first) if len(node.first) else np.zeros(0, np.int64)
            up = Node.find(parent.context, node.context & np.uint64((1 << 8 * (order - 1)) - 1))
            self.left.append((parent.total[up] - used, parent.distinct[up] - node.distinct))

    def log10(self, gram: np.ndarray) -> np.ndarray:
        """The log10 probability of each gram's symbol after its context."""
        out = np.zeros(len(gram))
        live = np.ones(len(gram), bool)
        child = np.full(len(gram), -1)  # the node of the order above, if the text's context reached it
        for order in range(ORDER, -1, -1):
            node = self.nodes[order]
            x = shortened(gram, order)
            at = Node.find(node.context, x >> np.uint64(8))
            total, distinct = (np.append(v, 0)[at] for v in (node.total, node.distinct))
            if order < ORDER:
                t, d = self.left[order + 1]
                cut = child >= 0
                total = np.where(cut, np.append(t, 0)[child], total)
                distinct = np.where(cut, np.append(d, 0)[child], distinct)
            known = live & (at >= 0)
            hit = Node.find(node.gram, x)
            here = known & (hit >= 0)
            n = np.append(node.count, 1)[hit]
            out[here] += np.log10(n[here] / (total[here] + distinct[here]))
            escape = known & (hit < 0) & (distinct > 0)
            out[escape] += np.log10(distinct[escape] / (total[escape] + distinct[escape]))
            live &= ~here
            child = at
        rest = max(1, 256 - (len(self.nodes[0].gram)))
        out[live] -= np.log10(rest)
        return out


def _block_words(texts: pa.Array):
    """(code of each word, its text, the words ascending and the end token last); lower-cased."""
    values, row = common.words_of(pc.ascii_lower(pc.fill_null(texts, "")))
    codes, words = common.codes_of(values)
    order = np.asarray(pc.array_sort_indices(words)).astype(np.int64)
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    return rank[codes], row, pa.concat_arrays([words.take(pa.array(order)), pa.array([END_WORD], words.type)])


def _pieces(table: pa.Table):
    for batch in table.combine_chunks().to_batches():
        yield from common.pieces(batch, "t")


def _piece_grams(part: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(distinct grams, code of each gram, where each text's begin) of a piece."""
    gram, begin = grams_of(*common.flat(part.column("t")))
    codes, distinct = pd.factorize(gram)
    return distinct, codes.astype(np.int32), begin


def _asked_grams(table: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """(distinct grams ascending, how often each comes in texts to learn from) of a block."""
    grams, counts = [], []
    for part in _pieces(table):
        distinct, codes, begin = _piece_grams(part)
        learn = np.asarray(part.column("l").cast(pa.int8())).astype(bool)
        grams.append(distinct)
        counts.append(np.bincount(codes[np.repeat(learn, np.diff(begin))], minlength=len(distinct)))
    return merged(np.concatenate(grams), np.concatenate(counts).astype(np.int64))


def _text_scores(table: pa.Table, values_of) -> np.ndarray:
    """The sum over each text of a block of its grams' values, given those of the block's ascending grams."""
    held = [_piece_grams(part) for part in _pieces(table)]
    gram = common.distinct(np.concatenate([h[0] for h in held]))
    value, out = values_of(gram), []
    for distinct, codes, begin in held:
        total = np.zeros(len(codes) + 1)
        np.cumsum(value[np.searchsorted(gram, distinct)][codes], out=total[1:])
        out.append(total[begin[1:]] - total[begin[:-1]])
    return np.concatenate(out)


def scores(docs: DataFrame, trained: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: id, `trained`, n_tokens, n_known, train_tokens, vocabulary, base_score, score.

    `trained` names a boolean column that marks the rows to learn from (null:
    not). An id that is no integer counts as null. A NUL in a text is the same
    symbol as a text's end. A null text counts as empty: one end token. Rows without an id are
    scored like others. Repeated rows count as often as they come. Without any training row
    N and V are 0 and the model gives each byte 1/256. An empty table gives
    an empty one. Other columns are left out.
    """
    spark = docs.sparkSession
    common.ship(spark)
    n = common.partitions(spark)
    src = docs.select(docs[f"`{id_col}`"].try_cast("long").alias("i"), F.coalesce(docs[f"`{trained}`"], F.lit(False)).alias("l"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("t"))
    src = src.withColumn("b", F.pmod(F.xxhash64("i", "t"), F.lit(n)).cast("int"))
    ddl = common.PARCEL_DDL
    names = ["i", "l", "t", "b"]

    def contexts(batches):
        seen = np.zeros(65536, np.int64)
        for batch in batches:
            for part in common.pieces(batch, "t"):
                gram, _ = grams_of(*common.flat(part.column("t")))
                seen += np.bincount((gram >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64), minlength=65536)
        yield common.parcel_batch([(0, 0, pack(seen))])

    sampled = src.select("t").limit(SAMPLE).mapInArrow(contexts, ddl).collect()
    heavy = heavy_contexts(sum((unpack(r.parcel)[0] for r in sampled), np.zeros(65536, np.int64)))

    def ask(batches):
        """A block's distinct grams and words for each shard, with their training counts."""
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        table = pa.Table.from_batches(held)
        texts = table.column("t").combine_chunks()
        learn = np.asarray(table.column("l").combine_chunks().cast(pa.int8())).astype(bool)
        block = table.column("b")[0].as_py()
        gram, count = _asked_grams(table)
        low = np.bincount((gram & np.uint64(0xFFFF)).astype(np.int64), count, 65536).astype(np.int64)
        shard = shard_of_gram(gram, n, heavy)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            yield common.parcel_batch([(0, int(shard[part[0]]), pack(block, gram[part], count[part].astype(np.uint32)))])
        used = np.flatnonzero(low)
        three = shortened(gram[heavy[(gram >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)]], 2)
        three, k = summed(three, count[heavy[(gram >> np.uint64(8) & np.uint64(0xFFFF)).astype(np.int64)]])
        yield common.parcel_batch([(2, -1, pack(np.concatenate([used, three.astype(np.int64) + 65536]).astype(np.int32), np.concatenate([low[used], k])))])
        del gram, count
        wcodes, row, words = _block_words(texts)
        wcount = np.append(np.bincount(wcodes[learn[row]], minlength=len(words) - 1), learn.sum())
        shard = shard_of_word(words, n)
        order = np.argsort(shard, kind="stable")
        for part in np.split(order, np.flatnonzero(np.diff(shard[order])) + 1):
            yield common.parcel_batch([(1, int(shard[part[0]]), pack(block, words.take(pa.array(part)), wcount[part]))])

    asked = common.checkpoint(src.repartitionById(n, F.col("b")).mapInArrow(ask, ddl))

    def spread(batches):
        for batch in batches:
            for p in batch.column("parcel").to_pylist():
                pair, count = unpack(p)
                yield pa.RecordBatch.from_arrays([pa.array(pair), pa.array(count)], ["pair", "n"])

    low, whole = np.zeros(65536, np.int64), {}
    pairs = asked.where("kind = 2").mapInArrow(spread, "pair int, n long").groupBy("pair").agg(F.sum("n").alias("n"))
    for pair, count in pairs.collect():  # at most 65,536 rows of two bytes and HEAVY x 256 of three
        if pair < 65536:
            low[pair] = count
        else:
            whole[pair - 65536] = count
    three = np.array(sorted(whole), np.uint64)
    shared = spark.sparkContext.broadcast((low.reshape(256, 256), (three, np.array([whole[int(x)] for x in three], np.int64))))

    def answer(batches):
        """A shard's replies; kind 2 has its part of N and V."""
        grams, words, shard = [], [], -1
        for batch in batches:
            for kind, to, p in zip(*(batch.column(c).to_pylist() for c in ("kind", "to", "parcel"))):
                (words if kind else grams).append(unpack(p))
                shard = to
        rows = []
        if grams:
            count = np.concatenate([p[2] for p in grams]).astype(np.int64)
            trie = Trie(*summed(np.concatenate([p[1] for p in grams]), count), *shared.value, heavy)
            rows += [(0, block, pack(shard, trie.log10(gram))) for block, gram, _ in grams]
        if words:
            codes, _ = common.codes_of(pa.concat_arrays([p[1] for p in words]))
            total = np.bincount(codes, np.concatenate([p[2] for p in words])).astype(np.int64)
            cuts = np.cumsum([len(p[1]) for p in words])[:-1]
            rows += [(1, p[0], pack(shard, total[part])) for p, part in zip(words, np.split(codes, cuts))]
            rows.append((2, -1, pack(int(total.sum()), int((total > 0).sum()))))
        yield common.parcel_batch(rows)

    answers = common.checkpoint(asked.where("kind < 2").repartitionById(n, F.col("to")).mapInArrow(answer, ddl))

    def sizes(batches):
        for batch in batches:
            got = [unpack(p) for p in batch.column("parcel").to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.int64()), pa.array([g[1] for g in got], pa.int64())], ["tokens", "words"])

    size = answers.where("kind = 2").mapInArrow(sizes, "tokens long, words long").agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("N"), F.coalesce(F.sum("words"), F.lit(0)).alias("V"))

    result = pa.schema([("i", pa.int64()), ("l", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("base", pa.float64()), ("score", pa.float64())])

    def score(batches):
        table, replies = common.apart(batches, names)
        if table is None or not table.num_rows:
            return
        texts = table.column("t").combine_chunks()
        replied: tuple[dict, dict] = ({}, {})
        for kind, p in replies:
            shard, values = unpack(p)
            replied[kind][shard] = values
        del replies

        def values_of(gram: np.ndarray) -> np.ndarray:
            log, shard = np.empty(len(gram)), shard_of_gram(gram, n, heavy)
            for s, values in replied[0].items():
                log[shard == s] = values
            return log

        score_ = _text_scores(table, values_of)
        codes, row, words = _block_words(texts)
        counts = np.empty(len(words), np.int64)
        shard = shard_of_word(words, n)
        for s, values in replied[1].items():
            counts[shard == s] = values
        logs, rows, c = np.log10(counts + 1), table.num_rows, counts[codes]
        size = np.bincount(row, minlength=rows) + 1
        known = np.bincount(row[c > 0], minlength=rows) + int(counts[-1] > 0)
        base = np.bincount(row, logs[codes], rows) + logs[-1]
        columns = [table.column("i").combine_chunks(), table.column("l").combine_chunks(), size, known, base, score_]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, result.types)], schema=result)

    out = common.beside(src, answers.where("kind < 2"), n).mapInArrow(score, "i long, l boolean, n_tokens long, n_known long, base double, score double")
    out = out.crossJoin(F.broadcast(size))  # one row
    base = F.col("base") - F.col("n_tokens") * F.log10(F.col("N") + F.col("V") + 1)
    return out.select(F.col("i").alias(id_col), F.col("l").alias(trained), "n_tokens", "n_known", F.col("N").alias("train_tokens"), F.col("V").alias("vocabulary"), base.alias("base_score"), "score")
