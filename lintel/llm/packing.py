"""Packing documents into sequences by lexical retrieval.

Documents are tokenised once; the ids are kept in the shared folder. Document
frequencies of the tokens and the mean length are counted over all documents on
the way: at most one figure for each entry of the vocabulary. Documents are
then dealt to shards of SHARD_TOKENS tokens by content, so that neighbours meet: a
document's place on the line of all shards is that of the heaviest of its common
terms (those in at least COMMON of all documents), and among documents with that
term it goes by the second heaviest. Groups too large for a shard are spread over
several by the hash of the document.

A shard builds a BM25 inverted index of its documents, with the corpus's
frequencies, and fills window after window: the seed is what was cut from the last
window's end, or else the first unused document; its heaviest terms are looked up
in the index, and the unused neighbours follow by falling score, as many as the
window takes, the last one cut where it ends. Only when no unused document shares
a term with the seed does the next one in order follow. Only a shard's last window
can stay short; it is cut into sequences whose lengths are powers of two, which
need no padding.
"""

from __future__ import annotations

import os
import re
import zlib
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm import common
from lintel.llm.common import pack, unpack

LENGTH = 4096
END = 2  # the id after each document
K1, B = 1.2, 0.75
#: Terms of a seed that are looked up, the heaviest first (None: all).
QUERY_TERMS = 24
#: Tokens of a shard, in the mean.
SHARD_TOKENS = 1 << 22
#: The share of all documents in which a term must be to decide a document's place.
COMMON = 0.05
CHUNK = 500_000  # tokens counted at a time
#: Bytes of text tokenised together: the more, the fewer distinct words in all.
TOKENISED = 4 << 20
#: Words whose ids a worker remembers.
CACHE = 250_000


#: Words that lower-casing and composing treat letter by letter: printable ASCII and accented Latin-1 letters.
_PLAIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")
#: The vocabulary's pre-tokeniser, for lower-cased words of that kind.
_PARTS = re.compile("'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")


def byte_letters() -> list[str]:
    """The letter that stands for each byte in a byte-level vocabulary: printable ones for themselves, then from 256 on."""
    own = {*range(33, 127), *range(161, 173), *range(174, 256)}
    other = iter(range(256, 512))
    return [chr(b if b in own else next(other)) for b in range(256)]


# Kinds of bytes: white space, letters of one byte or two, digits, others, and those that need the library's whole way.
_SPACE, _LETTER, _DIGIT, _OTHER, _HARD = range(5)


def _byte_kinds() -> np.ndarray:
    kind = np.full(256, _HARD, np.uint8)
    kind[33:127] = _OTHER
    kind[[9, 10, 11, 12, 13, 32]] = _SPACE
    kind[97:123] = _LETTER
    kind[48:58] = _DIGIT
    kind[ord("'")] = _HARD  # may begin a contraction
    kind[0xC3] = kind[0x80:0xC0] = _LETTER  # a two-byte letter, if they come in pairs
    return kind


_KIND = _byte_kinds()
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordTokenizer:
    """Ids of whole texts, through the ids of their distinct parts.

    The vocabulary's pre-tokeniser drops white space and never looks across it.
    Texts of ASCII without apostrophes and of accented Latin-1 letters are lower-
    cased and parted here, all of a piece at once: runs of letters, single
    digits, runs of other marks. Their distinct parts are looked up in the
    vocabulary's model. All other texts go word by word, plain words parted by
    an expression and the rest by the library's whole way.
    """

    _shared: dict[str, WordTokenizer] = {}

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model = self.whole.model
        self.letters = dict(enumerate(byte_letters()))
        self.clear()

    @classmethod
    def of(cls, path: str) -> WordTokenizer:
        """One for each worker process."""
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def clear(self) -> None:
        self.slot: dict[str, int] = {}
        self.pool = np.zeros(0, np.uint16)
        self.first = np.zeros(0, np.int64)
        self.size = np.zeros(0, np.int64)

    def spelled(self, part: str) -> str:
        """A part in the letters of the vocabulary."""
        return part if part.isascii() else part.encode().decode("latin-1").translate(self.letters)

    def word(self, word: str) -> list[int]:
        """The ids of a word."""
        if _PLAIN.fullmatch(word) and "<|" not in word:
            return [t.id for p in _PARTS.findall(word.lower()) for t in self.model.tokenize(self.spelled(p))]
        return self.whole.encode(word, add_special_tokens=False).ids

    def parts_of(self, parts: list[str]) -> tuple[list[int], list[int]]:
        """(ids of parts one after another, how many each has); parts are lower-cased already."""
        got = list(map(self.model.tokenize, map(self.spelled, parts)))
        return [t.id for tokens in got for t in tokens], list(map(len, got))

    def words_of(self, words: list[str]) -> tuple[list[int], list[int]]:
        """The same of words, each behind its mark."""
        got = [self.word(w[1:]) for w in words]
        return list(chain.from_iterable(got)), list(map(len, got))

    def slots(self, keys: list[str], ids_of) -> np.ndarray:
        """The remembered places of parts or words; new ones are encoded."""
        known = self.slot
        new = [k for k in keys if k not in known]
        if new:
            ids, size = ids_of(new)
            known.update(zip(new, range(len(known), len(known) + len(new))))
            size = np.array(size, np.int64)
            self.first = np.concatenate([self.first, len(self.pool) + np.cumsum(size) - size])
            self.size = np.concatenate([self.size, size])
            self.pool = np.concatenate([self.pool, np.array(ids, np.uint16)])
        return np.fromiter(map(known.__getitem__, keys), np.int64, len(keys))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all texts with the end id after each, where each text's begin)."""
        n = len(texts)
        if len(self.slot) > CACHE:
            self.clear()
        buf, off = common.flat(texts)
        low = _LOWER[buf]
        kind = _KIND[low]
        high = np.flatnonzero(buf >= 0x80)
        byte = buf[high]
        lead, tail, next_ = byte == 0xC3, byte < 0xC0, np.diff(high) == 1
        after, before = np.zeros(len(high), bool), np.zeros(len(high), bool)  # a letter's second byte, its first
        after[1:] = lead[:-1] & next_ & tail[1:]
        before[:-1] = after[1:]
        low[high[after & (byte <= 0x9E)]] += 0x20
        bars = np.flatnonzero(buf[1:] == ord("|"))
        bad = [np.flatnonzero(kind == _HARD), high[(tail & ~after) | (lead & ~before) | after & ((byte == 0x97) | (byte == 0xB7))], bars[buf[bars] == ord("<")]]
        hard = np.zeros(n, bool)
        hard[np.searchsorted(off, np.concatenate(bad), side="right") - 1] = True
        keep = kind != _SPACE
        if hard.any():
            keep &= ~np.repeat(hard, np.diff(off))
        opens = np.ones(len(buf), bool)
        opens[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _DIGIT)
        inner = off[1:-1]
        opens[inner[inner < len(buf)]] = True
        opens &= keep
        bytes_ = low[keep]
        starts = np.append(np.flatnonzero(opens[keep]), len(bytes_)).astype(np.int32)
        parts = pa.Array.from_buffers(pa.string(), len(starts) - 1, [None, pa.py_buffer(starts), pa.py_buffer(bytes_)])
        codes, distinct = common.codes_of(parts)
        row = np.repeat(np.arange(n), np.diff(np.searchsorted(np.flatnonzero(opens), off)))
        slot = self.slots(distinct.to_pylist(), self.parts_of)[codes] if len(codes) else np.zeros(0, np.int64)
        if hard.any():  # words are remembered under a mark, for they are not lower-cased parts
            which = np.flatnonzero(hard)
            values, word_row = common.words_of(pc.fill_null(texts, "").take(pa.array(which)))
            codes, distinct = common.codes_of(values)
            if len(codes):
                slot = np.concatenate([slot, self.slots(["\n" + w for w in distinct.to_pylist()], self.words_of)[codes]])
                row = np.concatenate([row, which[word_row]])
                order = np.argsort(row, kind="stable")
                slot, row = slot[order], row[order]
        count = self.size[slot]
        ends = np.cumsum(count)
        begin = np.zeros(n + 1, np.int64)
        begin[1:] = np.cumsum(np.bincount(row, count, n).astype(np.int64) + 1)
        total = int(ends[-1]) if len(ends) else 0
        out = np.full(int(begin[-1]), END, np.uint16)
        is_end = np.zeros(len(out), bool)
        is_end[begin[1:] - 1] = True
        out[~is_end] = self.pool[np.repeat(self.first[slot] - (ends - count), count) + np.arange(total)]
        return out, begin


def weights_of(term: np.ndarray, tf: np.ndarray, size: np.ndarray, idf: np.ndarray, mean: float) -> np.ndarray:
    """BM25 weights of terms that occur `tf` times in documents of `size` tokens."""
    return (idf[term] * tf * (K1 + 1) / (tf + K1 * (1 - B + B * size / mean))).astype(np.float32)


def idf_of(frequency: np.ndarray, documents: int) -> np.ndarray:
    """Inverse document frequencies."""
    return np.log1p((documents - frequency + 0.5) / (frequency + 0.5))


def counted(ids: np.ndarray, begin: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, how often) of documents' ids, in that order."""
    pair = np.sort(np.repeat(np.arange(len(begin) - 1, dtype=np.uint64) << np.uint64(16), np.diff(begin)) | ids)
    first = np.flatnonzero(np.concatenate([[True], pair[1:] != pair[:-1]])) if len(pair) else np.zeros(0, np.int64)
    pair, tf = pair[first], np.diff(np.append(first, len(pair)))
    return (pair >> np.uint64(16)).astype(np.int32), (pair & np.uint64(0xFFFF)).astype(np.uint16), tf


class Places:
    """Where documents lie on the line of all shards, from 0 to 1.

    `tokens` are the tokens of all documents by their first term; a term's documents
    take a stretch of that width. `large` are (first, second) terms whose
    documents hold half a shard or more.
    """

    def __init__(self, tokens: np.ndarray, large: set[tuple[int, int]]):
        share = tokens / max(1, tokens.sum())
        self.width, self.base = share, np.cumsum(share) - share
        self.large = np.array(sorted(a << 16 | b for a, b in large), np.int64)

    def of(self, first: np.ndarray, second: np.ndarray, own: np.ndarray) -> np.ndarray:
        """Places by the two terms, or by the document's hash in large groups."""
        pair = first.astype(np.int64) << 16 | second
        spread = np.isin(pair, self.large)
        mixed = np.where(spread, common.mix64(own.astype(np.uint64)), common.mix64(second.astype(np.uint64) + np.uint64(1)))
        return self.base[first] + self.width[first] * ((mixed >> np.uint64(11)) / float(1 << 53))


def leading_terms(ids: np.ndarray, begin: np.ndarray, frequency: np.ndarray, documents: int, mean: float, least: float = COMMON) -> tuple[np.ndarray, np.ndarray]:
    """Each document's heaviest and second heaviest common term; ties go by the smaller, END stands for none."""
    common_ = frequency >= least * documents
    common_[END] = False
    n = len(begin) - 1
    owner, size = np.repeat(np.arange(n), np.diff(begin)), np.diff(begin)
    keep = common_[ids]
    doc, term, tf = counted(ids[keep], np.concatenate([[0], np.cumsum(np.bincount(owner[keep], minlength=n))]))
    weight = weights_of(term, tf, size[doc], idf_of(frequency, documents), mean)
    have, start = np.unique(doc, return_index=True)
    out = []
    for _ in range(2):
        best = np.full(n, END)
        if len(have):
            top = np.zeros(n, np.float32)
            top[have] = np.maximum.reduceat(weight, start)
            at = np.minimum.reduceat(np.where((weight == top[doc]) & (weight > 0), term.astype(np.int32), 1 << 20), start)
            best[have] = np.where(at < 1 << 20, at, END)
        out.append(best)
        weight = np.where(term == best[doc], 0, weight)
    return out[0], out[1]


class Index:
    """A BM25 inverted index of a shard's documents."""

    def __init__(self, docs: list[np.ndarray], frequency: np.ndarray, documents: int, mean: float):
        size = np.array([len(d) for d in docs])
        chunk = np.cumsum(size) // CHUNK  # documents are counted some at a time, for memory
        doc, term, weight = [], [], []
        idf = idf_of(frequency, documents)
        for r in common.runs_of(chunk):
            at, own, tf = counted(np.concatenate(docs[r]), np.concatenate([[0], np.cumsum(size[r])]))
            at = at + np.int32(r.start)
            doc.append(at)
            term.append(own)
            weight.append(weights_of(own, tf, size[at], idf, mean))
        doc, term, weight = np.concatenate(doc), np.concatenate(term), np.concatenate(weight)
        self.doc_first = np.searchsorted(doc, np.arange(len(docs) + 1))
        self.doc_term, self.doc_weight = term, weight
        order = np.argsort(term, kind="stable").astype(np.int32)
        self.doc, self.weight = doc[order], weight[order]
        self.first = np.searchsorted(term[order], np.arange(len(frequency) + 1))
        self.n = len(docs)

    def scores(self, seed: int, terms: int | None = QUERY_TERMS) -> np.ndarray:
        """Scores of all documents for the seed's heaviest terms, or all of them."""
        lo, hi = self.doc_first[seed], self.doc_first[seed + 1]
        term, weight = self.doc_term[lo:hi], self.doc_weight[lo:hi]
        if terms is not None and len(term) > terms:
            term = term[np.argpartition(-weight, terms)[:terms]]
        parts = [slice(self.first[t], self.first[t + 1]) for t in term]
        doc = np.concatenate([self.doc[p] for p in parts])
        return np.bincount(doc, np.concatenate([self.weight[p] for p in parts]), self.n)


def ranked(score: np.ndarray):
    """Documents of a positive score by falling score, then number; sorted as far as they are asked for."""
    best = np.flatnonzero(score > 0)
    done, step = 0, 32
    while done < len(best):
        take = min(len(best), done + step)
        if take < len(best):  # everything above the next bound, ties included
            bound = -np.partition(-score[best], take - 1)[take - 1]
            some = best[score[best] >= bound]
        else:
            some = best
        some = some[np.lexsort((some, -score[some]))]
        yield from some[done:].tolist()
        done, step = len(some), 4 * step


def order_by_retrieval(sizes: np.ndarray, index: Index, length: int, terms: int | None = QUERY_TERMS) -> list[int]:
    """The shard's documents in the order they enter windows."""
    n = len(sizes)
    unused = np.ones(n, bool)
    out: list[int] = []
    room, at = length, 0

    def put(d: int) -> bool:
        """Whether the window is full with it."""
        nonlocal room
        unused[d] = False
        out.append(d)
        size = int(sizes[d])
        full = size >= room
        room = length - (length - room + size) % length
        return full

    while True:
        while at < n and not unused[at]:
            at += 1
        if at == n:
            return out
        if room == length and put(at):  # the window begins with a document of its own, which fills it
            continue
        score = index.scores(out[-1], terms)  # the seed: first of its window, or cut by the window's start
        score[~unused] = 0
        full = any(put(d) for d in ranked(score))
        while not full:  # nothing unused is like the seed
            while at < n and not unused[at]:
                at += 1
            if at == n:
                return out
            full = put(at)


def pieces_of(order: list[int], sizes: np.ndarray, length: int) -> list[tuple[int, int, int, int, int]]:
    """(document, start, length, sequence, offset) of each piece; the tail in powers of two."""
    total = int(sizes.sum())
    ends, at = [], 0
    while at < total:
        step = length if total - at >= length else 1 << (total - at).bit_length() - 1
        at += step
        ends.append(at)
    out, sequence, place = [], 0, 0
    for d in order:
        start = 0
        while start < sizes[d]:
            begin = ends[sequence - 1] if sequence else 0
            n = min(int(sizes[d]) - start, ends[sequence] - place)
            out.append((d, start, n, sequence, place - begin))
            start, place = start + n, place + n
            if place == ends[sequence]:
                sequence += 1
    return out


def tokenised(batches, tokenizer: str, vocabulary: int):
    """(i, own, n, ids) of rows (i, own, t); last the tokens' document counts as a parcel, with -1 for n.

    Memory goes back after each piece: many small things of one are freed
    among those that stay, and what earlier stages left in the worker counts
    beside them.
    """
    encoder = WordTokenizer.of(tokenizer)
    seen = np.zeros(vocabulary, np.int64)
    common.give_back()
    for batch in batches:
        for part in common.pieces(batch, "t", TOKENISED):
            ids, begin = encoder.encode(part.column("t"))
            rows = part.num_rows
            pair = common.distinct(np.repeat(np.arange(rows, dtype=np.uint64) << np.uint64(16), np.diff(begin)) | ids)
            seen += np.bincount((pair & np.uint64(0xFFFF)).astype(np.int64), minlength=vocabulary)
            del pair
            common.give_back()
            raw = pa.Array.from_buffers(pa.binary(), rows, [None, pa.py_buffer((2 * begin).astype(np.int32)), pa.py_buffer(ids)])
            yield pa.RecordBatch.from_arrays([part.column("i"), part.column("own"), pa.array(np.diff(begin)), raw], ["i", "own", "n", "ids"])
    used = np.flatnonzero(seen)
    if len(used):
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.array([-1]), pa.array([pack(used.astype(np.int32), seen[used])], pa.binary())], ["i", "own", "n", "ids"])


def packed(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text: str = "text", length: int = LENGTH, vocabulary: int = 49408, shard_tokens: int = SHARD_TOKENS, terms: int | None = QUERY_TERMS) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian unsigned 32-bit), ids_crc32, doc_tokens, sequence_id, offset.

    `tokenizer` is the path of a `word_bpe` file, on every machine. A null text
    counts as empty: its only id is the end. Rows are packed one by one, so
    repeated rows and null ids are no special case. An empty table gives an
    empty one. Other columns are left out. An id that is no integer counts as
    null. `length` must be a power of two. `shard_tokens` bounds what a task
    holds; `terms` is how many of a seed's terms are looked up (None: all).
    """
    if length & (length - 1) or vocabulary > 1 << 16:
        raise ValueError("length must be a power of two and ids fit in 16 bits")
    spark = docs.sparkSession
    common.ship(spark)
    src = docs.select(docs[f"`{id_col}`"].try_cast("long").alias("i"), F.coalesce(docs[f"`{text}`"].cast("string"), F.lit("")).alias("t"))
    src = src.withColumn("own", F.xxhash64("i", "t"))

    held = common.checkpoint(src.mapInArrow(lambda batches: tokenised(batches, tokenizer, vocabulary), "i long, own long, n long, ids binary"))
    tokens = held.where("n >= 0")

    def count(batches):
        for batch in batches:
            for p in batch.column("ids").to_pylist():
                term, k = unpack(p)
                yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(k)], ["term", "n"])

    frequency = np.zeros(vocabulary, np.int64)
    counts = held.where("n < 0").select("ids").mapInArrow(count, "term int, n long").groupBy("term").agg(F.sum("n"))
    for term, k in counts.collect():  # at most one row an entry of the vocabulary
        frequency[term] = k
    documents, total = tokens.agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
    known = spark.sparkContext.broadcast(frequency)
    mean = max(1.0, total / max(1, documents))
    n = max(1, -(-total // shard_tokens))

    def led(batch):
        """(piece of a batch, its documents' two leading terms)."""
        for part in common.pieces(batch, "ids"):
            buf, off = common.flat(part.column("ids"))
            yield part, *leading_terms(buf.view(np.uint16), off // 2, known.value, documents, mean)

    def sizes_by_terms(batches):
        total: dict[int, int] = {}
        for batch in batches:
            for part, a, b in led(batch):
                pair, at = np.unique(a.astype(np.int64) << 16 | b, return_inverse=True)
                for k, m in zip(pair.tolist(), np.bincount(at.reshape(-1), part.column("n").to_numpy()).astype(np.int64).tolist()):
                    total[k] = total.get(k, 0) + m
        common.give_back()
        pair = np.array(list(total), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array((pair >> 16).astype(np.int32)), pa.array((pair & 0xFFFF).astype(np.int32)), pa.array(list(total.values()), pa.int64())], ["a", "b", "n"])

    if n > 1:
        pairs = common.checkpoint(tokens.mapInArrow(sizes_by_terms, "a int, b int, n long").groupBy("a", "b").agg(F.sum("n").alias("n")))
        by_term = np.zeros(vocabulary, np.int64)
        for term, k in pairs.groupBy("a").agg(F.sum("n")).collect():  # at most one row an entry of the vocabulary
            by_term[term] = k
        large = {(r.a, r.b) for r in pairs.where(F.col("n") >= shard_tokens // 2).collect()}  # at most two a shard
        places = spark.sparkContext.broadcast(Places(by_term, large))

    def deal(batches):
        for batch in batches:
            if n == 1:
                yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(np.zeros(batch.num_rows, np.int32)), batch.column("ids")], ["i", "shard", "ids"])
                continue
            for part, a, b in led(batch):
                shard = np.minimum((places.value.of(a, b, part.column("own").to_numpy()) * n).astype(np.int32), n - 1)
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array(shard), part.column("ids")], ["i", "shard", "ids"])

    schema = pa.schema([("i", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("ids", pa.binary()), ("ids_crc32", pa.int64()), ("doc_tokens", pa.int64()), ("sequence_id", pa.int64()), ("offset", pa.int64())])

    def fill(batches):
        ids, parcels, shard = [], [], 0
        for batch in batches:
            if batch.num_rows:
                ids += batch.column("i").to_pylist()
                parcels += batch.column("ids").to_pylist()
                shard = batch.column("shard")[0].as_py()
        if not ids:
            return
        place = sorted(range(len(ids)), key=lambda k: (ids[k] is None, ids[k] or 0, parcels[k]))
        ids = [ids[k] for k in place]
        docs_ = [np.frombuffer(parcels[k], np.uint16) for k in place]
        del parcels
        sizes = np.array([len(d) for d in docs_])
        order = order_by_retrieval(sizes, Index(docs_, known.value, documents, mean), length, terms)
        out: list[tuple] = []
        for d, start, size, sequence, offset in pieces_of(order, sizes, length):
            raw = docs_[d][start : start + size].astype("<u4").tobytes()
            out.append((ids[d], start, size, raw, zlib.crc32(raw), int(sizes[d]), (shard << 32) + sequence, offset))
            if len(out) == 4096:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
                out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), schema.types)], schema=schema)
        del ids, docs_, out
        common.give_back()

    ddl = "i long, start long, length long, ids binary, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
    out = tokens.mapInArrow(deal, "i long, shard int, ids binary").repartitionById(n, F.col("shard")).mapInArrow(fill, ddl)
    return out.withColumnRenamed("i", id_col)
