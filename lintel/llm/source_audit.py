"""How the sources of a language differ: distances of all pairs, and each source's own terms.

Texts are counted where they are read. (lang, term) hashes to a shard, a partition
of the shuffle. There DuckDB adds the counts up and keeps the terms that enough
documents of the language have; Spark sums what is kept to the sizes of all groups.
In a second round each shard is given these sizes, and DuckDB turns counts into shares,
sums their differences for every pair of sources, and ranks its terms; Spark adds the
sums and merges the rankings. Nothing but sums and top lists leaves a shard.

A shard holds the distinct (lang, term, source) counts of its terms, and the table of
groups, whose square is the result's size. However frequent, a term is a row for each source
by then. All arithmetic is of integers, 128 bits wide where counts are scaled.

Cases: null texts, languages and sources are empty strings; rows are documents whatever
their ids, repeated ones count again; a group without terms has zero counts; a language in
which no term is kept has pairs of value 0 and no term rows; a language of one source has
neither pairs nor term rows (its shares are the language's own); an empty table gives no rows;
other columns are not looked at.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import checkpoint, codes_of, flat, give_back, partitions, pieces, ship, words_of

MIN_DOCS = 30
SMOOTHING = 5
SCALE = 1_000_000_000
TOP = 50
#: Text bytes that one count of a task takes in before it hands its groups on.
COUNT_BYTES = 64 << 20
_PIECE = 4 << 20

_COUNTS = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("d", pa.int64())])
_COUNTS_DDL = "lang string, source string, term string, n long, d long"
_KEPT = pa.schema([("lang", pa.string()), ("source", pa.string()), ("term", pa.string()), ("n", pa.int64()), ("first", pa.int64())])
_KEPT_DDL = "lang string, source string, term string, n long, first long"
_FOUND = pa.schema([("part", pa.string()), ("lang", pa.string()), ("source", pa.string()), ("item", pa.string()), ("value", pa.int64())])
_FOUND_DDL = "part string, lang string, source string, item string, value long"


def _lowered() -> np.ndarray:
    """Each byte of a term, A-Z lower-cased; blanks for what lies between terms."""
    table = np.full(256, 0x20, np.uint8)
    table[0x61:0x7B] = np.arange(0x61, 0x7B)
    table[0x41:0x5B] = np.arange(0x61, 0x7B)
    table[0x80:] = np.arange(0x80, 0x100)
    return table


_TABLE = _lowered()


def _count_piece(piece: pa.RecordBatch) -> pa.RecordBatch:
    """(lang, source, term, occurrences, documents) of some documents."""
    data, off = flat(piece.column("text"))
    texts = pa.Array.from_buffers(pa.large_string(), piece.num_rows, [None, pa.py_buffer(np.ascontiguousarray(off, np.int64)), pa.py_buffer(_TABLE[data])])
    values, row = words_of(texts)
    code, names = codes_of(values)
    (lang, langs), (source, sources) = codes_of(piece.column("lang")), codes_of(piece.column("source"))
    group = lang.astype(np.int64) * len(sources) + source
    width = max(1, len(names))
    in_doc, n = np.unique(row.astype(np.int64) * width + code, return_counts=True)
    key = group[in_doc // width] * width + in_doc % width
    order = np.argsort(key, kind="stable")
    key, n = key[order], n[order]
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    total = np.add.reduceat(n, start) if len(start) else np.zeros(0, np.int64)
    docs = np.diff(np.concatenate([start, [len(key)]]))
    g, t = np.divmod(key[start], width)
    columns = [langs.take(pa.array(g // max(1, len(sources)))), sources.take(pa.array(g % max(1, len(sources)))), names.take(pa.array(t))]
    return pa.RecordBatch.from_arrays([c.cast(pa.string()) for c in columns] + [pa.array(total, pa.int64()), pa.array(docs, pa.int64())], schema=_COUNTS)


def _duck():
    """A database in memory; a shard is a partition of the shuffle, so it neither needs a disk nor other threads."""
    import duckdb

    con = duckdb.connect(":memory:")
    for setting in ("threads = 1", "temp_directory = ''", "preserve_insertion_order = false"):
        con.execute(f"SET {setting}")
    return con


def _stream(con, sql: str, **readers: pa.RecordBatchReader) -> pa.RecordBatchReader:
    for name, r in readers.items():
        con.register(name, r)
    return con.execute(sql).to_arrow_reader(100_000)


def _cast(batches, schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if b.num_rows:
            yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, schema)], schema=schema)


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's documents, summed over `COUNT_BYTES` of text at a time."""
    source = (p for b in batches for p in pieces(b, "text", _PIECE))
    more = True

    def some() -> Iterator[pa.RecordBatch]:
        nonlocal more
        taken = 0
        while taken < COUNT_BYTES:
            p = next(source, None)
            if p is None:
                more = False
                return
            taken += p.nbytes
            yield _count_piece(p)

    while more:
        con = _duck()
        reader = pa.RecordBatchReader.from_batches(_COUNTS, some())
        yield from _cast(_stream(con, "SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM pieces GROUP BY ALL", pieces=reader), _COUNTS)
        con.close()
        give_back()


def _kept(least: int):
    """A shard's counts of the terms that `least` documents of their language have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        con = _duck()
        con.register("parts", pa.RecordBatchReader.from_batches(_COUNTS, (b.select(_COUNTS.names) for b in batches)))
        con.execute("CREATE TABLE c AS SELECT lang, source, term, sum(n)::BIGINT AS n, sum(d)::BIGINT AS d FROM parts GROUP BY ALL")
        sql = f"SELECT lang, source, term, n, (row_number() OVER (PARTITION BY lang, term ORDER BY source) = 1)::BIGINT AS first FROM (SELECT *, sum(d) OVER (PARTITION BY lang, term) AS docs FROM c) WHERE docs >= {least}"
        yield from _cast(_stream(con, sql), _KEPT)
        con.close()
        give_back()

    return run


#: A shard's tables: x as it comes, g the groups, c the counts, m the shares of all groups of a language.
_TABLES = """
CREATE TABLE x AS SELECT * FROM rows;
CREATE TABLE g AS SELECT lang, source, n AS size, lang_size, n_terms FROM x WHERE term IS NULL;
CREATE TABLE c AS SELECT lang, source, term, n FROM x WHERE term IS NOT NULL;
CREATE TABLE m AS SELECT lang, source, term, (1 + ({scale}::HUGEINT * (coalesce(c.n, 0) + {smoothing})) // (size + {smoothing}::HUGEINT * n_terms))::BIGINT AS p
 FROM (SELECT DISTINCT lang, term FROM c) JOIN g USING (lang) LEFT JOIN c USING (lang, source, term);
"""
_PAIRS = """
WITH s AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM m a JOIN m b ON a.lang = b.lang AND a.term = b.term AND a.source < b.source GROUP BY ALL)
SELECT 'pair' AS part, a.lang, a.source, b.source AS item, coalesce(s.value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source < b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
"""
_TERMS = """
WITH q AS (SELECT c.lang, c.term, (1 + ({scale}::HUGEINT * (sum(c.n) + {smoothing})) // (any_value(lang_size) + {smoothing}::HUGEINT * any_value(n_terms)))::BIGINT AS q FROM c JOIN g USING (lang, source) GROUP BY ALL)
SELECT 'term' AS part, lang, source, term AS item, p - q AS value FROM c JOIN m USING (lang, source, term) JOIN q USING (lang, term) WHERE c.n > 0 AND p > q
QUALIFY row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) <= {top}
"""


def _compared(smoothing: int, scale: int, top: int):
    """A shard's part of every pair's distance, and its highest terms of each group."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first = next(batches, None)
        if first is None:
            return
        fixed = {"smoothing": smoothing, "scale": scale, "top": top}
        con = _duck()

        def rows() -> Iterator[pa.RecordBatch]:
            yield first
            yield from batches

        con.register("rows", pa.RecordBatchReader.from_batches(first.schema, rows()))
        con.execute(_TABLES.format(**fixed))
        for sql in (_PAIRS, _TERMS):
            yield from _cast(_stream(con, sql.format(**fixed)), _FOUND)
        con.close()
        give_back()

    return run


def divergence(docs: DataFrame, min_docs: int = MIN_DOCS, smoothing: int = SMOOTHING, scale: int = SCALE, top: int = TOP) -> DataFrame:
    """(lang, source, part, item, value, rank) of every (lang, source) group.

    Part `pair` has every other source of the language and the sum of the terms' absolute
    differences of scaled shares; part `term` the `top` terms by which the group exceeds
    its language. A share is 1 + floor(scale * (count + smoothing) / (size + smoothing * terms)).
    """
    spark = docs.sparkSession
    ship(spark)
    n = partitions(spark)
    named = [F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source")]
    counts = docs.select(*named, F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_counts, _COUNTS_DDL)
    shard = F.pmod(F.xxhash64("lang", "term"), F.lit(n)).cast("int")
    kept = checkpoint(counts.withColumn("b", shard).repartitionById(n, F.col("b")).drop("b").mapInArrow(_kept(min_docs), _KEPT_DDL))
    sizes = kept.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("first").alias("first"))
    of_lang = Window.partitionBy("lang")
    groups = docs.select(*named).distinct().join(sizes, ["lang", "source"], "left").na.fill(0)
    groups = groups.select("lang", "source", "n", F.sum("n").over(of_lang).alias("lang_size"), F.sum("first").over(of_lang).alias("n_terms"))
    given = groups.withColumn("term", F.lit(None).cast("string")).withColumn("b", F.explode(F.sequence(F.lit(0), F.lit(n - 1))))
    rows = kept.drop("first").withColumn("b", shard).unionByName(given, allowMissingColumns=True)
    found = rows.repartitionById(n, F.col("b")).mapInArrow(_compared(smoothing, scale, top), _FOUND_DDL)
    found = checkpoint(found)
    pairs = found.where("part = 'pair'").groupBy("part", "lang", "source", "item").agg(F.sum("value").alias("value"))
    both = F.array(F.struct("source", "item"), F.struct(F.col("item").alias("source"), F.col("source").alias("item")))
    pairs = pairs.select("part", "lang", "value", F.inline(both))
    ranked = lambda *by: F.row_number().over(Window.partitionBy("lang", "source", "part", *by).orderBy(F.desc("value"), "item"))
    columns = ["lang", "source", "part", "item", "value"]
    # a group's top lists of all shards would meet in one task: lists of some shards are merged first
    some = F.pmod(F.xxhash64("item"), F.lit(max(1, math.isqrt(n))))
    terms = found.where("part = 'term'").select(*columns).withColumn("some", some).withColumn("rank", ranked("some")).where(F.col("rank") <= top)
    terms = terms.select(*columns).withColumn("rank", ranked()).where(F.col("rank") <= top)
    return pairs.select(*columns).withColumn("rank", ranked()).unionByName(terms)
