"""Benchmark decontamination: words of documents inside n-word windows of benchmark items.

All of it is DataFrame functions. The benchmark's windows are a set of hashes and
one of texts, which every task holds. A document's words are probed at strides: a
window of `n` words that occurs anywhere contains a run of n - s + 1 words that
begins at a multiple of s, so with s = n / 2 a fifth of the positions of a window
of ten is hashed and looked up. Around a probe that is found the windows themselves are
compared, word by word. Neither step moves a row.

The sets go to the tasks only while they are small (`most` windows, counted first).
A larger benchmark takes the other way: all windows of all documents are joined with
those of the benchmark, and brought back to their documents by id and text.

Cases: a null text has no words; an item without words has no window, one of fewer
than n words is one window as a whole; an item without an id hits, but is not listed,
and rows of the same item are one; rows that repeat a document come back as often;
an empty benchmark hits nothing; other columns pass through, whatever they are called.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

WINDOW = 10
#: Windows that are sent to every task; beyond it, they are joined.
MOST = 20_000
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: What lies between words, once A-Z are lower-cased and before.
_BETWEEN = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_BETWEEN_RAW = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_WORD_RAW = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """The words of a text, A-Z lower-cased; letters beyond ASCII stay as they are."""
    low = F.translate(F.coalesce(text, F.lit("")), _UPPER, _UPPER.lower())
    return F.array_remove(F.split(low, _BETWEEN), "")


def _window(w: Column, at: Column, size: int) -> Column:
    return F.array_join(F.slice(w, at, size), " ")


def windows(benchmark: DataFrame, n: int = WINDOW) -> DataFrame:
    """(gram, size, items): the distinct windows of the items, with the sorted ids of theirs."""
    w = F.col("w")
    starts = F.when(F.size(w) > n, F.sequence(F.lit(1), F.size(w) - (n - 1))).otherwise(F.array(F.lit(1)))
    rows = benchmark.select(F.col("item_id").cast("string").alias("item"), words(F.col("text")).alias("w")).where(F.size("w") > 0)
    rows = rows.select("item", "w", F.explode(starts).alias("at")).select("item", F.least(F.size("w"), F.lit(n)).alias("size"), _window(w, F.col("at"), n).alias("gram"))
    return rows.groupBy("gram", "size").agg(F.array_sort(F.collect_set("item")).alias("items"))


def _stride(size: int) -> tuple[int, int]:
    """(stride, words of a probe): a window of `size` words contains a probe at a multiple of the stride."""
    s = max(1, size // 2)
    return s, size - s + 1


def _probed(size: int, probes: list[int]) -> Column:
    """The windows of one size in __words around found probes, which may be those of the benchmark.

    The set is written as SQL, which is one call for all its members.
    """
    s, g = _stride(size)
    w = F.col("__words")
    found = F.expr(f"filter(sequence(1, size(__words) - {g - 1}, {s}), q -> xxhash64(slice(__words, q, {g})) IN ({', '.join(f'{h}L' for h in probes)}))")
    near = F.flatten(F.transform(found, lambda q: F.sequence(F.greatest(q - (s - 1), F.lit(1)), F.least(q, F.size(w) - (size - 1)))))
    seen = F.transform(near, lambda p: F.struct(p.alias("at"), F.lit(size).alias("size"), _window(w, p, size).alias("gram")))
    return F.when(F.size(w) >= size, seen)


def _all_windows(w: Column, sizes: list[int]) -> Column:
    """Every window of a document, of each size that the benchmark has."""
    none = F.array().cast("array<struct<at:int,size:int,gram:string>>")
    of_size = lambda k: lambda p: F.struct(p.alias("at"), F.lit(k).alias("size"), _window(w, p, k).alias("gram"))
    each = [F.when(F.size(w) >= k, F.transform(F.sequence(F.lit(1), F.size(w) - (k - 1)), of_size(k))).otherwise(none) for k in sizes]
    return F.concat(*each)


def _key() -> list[Column]:
    return [F.col("doc_id").cast("string").alias("__i"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("__h")]


def with_hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most: int = MOST) -> DataFrame:
    """Documents with __words and __hits, sorted: array of (at, size, gram) where windows of the benchmark occur."""
    own = windows(benchmark, n).select("gram", "size")
    few = own.limit(most + 1).collect()
    rows = docs.withColumn("__words", words(F.col("text")))
    none = F.array().cast("array<struct<at:int,size:int,gram:string>>")
    if not few:
        return rows.withColumn("__hits", none)
    w = F.col("__words")
    if len(few) <= most:
        per = []
        for size in sorted({r["size"] for r in few}):
            grams = [r.gram for r in few if r["size"] == size]
            _, g = _stride(size)
            runs = sorted({" ".join(x[k : k + g]) for x in (gram.split(" ") for gram in grams) for k in range(size - g + 1)})
            spark = docs.sparkSession
            hashed = spark.createDataFrame([(x,) for x in runs], "x string").select(F.xxhash64(F.split("x", " ")).alias("h"))
            per.append(F.coalesce(_probed(size, [r.h for r in hashed.collect()]), none))
        # words have neither quotes nor backslashes
        every = ", ".join(f"'{r.gram}'" for r in few)
        found = rows.withColumn("__seen", F.array_sort(F.concat(*per)) if len(per) > 1 else per[0])
        return found.withColumn("__hits", F.expr(f"filter(__seen, x -> x.gram IN ({every}))")).drop("__seen")
    sizes = sorted(r["size"] for r in own.select("size").distinct().collect())
    tried = rows.select(*_key(), F.explode(_all_windows(w, sizes)).alias("x"))
    hits = tried.join(own.select("gram"), F.col("x.gram") == F.col("gram"), "left_semi").groupBy("__i", "__h").agg(F.array_sort(F.collect_set("x")).alias("__hits"))
    back = hits.select(F.coalesce("__i", F.lit("")).alias("__a"), F.col("__i").isNull().alias("__b"), F.col("__h").alias("__c"), "__hits")
    i, h = _key()
    same = (F.col("__a") == F.coalesce(i, F.lit(""))) & (F.col("__b") == i.isNull()) & (F.col("__c") == h)
    return rows.join(back, same, "left").drop("__a", "__b", "__c").withColumn("__hits", F.coalesce("__hits", none))


def _spans(hits: Column) -> Column:
    """Maximal runs of hit words as (start, stop), in order."""
    empty = F.array().cast("array<struct<start:int,stop:int>>")

    def add(out: Column, x: Column) -> Column:
        stop, last = x["at"] + x["size"], F.get(out, F.size(out) - 1)
        grown = F.concat(F.slice(out, 1, F.size(out) - 1), F.array(F.struct(last["start"].alias("start"), F.greatest(last["stop"], stop).alias("stop"))))
        return F.when((F.size(out) > 0) & (x["at"] <= last["stop"]), grown).otherwise(F.concat(out, F.array(F.struct(x["at"].alias("start"), stop.alias("stop")))))

    return F.when(F.size(hits) > 0, F.aggregate(hits, empty, add)).otherwise(empty)


def _n_hit(hits: Column) -> Column:
    """How many words lie in hits, which are in the order of their positions."""
    begin = F.struct(F.lit(0).alias("stop"), F.lit(0).cast("long").alias("n"))

    def add(a: Column, x: Column) -> Column:
        stop = x["at"] + x["size"]
        return F.struct(F.greatest(a["stop"], stop).alias("stop"), (a["n"] + F.greatest(stop - F.greatest(x["at"], a["stop"]), F.lit(0))).alias("n"))

    return F.when(F.size(hits) > 0, F.aggregate(hits, begin, add, lambda a: a["n"])).otherwise(F.lit(0).cast("long"))


def flagged(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, most: int = MOST) -> DataFrame:
    """(doc_id, n_words, n_hit, items): the items whose windows occur in each document, sorted as strings.

    Only the figures of documents and the texts of hit windows are shuffled, by document. Rows of the
    same id and text are one group that knows their number, so nothing hangs on the order of rows.
    """
    found = with_hits(docs, benchmark, n, most)
    rows = found.select("doc_id", *_key(), F.size("__words").cast("long").alias("n_words"), _n_hit(F.col("__hits")).alias("n_hit"), F.array_distinct(F.transform("__hits", lambda x: x["gram"])).alias("grams"))
    rows = rows.select("doc_id", "__i", "__h", "n_words", "n_hit", F.posexplode_outer("grams").alias("k", "gram"))
    own = windows(benchmark, n).select(F.col("gram").alias("__gram"), "items")
    # rows without a hit take a key of their own, so a join by shuffle spreads them
    key = F.coalesce("gram", F.concat_ws("\0", F.lit(""), "__i", "__h"))
    if own.limit(most + 1).count() <= most:
        own = F.broadcast(own)
    joined = rows.join(own, key == F.col("__gram"), "left")
    one = joined.groupBy("doc_id", "__i", "__h", "n_words", "n_hit").agg(F.count_if(F.coalesce("k", F.lit(0)) == 0).alias("copies"), F.flatten(F.collect_set("items")).alias("items"))
    each = one.select("doc_id", "n_words", "n_hit", F.array_sort(F.array_distinct("items")).alias("items"), F.explode(F.sequence(F.lit(1).cast("long"), "copies")).alias("copy"))
    return each.drop("copy")


def decontaminated(docs: DataFrame, benchmark: DataFrame, remove: str = "spans", n: int = WINDOW, most: int = MOST) -> DataFrame:
    """Documents without hit spans (each hit word goes with what separates it from the next), or without hit documents.

    The columns are those of `docs`; while the benchmark is small no row is moved.
    """
    if remove not in ("spans", "documents"):
        raise ValueError(f"remove must be spans or documents, not {remove}")
    found = with_hits(docs, benchmark, n, most)
    hit = F.size("__hits") > 0
    if remove == "documents":
        return found.where(~hit).select(*[F.col(f"`{c}`") for c in docs.columns])
    raw, between = F.array_remove(F.split("text", _BETWEEN_RAW), ""), F.split("text", _WORD_RAW)
    tokens = F.zip_with(raw, F.slice(between, 2, F.size("__words")), lambda a, b: F.concat(a, b))
    spans = _spans(F.col("__hits"))
    # what is kept: before the first span, between two, after the last
    edges = F.concat(F.array(F.lit(1)), F.flatten(F.transform(spans, lambda s: F.array(s["start"], s["stop"]))), F.array(F.size("__words") + 1))
    kept = F.transform(F.sequence(F.lit(0), F.size("__edges") - 2, F.lit(2)), lambda k: F.array_join(F.slice("__tokens", F.get("__edges", k), F.get("__edges", k + 1) - F.get("__edges", k)), ""))
    out = found.withColumn("__tokens", F.when(hit, tokens)).withColumn("__edges", F.when(hit, edges)).withColumn("__first", F.when(hit, between[0]))
    text = F.when(hit, F.concat("__first", F.array_join(kept, ""))).otherwise(F.col("text"))
    return out.select(*[text.alias(c) if c == "text" else F.col(f"`{c}`") for c in docs.columns])
