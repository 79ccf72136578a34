"""How filters interact: what each would remove, after which others, in every order.

A document counts for the filters it fails alone, so documents are first counted by
(part, set of failed filters). Each such class then adds to the edges of the
filters' lattice: an edge goes from the filters that are already applied to the
next one, 80 for five filters. An order of the filters is a path of edges; its steps
are joined with the counted edges, so the corpus is read once whatever the number of
orders.

Cases: a null text is empty; a null part is the empty string; a document without an
integer id neither is a copy nor makes others copies, and has no labels; rows that
repeat an id are counted one by one and are no copies of each other; several label
rows of an id count as their maximum; other columns are not looked at; an empty table
gives no rows.
"""

from __future__ import annotations

from itertools import combinations, permutations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Parts into which rows without an id are spread before the join with the labels.
SALT = 1024
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost")


def failure_classes(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], part: Column, copies: str | None = None) -> DataFrame:
    """(part, failed, n, n_good, n_toxic): documents by part and the bit set of the filters they fail.

    Bit k of `failed` is the k-th of `conditions`, the last one is that of `copies`: the
    text is that of a document with a smaller id, wherever that is. Copies are counted
    by (text, part, labels) before any two parts of a text meet, so a text that a third
    of all rows share is a few rows by then.
    """
    bits = [F.when(c, 1 << k).otherwise(0) for k, c in enumerate(conditions.values())]
    own = bits[0]
    for b in bits[1:]:
        own = own.bitwiseOR(b)
    # the names of the inputs' columns are left behind here: they may be anything
    rows = docs.select(F.col("doc_id").try_cast("long").alias("i"), F.coalesce(part.cast("string"), F.lit("")).alias("p"), F.sha2(F.coalesce("text", F.lit("")), 256).alias("h"), own.alias("m"))
    rows = rows.withColumn("k", F.when(F.col("i").isNull(), F.pmod(F.xxhash64("h", "p"), F.lit(SALT))).otherwise(0))
    flag = lambda c: F.max(F.when(F.col(c) == 1, 1).otherwise(0))
    marks = labels.select(F.col("doc_id").try_cast("long").alias("i"), "quality", "toxic").where("i IS NOT NULL").groupBy("i").agg(flag("quality").alias("good"), flag("toxic").alias("toxic")).withColumn("k", F.lit(0).cast("long"))
    rows = rows.join(marks, ["i", "k"], "left").na.fill(0, ["good", "toxic"])
    counted = rows.groupBy("i", "k", "h", "p", "m", "good", "toxic").agg(F.count("*").alias("n"))
    known = F.col("i").isNotNull()
    counted = counted.groupBy("h", "p", "m", "good", "toxic").agg(F.sum("n").alias("n"), F.sum(F.when(known, F.col("n")).otherwise(0)).alias("known"), F.min(F.when(known, F.struct("i", "n"))).alias("first"))
    if copies:
        counted = counted.withColumn("lowest", F.min("first.i").over(Window.partitionBy("h")))
        late = F.col("known") - F.when(F.col("first.i") == F.col("lowest"), F.col("first.n")).otherwise(0)
        sides = [F.struct(F.col("m").alias("failed"), (F.col("n") - late).alias("n")), F.struct(F.col("m").bitwiseOR(F.lit(1 << len(conditions))).alias("failed"), late.alias("n"))]
    else:
        sides = [F.struct(F.col("m").alias("failed"), F.col("n"))]
    each = counted.select("p", "good", "toxic", F.inline(F.array(*sides))).where("n > 0")
    return each.groupBy(F.col("p").alias("part"), "failed").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("good")).alias("n_good"), F.sum(F.col("n") * F.col("toxic")).alias("n_toxic"))


def lattice_edges(classes: DataFrame, letters: str) -> DataFrame:
    """(part, applied, next, and COUNTS): every class adds to every edge; n * 2^(n - 1) edges a part, zeros included."""
    size = len(letters)
    pairs = [(sum(1 << k for k in before), 1 << f) for f in range(size) for r in range(size) for before in combinations([k for k in range(size) if k != f], r)]
    edge = F.inline(F.array(*[F.struct(F.lit(a).alias("applied"), F.lit(b).alias("next")) for a, b in pairs]))
    rows = classes.select("*", edge)
    gone, fails = F.col("failed").bitwiseAND(F.col("applied")) != 0, F.col("failed").bitwiseAND(F.col("next")) != 0
    total = lambda cond, c="n": F.sum(F.when(cond, F.col(c)).otherwise(0))
    sums = [total(~gone & ~fails), total(~gone & fails), total(gone & fails), total(F.col("failed") == F.col("next")), total(~gone & fails, "n_good"), total(~gone & fails, "n_toxic")]
    return rows.groupBy("part", "applied", "next").agg(*[s.alias(c) for s, c in zip(sums, COUNTS)])


def lattice_paths(spark: SparkSession, letters: str) -> DataFrame:
    """(filter_order, step, applied, next): the n * n! steps of all orders, a fixed table."""
    steps = [(order, k + 1, sum(1 << letters.index(x) for x in order[:k]), 1 << letters.index(f)) for order in map("".join, permutations(letters)) for k, f in enumerate(order)]
    return spark.sql(f"SELECT * FROM VALUES {', '.join(map(str, steps))} AS t(filter_order, step, applied, next)")


def audit(docs: DataFrame, labels: DataFrame, conditions: dict[str, Column], part: Column, copies: str | None = None) -> DataFrame:
    """(part, filter_order, step, COUNTS, shapley): each step of each order of the filters, by part.

    `conditions` are failure conditions of a document by the filter's letter; `copies`
    is the letter of a filter that removes repeated texts. `shapley` is what the step's filter
    removes, summed over all orders. The number of rows is parts x n x n!.
    """
    letters = "".join(conditions) + (copies or "")
    edges = lattice_edges(failure_classes(docs, labels, conditions, part, copies), letters)
    steps = edges.join(F.broadcast(lattice_paths(docs.sparkSession, letters)), ["applied", "next"])
    shapley = F.sum("removed").over(Window.partitionBy("part", "next"))
    return steps.select("part", "filter_order", "step", *COUNTS, shapley.alias("shapley"))
