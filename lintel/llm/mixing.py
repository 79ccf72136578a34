"""Mixing sources to target weights by hierarchical budgeting.

Weights sit on a tree of domains, languages and sources. A leaf's target is the
budget times its share along the path. A leaf can give at most its tokens times
the allowed epochs; what it falls short of goes to its siblings by their weights,
what they cannot take to the next level's siblings, and so on up to the root. Each
leaf then yields the shortest prefix that reaches its amount, of its documents in
seeded order, epoch after epoch, each epoch in an order of its own.

The tree is configuration, so budgets are settled on the driver over one row for
each configured leaf. Prefixes are cut without a sort of a whole leaf: documents
fall into ranges of their seeded hash of some RANGE_ROWS documents, the ranges'
token sums say where the cut lies, and only positions within a range are sorted, so
a leaf with a third of all rows is as parallel as any. Documents stay in place up to the epoch's last
range; there is one shuffle of ids and token counts, and none of texts.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lintel.llm.common import checkpoint

#: Documents of a range of the seeded hash at most, in the mean.
RANGE_ROWS = 4096
_WORD = r"[^\x20\x09-\x0D]+"


def token_count(text: Column) -> Column:
    """White-space separated words, the tokens of the budgets; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(_WORD)), F.lit(0)).cast("long")


def shared_out(amount: float, weights: dict, room: dict) -> dict:
    """An amount split by weights among those with room; what one cannot take goes to the others.

    Those that fill up are settled first and the rest is split again, so the
    result does not depend on any order.
    """
    out = {k: 0.0 for k in weights}
    open_ = {k for k in weights if weights[k] > 0 and room[k] > 0}
    left = min(amount, sum(room[k] for k in open_))
    while open_ and left > 1e-9:
        total = sum(weights[k] for k in open_)
        full = {k for k in open_ if left * weights[k] / total >= room[k]}
        if not full:
            for k in open_:
                out[k] = left * weights[k] / total
            break
        for k in full:
            out[k] = float(room[k])
        left -= sum(room[k] for k in full)
        open_ -= full
    return out


def budgets(tree: Mapping, room: Mapping[tuple, float], amount: float) -> dict[tuple, float]:
    """The amount of each leaf of {name: (weight, subtree or None)}.

    Shortages stay among siblings as far as these can take them, for a subtree's
    room is all its leaves' room: it is asked for no more than it can give, and
    splits all it is asked for.
    """

    def capacity(node, path) -> float:
        if node is None:
            return float(room.get(path, 0))
        return sum(capacity(sub, (*path, k)) for k, (w, sub) in node.items() if w > 0)

    out: dict[tuple, float] = {}

    def split(node, path, amount) -> None:
        if node is None:
            out[path] = amount
            return
        parts = shared_out(amount, {k: w for k, (w, _) in node.items()}, {k: capacity(sub, (*path, k)) for k, (_, sub) in node.items()})
        for k, (_, sub) in node.items():
            split(sub, (*path, k), parts[k])

    split(tree, (), amount)
    return out


def seeded(seed: int, epoch: Column, id_: Column) -> Column:
    """The order of an epoch: a hash of seed, epoch and id."""
    return F.md5(F.concat_ws(":", F.lit(str(seed)), epoch.cast("string"), F.coalesce(id_.cast("string"), F.lit(""))).cast("binary"))


def digits_for(rows: int) -> int:
    """The hexadecimal digits of the hash that part so many documents into ranges."""
    out = 0
    while rows > RANGE_ROWS << 4 * out:
        out += 1
    return out


def _leaf_key(path: tuple) -> str:
    return "\x1f".join(path)


def mixed(docs: DataFrame, tree: Mapping, levels: list[Column], tokens: Column, amount: float | None = None, share: float = 1.0, epochs: int = 1, seed: int = 0, id_col: str = "doc_id") -> DataFrame:
    """(id, leaf, tokens, epoch, position) of every document taken, once for each epoch it is taken in.

    `levels` are the three columns a document's leaf is read from (null as an
    empty name); a document whose leaf the tree does not name, or names with
    weight 0, is not taken. The budget is `amount` tokens, or `share` of the
    tokens of all named leaves. `position` is the tokens of the leaf before the
    document, over all epochs; a document is taken when it begins before the leaf's
    amount, so a leaf passes its amount by less than a document. Rows without an id
    are ordered as id "". Rows that repeat an id come one after the other, ordered by their tokens.
    Documents without tokens are taken if they begin before the cut. An empty table
    gives an empty one.
    """
    spark = docs.sparkSession
    names = [_leaf_key(p) for p in _leaves(tree)]
    leaf = F.concat_ws("\x1f", *[F.coalesce(c.cast("string"), F.lit("")) for c in levels])
    rows = docs.select(docs[f"`{id_col}`"].alias("i"), leaf.alias("leaf"), tokens.alias("n"))
    rows = checkpoint(rows.join(F.broadcast(spark.createDataFrame([(k,) for k in names], "leaf string")), "leaf", "left_semi"))
    # one row for each leaf of the configuration, so this is bounded by it
    counted = rows.groupBy("leaf").agg(F.sum("n").alias("n"), F.count("*").alias("rows")).collect()
    have, digits = {r.leaf: int(r.n) for r in counted}, {r.leaf: digits_for(r.rows) for r in counted}
    room = {p: have.get(_leaf_key(p), 0) * epochs for p in _leaves(tree)}
    wanted = budgets(tree, room, share * sum(have.values()) if amount is None else amount)
    # the order is by 8 hexadecimal digits, then the whole hash, so that ranges are prefixes
    quota = [(_leaf_key(p), e, min(max(a - e * have.get(_leaf_key(p), 0), 0.0), float(have.get(_leaf_key(p), 0)))) for p, a in wanted.items() for e in range(epochs)]
    plan = spark.createDataFrame([(k, e, q, float(e * have.get(k, 0)), digits.get(k, 0)) for k, e, q in quota if q > 0], "leaf string, epoch int, quota double, before double, digits int")
    used = rows.join(F.broadcast(plan), "leaf").withColumn("h", seeded(seed, F.col("epoch"), F.col("i"))).withColumn("bucket", F.substr("h", F.lit(1), F.col("digits")))
    sums = used.groupBy("leaf", "epoch", "bucket").agg(F.sum("n").alias("m"))
    # one row a range; Spark broadcasts them while they are few
    start = sums.withColumn("start", F.sum("m").over(Window.partitionBy("leaf", "epoch").orderBy("bucket")) - F.col("m")).drop("m")
    placed = used.join(start, ["leaf", "epoch", "bucket"]).where("start < quota")
    within = Window.partitionBy("leaf", "epoch", "bucket").orderBy("h", "i", "n").rowsBetween(Window.unboundedPreceding, -1)
    placed = placed.withColumn("at", F.col("start") + F.coalesce(F.sum("n").over(within), F.lit(0))).where("at < quota")
    return placed.select(F.col("i").alias(id_col), F.translate("leaf", "\x1f", "/").alias("leaf"), F.col("n").alias("tokens"), "epoch", (F.col("before") + F.col("at")).cast("long").alias("position"))


def _leaves(tree: Mapping, path: tuple = ()) -> list[tuple]:
    out = []
    for k, (_, sub) in tree.items():
        out += [(*path, k)] if sub is None else _leaves(sub, (*path, k))
    return out
