"""Quality rules: repetition found with a suffix array over the words of a text.

All texts of a piece share one suffix array. It is built by prefix doubling on
(text, word) keys, so suffixes of different texts never compare, and only groups
that are still tied are sorted again: on prose two or three short rounds follow
the first sort. Each round's ranks are kept, and the longest common prefix of
neighbouring suffixes is read off them from the longest block to the shortest.

An interval of the suffix array whose common prefix is L words is a repeated
substring that cannot be extended to the right. Every occurrence of a repeat lies
in the longest repeat that starts at its first word, which is
max(lcp before, lcp after) words long, so the union of the maximal repeats'
spans is the union of these, and no interval needs to be listed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lintel.llm import common

SYMBOLS = "#*$%&|<>"  # fixed value of the contract
WINDOW = 3  # words of the base rule's windows

FIELDS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_covered_words", "longest_repeat"]
STATS = T.StructType([T.StructField(c, T.LongType(), False) for c in FIELDS])


def suffix_array(word: np.ndarray, text: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array and LCP array (in words) of many texts laid end to end.

    `text` numbers the text of each word and is ascending. `lcp[i]` is the common
    prefix of suffixes `sa[i-1]` and `sa[i]`, 0 where they belong to two texts.
    """
    n = len(word)
    if n == 0:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    end = np.searchsorted(text, text, side="right")
    key = text.astype(np.int64) << 32 | word.astype(np.int64)
    order = np.argsort(key)
    first = np.ones(n, bool)
    np.not_equal(key[order][1:], key[order][:-1], out=first[1:])
    head = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[order], rank[n] = head, -1
    levels = [rank.astype(np.int32)]
    tied = np.bincount(head, minlength=n)[head] > 1
    active, h = order[tied], 1
    while active.size:
        after = active + h
        second = np.where(after < end[active], rank[np.minimum(after, n)] + 1, 0)
        key = rank[active] << 32 | second
        order = np.argsort(key)
        active, key = active[order], key[order]
        at = np.arange(active.size)
        old = key >> 32
        opens_old = np.ones(active.size, bool)
        np.not_equal(old[1:], old[:-1], out=opens_old[1:])
        opens = np.ones(active.size, bool)
        np.not_equal(key[1:], key[:-1], out=opens[1:])
        old_head = np.maximum.accumulate(np.where(opens_old, at, 0))
        new_head = np.maximum.accumulate(np.where(opens, at, 0))
        rank[active] = old + (new_head - old_head)
        levels.append(rank.astype(np.int32))
        active = active[np.bincount(new_head, minlength=active.size)[new_head] > 1]
        h *= 2
    sa = np.empty(n, np.int64)
    sa[rank[:n]] = np.arange(n)
    lcp = np.zeros(n, np.int64)
    near = np.flatnonzero(levels[0][sa[1:]] == levels[0][sa[:-1]]) + 1
    a, b = sa[near - 1].copy(), sa[near].copy()
    for k in range(len(levels) - 1, -1, -1):
        same = levels[k][a] == levels[k][b]
        step = np.int64(1 << k)
        lcp[near[same]] += step
        a[same] = np.minimum(a[same] + step, n)
        b[same] = np.minimum(b[same] + step, n)
    return sa, lcp


def longest_repeats(word: np.ndarray, text: np.ndarray) -> np.ndarray:
    """For each word, the length of the longest repeat of its text that starts there."""
    sa, lcp = suffix_array(word, text)
    out = np.zeros(len(word), np.int64)
    if len(word):
        out[sa] = np.maximum(lcp, np.append(lcp[1:], 0))
    return out


def covered(repeat: np.ndarray, least: int) -> np.ndarray:
    """Which words lie in a repeat of at least `least` words."""
    at = np.flatnonzero(repeat >= least)
    edge = np.zeros(len(repeat) + 1, np.int64)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + repeat[at], -1)
    return np.cumsum(edge[:-1]) > 0


def stats_of(texts: pa.Array, min_repeat: int) -> dict[str, np.ndarray]:
    """The figures of each text."""
    n = len(texts)
    values, row = common.words_of(texts)
    word, _ = common.codes_of(values)
    repeat = longest_repeats(word, row)
    buf, off = common.flat(texts)
    symbols = np.concatenate([[0], np.cumsum(np.isin(buf, np.frombuffer(SYMBOLS.encode(), np.uint8)))])
    lines = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    line_row = np.repeat(np.arange(n), np.diff(np.asarray(lines.offsets)))
    flat_lines = lines.flatten()
    worded = np.asarray(pc.greater(pc.binary_length(pc.ascii_trim_whitespace(flat_lines)), 0))
    line, _ = common.codes_of(flat_lines.filter(pa.array(worded)))
    line_row = line_row[worded]
    pairs = common.distinct(line_row.astype(np.int64) << 32 | line.astype(np.int64))
    count = lambda rows, weights=None: np.bincount(rows, weights, n).astype(np.int64)
    longest = np.zeros(n, np.int64)
    np.maximum.at(longest, row, repeat)
    return {
        "n_words": count(row),
        "word_chars": count(row, np.asarray(pc.utf8_length(values))),
        "n_symbols": symbols[off[1:]] - symbols[off[:-1]],
        "n_dup_lines": count(line_row) - count(pairs >> 32),
        "n_repeat_words": count(row[covered(repeat, WINDOW)]),
        "n_covered_words": count(row[covered(repeat, min_repeat)]),
        "longest_repeat": longest,
    }


def with_repetition(docs: DataFrame, text: str = "text", out: str = "repetition", min_repeat: int = 8) -> DataFrame:
    """`docs` with a struct column `out` of word, symbol, line and repetition counts.

    One pass over the rows, no shuffle. A null text counts as a text without
    words; rows are independent, so repeated rows and null ids are no special
    case; an empty table gives an empty table. A column already named `out` is
    replaced; all others pass through unchanged.
    """
    common.ship(docs.sparkSession)
    src = docs.select(F.struct(*[docs[f"`{c}`"] for c in docs.columns if c != out]).alias("r"), docs[f"`{text}`"].cast("string").alias("t"))
    schema = T.StructType([src.schema["r"], T.StructField("s", STATS)])

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "t"):
                s = stats_of(part.column("t"), min_repeat)
                s = pa.StructArray.from_arrays([pa.array(s[c], pa.int64()) for c in FIELDS], FIELDS)
                yield pa.RecordBatch.from_arrays([part.column("r"), s], ["r", "s"])

    return src.mapInArrow(run, schema).select("r.*", F.col("s").alias(out))


def rule(s, max_covered_percent: int = 30, max_longest: int = 50, min_words: int = 50):
    """(base_failed, kept) of a `with_repetition` struct column, as expressions.

    The base rule fails short texts and texts with over half of their words in
    repeated 3-word windows. Of the others those are kept of which at most
    `max_covered_percent` of the words lie in long repeats, none of them over
    `max_longest` words.
    """
    base = (s["n_words"] < min_words) | (100 * s["n_repeat_words"] > 50 * s["n_words"])
    fine = (100 * s["n_covered_words"] <= max_covered_percent * s["n_words"]) & (s["longest_repeat"] <= max_longest)
    return base, ~base & fine


def quality(docs: DataFrame, text: str = "text", min_repeat: int = 8, **limits) -> DataFrame:
    """Every row of `docs` with the counts, `base_failed` and `kept`."""
    rows = with_repetition(docs, text, "__repetition", min_repeat)
    s = rows["__repetition"]
    base, kept = rule(s, **limits)
    extra = [s[c].alias(c) for c in FIELDS] + [base.alias("base_failed"), kept.alias("kept")]
    names = {*FIELDS, "base_failed", "kept"}
    return rows.select(*[rows[f"`{c}`"] for c in docs.columns if c not in names], *extra)


def filtered(docs: DataFrame, text: str = "text", min_repeat: int = 8, **limits) -> DataFrame:
    """The rows of `docs` that the rules keep, with the columns of `docs`."""
    rows = with_repetition(docs, text, "__repetition", min_repeat)
    return rows.where(rule(rows["__repetition"], **limits)[1]).select(*[rows[f"`{c}`"] for c in docs.columns])
