"""Near-duplicate lines: SimHash, pigeonhole blocks, edit similarity, connected groups.

A line is normalised by lower-casing and by joining its words with one space.
Lines with equal normal forms are one from the start. Each distinct line gets a
SimHash of the character trigrams of its words, and *blocks* to meet others by:
its tokens are dealt by their hashes to groups of about three, and each group's
own SimHash is a block. An edit touches the groups of the tokens it takes away and
brings, so of G groups at least G - c stay equal when c tokens change (the
pigeonhole), and where a token changes only in part its group's SimHash may. The
number of groups follows the length, in classes that overlap so far that any two
lines of allowed lengths have one in common; several dealings give short lines as
many blocks as long ones. Tokens are words from WORDS characters on (long runs
without a space are cut where their characters say so) and character trigrams up to
TRIGRAMS characters. Texts up to EXACT characters also meet by what is left after
each way to take out as many characters as the similarity allows, so that of these
no pair is missed.

Lines that share a block are candidates if their whole SimHashes are near; hot
blocks are compared by pairs of chunks in tasks of their own. Of a block with more
than SMALL lines a smallest spanning forest of the near pairs is taken first. Each
distinct candidate pair has its two texts brought together once and is compared by
edit similarity, many pairs side by side. Then such blocks are looked at once more: of their near pairs all
whose lines are still in different components are compared as well, so what comes
out is what comparing all near pairs of all blocks gives, without comparing those
within a group that is joined already. Of each component of the alike pairs the first
occurrence stays, by document id (null last), hash of the text and line number.
"""

from __future__ import annotations

import zlib
from itertools import combinations

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm import common
from lintel.llm.common import mix64, pack, unpack
from lintel.llm.components import components

MIN_WORDS = 5
SIMILARITY = 0.8
#: Lines up to EXACT characters meet by deletions, from SHORT to TRIGRAMS by trigrams, from WORDS on by words.
EXACT, SHORT, TRIGRAMS, WORDS = 14, 12, 60, 48
#: Characters of a line for each group of tokens, and blocks that a line has at most, for words and for trigrams.
WORD_SPAN, TRIGRAM_SPAN = 13, 3
WORD_BLOCKS, TRIGRAM_BLOCKS = 12, 40
#: Tokens and letters without which a group is too common to be a block.
LEAST_TOKENS, LEAST_LETTERS = (2, 3), 9
#: Longer tokens are cut.
TOKEN = 16
#: Bits by which SimHashes of candidates may differ, of 128.
APART = 36
#: Pieces of text whose lines are dealt together.
PIECES = 4
#: Lines of a block up to which its pairs are all compared at once, and lines in a chunk of a hot block.
SMALL, BLOCK = 12, 2048
#: Lines that are compared with a block's lines at a time.
ROWS = 256
#: Pairs whose characters are counted at a time.
PAIRS = 2000
#: Edit distances that are computed side by side: pairs by the diagonals they need, how much longer than the shortest, and steps between two looks at which are decided.
CELLS, LONGER, STEPS = 40_000, 1.3, 32
#: Characters from which pairs are first tried by their words and by counts of their characters.
LONG = 4000
_MULT = mix64(np.arange(1, 12, dtype=np.uint64) * np.uint64(0xA0761D6478BD642F)) | np.uint64(1)


def split_lines(texts: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(lines, text of each, its number in its text)."""
    lists = pc.split_pattern(pc.fill_null(texts, ""), "\n")
    counts = np.diff(np.asarray(lists.offsets)).astype(np.int64)
    row = np.repeat(np.arange(len(lists)), counts)
    return lists.flatten(), row, np.arange(len(row)) - np.repeat(np.cumsum(counts) - counts, counts)


def simhash(word: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """64-bit SimHashes of lines, of the hashes of their words in line order.

    Bits are counted in byte lanes, eight to an integer, in runs of at most 255
    words.
    """
    out = np.zeros(n, np.uint64)
    if not len(word):
        return out
    lanes = np.unpackbits(word.astype(">u8").view(np.uint8).reshape(-1, 8), axis=1).view(np.uint64)
    size = np.bincount(line, minlength=n)
    within = np.arange(len(line)) - np.repeat(np.cumsum(size) - size, size)
    starts = np.flatnonzero(within % 255 == 0)
    sums = np.add.reduceat(lanes, starts, axis=0).view(np.uint8).reshape(-1, 64)
    owner = line[starts]
    first = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]]))
    counts = np.add.reduceat(sums.astype(np.int32), first, axis=0)
    full = owner[first]
    bits = np.packbits(2 * counts > size[full][:, None], axis=1)
    out[full] = bits.view(">u8")[:, 0]
    return out


class Forms:
    """Lines as words of lower case, with hashes of their normal forms and their lengths."""

    def __init__(self, lines: pa.Array):
        n = len(lines)
        self.lines = lines
        values, self.line = common.words_of(pc.utf8_lower(lines))
        self.size = np.bincount(self.line, minlength=n)
        self.code, self.words = common.codes_of(values)
        length = pc.utf8_length(self.words).to_numpy().astype(np.int64)
        self.chars, self.hash = np.zeros(n, np.int64), np.zeros((n, 2), np.int64)
        if len(self.line):
            self.name = mix64(pd.util.hash_array(self.words.to_numpy(zero_copy_only=False), categorize=False))
            self.length = length
            word = self.name[self.code]
            first = starts_of(self.line)
            own = self.line[first]
            within = (np.arange(len(self.line)) - np.repeat(first, self.size[own])).astype(np.uint64)
            for c in range(2):
                placed = mix64(word * _MULT[c] + within * _MULT[2 + c])
                self.hash[own, c] = np.add.reduceat(placed, first).view(np.int64)
            self.chars[own] = np.add.reduceat(length[self.code], first) + self.size[own] - 1

    def text(self, which: np.ndarray) -> list[str]:
        """Normal forms of the given lines."""
        return [normal_form(x) for x in self.lines.take(pa.array(which)).to_pylist()] if len(which) else []


def described(lines: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words, two 64-bit hashes of the normal form, characters of it) of lines."""
    f = Forms(lines)
    return f.size, f.hash, f.chars


def cut(token: str) -> list[str]:
    """A token in pieces of at most TOKEN characters, cut after characters that their code chooses."""
    if len(token) <= TOKEN:
        return [token]
    out, start = [], 0
    for k, c in enumerate(token):
        if k + 1 - start >= TOKEN or k + 1 - start >= 3 and ord(c) * 0x9E3779B1 >> 7 & 3 == 0:
            out.append(token[start : k + 1])
            start = k + 1
    return [*out, token[start:]] if start < len(token) else out


def sketches(word: np.ndarray, line: np.ndarray, n: int) -> np.ndarray:
    """128-bit SimHashes as two integers a line."""
    return np.stack([simhash(word, line, n), simhash(mix64(word + _MULT[6]), line, n)], axis=1)


def trigram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each trigram, its text) of texts of one character or more between two spaces, in text order."""
    code = np.frombuffer("".join(f" {t} " for t in texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.array([len(t) + 2 for t in texts], np.int64)
    gram = (code[:-2] * _MULT[4] + code[1:-1]) * _MULT[4] + code[2:]
    ends = np.cumsum(size)
    inside = np.ones(len(code), bool)
    inside[ends - 1] = inside[ends - 2] = False
    return mix64(gram[inside[:-2]]), np.repeat(np.arange(len(texts)), size - 2)


def starts_of(owner: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1]])) if len(owner) else np.zeros(0, np.int64)


def lanes(h: np.ndarray) -> np.ndarray:
    """The top 32 bits of hashes as bytes, eight to an integer."""
    raw = np.ascontiguousarray((h >> np.uint64(32)).astype(">u4"))
    return np.unpackbits(raw.view(np.uint8).reshape(-1, 4), axis=1).view(np.uint64)


def blocks(token: np.ndarray, letters: np.ndarray, line: np.ndarray, chars: np.ndarray, span: int, most: int, least: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """(line, block key) of lines' distinct tokens, given in line order as hashes with their letters.

    `chars` are the lines' lengths. A line of a length of 0.71 to 1.77 times span *
    2^g characters is dealt to 2^g groups, in as many dealings as give `most`
    blocks.
    """
    owners, keys = [], []
    low = np.ceil(np.log2(np.maximum(chars, 1) / span / 1.7678)).astype(np.int64)  # the smallest that is not too small
    for up in range(2):
        g = np.maximum(low + up, 0)
        fits = np.ones(len(chars), bool) if not up else (low >= 0) & (chars >= 0.7071 * span * 2.0**g)
        groups = np.int64(1) << np.maximum(g, 1)
        turns = np.where(fits, np.maximum(most // groups, 1), 0)
        for turn in range(int(turns.max(initial=0))):
            at = np.flatnonzero(turns[line] > turn)
            own = line[at]
            group = (mix64(token[at] + np.uint64(salt + 64 * turn)) >> np.uint64(32)).astype(np.int64) & groups[own] - 1
            use = group < most
            order = np.sort((own[use] * most + group[use]).astype(np.uint64) << np.uint64(24) | at[use].astype(np.uint64))
            place, at = (order >> np.uint64(24)).astype(np.int64), (order & np.uint64(0xFFFFFF)).astype(np.int64)
            start = starts_of(place)
            if not len(start):
                continue
            size = np.diff(np.append(start, len(place)))
            fair = (size >= least) & (size < 256) & (np.add.reduceat(letters[at], start) >= LEAST_LETTERS)
            ones = np.add.reduceat(lanes(token[at]), start, axis=0).view(np.uint8)
            block = np.packbits(2 * ones[fair].astype(np.int16) > size[fair][:, None], axis=1).view(">u4")[:, 0].astype(np.uint64)
            own = place[start[fair]] // most
            key = mix64(block + (place[start[fair]] % most + most * (turn + 64 * (g[own] + 64 * salt))).astype(np.uint64) * _MULT[5])
            owners.append(own)
            keys.append(key)
    if not owners:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    return np.concatenate(owners), np.concatenate(keys)


def some_lines(line: np.ndarray, n: int):
    """(line, slice of its tokens) bounds of runs of lines of some 100,000 tokens, or one line."""
    for lines in common.runs_of(np.cumsum(np.bincount(line, minlength=n)) // 100_000):
        a, b = np.searchsorted(line, [lines.start, lines.stop])
        if a < b:
            yield lines.start, slice(int(a), int(b))


def signatures(forms: Forms, which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of the given lines: (number among them of each item, its SimHash; item and key of each block).

    An item is a line as words, or as trigrams; some lines are both.
    """
    none = np.zeros(0, np.int64), np.zeros(0, np.uint64)
    chars = forms.chars[which]
    long, short = np.flatnonzero(chars >= WORDS), np.flatnonzero((chars >= SHORT) & (chars <= TRIGRAMS))
    items, sims, found = [long, short], [np.zeros((0, 2), np.uint64)] * 2, [none]
    if len(long):
        number = np.full(len(forms.size), -1)
        number[which[long]] = np.arange(len(long))
        line = number[forms.line]
        held = line >= 0
        line, code = line[held], forms.code[held]
        if (line[1:] < line[:-1]).any():
            order = np.argsort(line, kind="stable")
            line, code = line[order], code[order]
        name, length = forms.name, forms.length
        cuts = np.flatnonzero(length > TOKEN)
        if len(cuts):  # a cut word has its pieces behind the others
            pieces = [cut(x) for x in forms.words.take(pa.array(cuts)).to_pylist()]
            flat = np.array([x for p in pieces for x in p], object)
            begin, many = np.arange(len(name)), np.ones(len(name), np.int64)
            many[cuts] = [len(p) for p in pieces]
            begin[cuts] = len(name) + np.cumsum(many[cuts]) - many[cuts]
            name = np.concatenate([name, mix64(pd.util.hash_array(flat, categorize=False))])
            length = np.concatenate([length, [len(x) for x in flat]])
            count = many[code]
            within = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
            code, line = np.repeat(begin[code], count) + within, np.repeat(line, count)
        place = common.distinct((line * len(name) + code).astype(np.uint64)).astype(np.int64)  # each token counts once
        line, code = place // len(name), place % len(name)
        token = name[code]
        sims[0] = np.concatenate([sketches(token[s], line[s] - a, int(line[s.stop - 1]) - a + 1) for a, s in some_lines(line, len(long))])
        for a, s in some_lines(line, len(long)):
            own, key = blocks(token[s], length[code[s]], line[s] - a, chars[long[a:]], WORD_SPAN, WORD_BLOCKS, LEAST_TOKENS[0], 1)
            found.append((own + a, key))
    if len(short):
        gram, owner = trigram_hashes(forms.text(which[short]))
        order = np.lexsort((gram, owner))
        gram, owner = gram[order], owner[order]
        new = np.concatenate([[True], (np.diff(owner) != 0) | (np.diff(gram) != 0)])  # each counts once
        gram, owner = gram[new], owner[new]
        sims[1] = sketches(gram, owner, len(short))
        for a, s in some_lines(owner, len(short)):
            own, key = blocks(gram[s], np.full(s.stop - s.start, 3), owner[s] - a, chars[short[a:]], TRIGRAM_SPAN, TRIGRAM_BLOCKS, LEAST_TOKENS[1], 2)
            found.append((own + a + len(long), key))
    return np.concatenate(items), np.concatenate(sims), np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def deletion_keys(form: str) -> set[int]:
    """Hashes of what is left of a short text after as many deletions as a pair of such texts is allowed edits."""
    left = {form}
    for k in range(1, min(EXACT // 5, len(form) // 4) + 1):
        left.update("".join(c) for c in combinations(form, len(form) - k))
    return {zlib.crc32(x.encode("utf-8", "surrogatepass")) for x in left}


def normal_form(line: str) -> str:
    """Lower case, one space between words."""
    return " ".join(w for w in line.lower().translate({9: " ", 10: " ", 11: " ", 12: " ", 13: " "}).split(" ") if w)


def trimmed(a: str, b: str) -> tuple[str, str]:
    """Two texts without what both begin and end with."""
    i, n, step = 0, min(len(a), len(b)), 64
    while i < n:
        if a[i : i + step] == b[i : i + step]:
            i = min(i + step, n)
        elif step > 1:
            step //= 8
        else:
            break
    a, b = a[i:], b[i:]
    i, n, step = 0, min(len(a), len(b)), 64
    while i < n:
        if a[len(a) - i - min(step, n - i) : len(a) - i] == b[len(b) - i - min(step, n - i) : len(b) - i]:
            i = min(i + step, n)
        elif step > 1:
            step //= 8
        else:
            break
    return a[: len(a) - i], b[: len(b) - i]


def edit_distance(a: str, b: str, most: int | None = None) -> int:
    """Levenshtein distance by bit vectors, after what begins and ends alike is cut.

    With `most`, some number above it stands for all distances above it.
    """
    a, b = trimmed(a, b)
    if not a or not b:
        return len(a) + len(b)
    if len(a) > len(b):
        a, b = b, a
    at: dict[str, int] = {}
    for k, c in enumerate(a):
        at[c] = at.get(c, 0) | 1 << k
    full, top = (1 << len(a)) - 1, 1 << len(a) - 1
    plus, minus, score = full, 0, len(a)
    for k in range(0, len(b), 32):
        for c in b[k : k + 32]:
            eq = at.get(c, 0)
            xv = eq | minus
            xh = ((eq & plus) + plus ^ plus) | eq
            up = minus | ~(xh | plus) & full
            down = plus & xh
            if up & top:
                score += 1
            elif down & top:
                score -= 1
            up = (up << 1 | 1) & full
            down = down << 1 & full
            plus = (down | ~(xv | up)) & full
            minus = up & xv
        if most is not None and score - max(0, len(b) - k - 32) > most:  # each further character takes away one at most
            return most + 1
    return score


def most_edits(a: str, b: str) -> int:
    """A number of edits that surely is enough: words that differ, taken over as they come."""
    x, y = a.split(" "), b.split(" ")
    i = j = out = 0
    n, m = len(x), len(y)
    while i < n and j < m:
        if x[i] == y[j]:
            i, j = i + 1, j + 1
            continue
        for s in range(1, 9):  # the next equal words, not far off
            k = next((k for k in range(s + 1) if i + k < n and j + s - k < m and x[i + k] == y[j + s - k]), None)
            if k is not None:
                break
        else:
            s, k = 2, 1
        p, q = i + k, j + s - k
        out += max(sum(map(len, x[i:p])) + k, sum(map(len, y[j:q])) + s - k)
        i, j = p, q
    return out + max(sum(map(len, x[i:])) + n - i, sum(map(len, y[j:])) + m - j)


def alike(a: str, b: str) -> bool:
    """Whether 1 - distance / longer length reaches the similarity; in whole numbers."""
    most = allowed(max(len(a), len(b)))
    return abs(len(a) - len(b)) <= most and (a == b or len(a) > 40 and most_edits(a, b) <= most or edit_distance(a, b, most) <= most)


def _codes(texts: list[str], size: np.ndarray, before: int, rows: int, other: int, kind: type) -> np.ndarray:
    """A column of code points for each text, with `before` rows of `other` in front and what is left of `rows` behind."""
    out = np.full((len(texts), rows), other, kind)
    at = np.arange(rows) - before
    out[(at >= 0) & (at < size[:, None])] = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    return out.T


def _banded(a: list[str], b: list[str], n: np.ndarray, m: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Which pairs of texts, of n and m characters, are at most so many edits apart.

    The tables of all pairs are filled side by side, an antidiagonal at a time, in
    the band of diagonals that so few edits can reach. Even and odd diagonals have
    an array each; what lies before a table's first row or column stays beyond all
    limits, what lies behind its last is not asked for. A pair is given up once none
    of its cells can lead to its corner with few enough edits.
    """
    end, total = m - n, n + m
    low = min(2 * (int((end - most).min()) // 4) - 2, -2)
    high = max(-2 * (int(-(end + most).max()) // 4) + 2, 2)
    last, pad = int(total.max()), max(high, -low) + 2
    rows = last // 2 + 2 * pad + 2
    kind = np.uint16 if last < 10_000 and max(map(max, (*a, *b))) < "\ufff0" else np.uint32
    none, unit = 20_000 if kind == np.uint16 else 1 << 30, kind(1)
    x = np.ascontiguousarray(_codes(a, n, pad, rows, np.iinfo(kind).max, kind)[::-1])  # backwards, so that both are read upwards
    y = np.ascontiguousarray(_codes(b, m, pad, rows, np.iinfo(kind).max - 1, kind))
    who, out, ends = np.arange(len(a)), np.zeros(len(a), bool), set(total.tolist())
    even = np.arange(low, high + 1, 2)
    one = np.full((len(even), len(a)), none, kind)
    two = np.full((len(even) + 1, len(a)), none, kind)  # with an edge on each side
    one[-low // 2] = 0
    away, away_odd = (np.abs(d[:, None] - end).astype(kind) for d in (even, even[:-1] + 1))
    for t in range(1, last + 1):
        odd = t & 1
        i, j, k = rows - pad - (t - low - odd) // 2, pad - 1 + (t + low + odd) // 2, len(even) - odd
        differ = x[i : i + k] ^ y[j : j + k]
        np.minimum(differ, unit, out=differ)
        here, other = (two[1:-1], one) if odd else (one, two)
        step = np.minimum(other[:-1], other[1:])
        step += unit
        here += differ
        np.minimum(here, step, out=here)
        if t in ends:
            p = np.flatnonzero(total == t)
            out[who[p]] = here[(end[p] - low - odd) // 2, p] <= most[p]
        if t % STEPS == 0 and t < last:
            # each way passes one of two neighbouring antidiagonals
            best = np.minimum((one + away).min(0), (two[1:-1] + away_odd).min(0))
            stay = (total > t) & (best <= most)
            if not stay.any():
                break
            if 4 * np.count_nonzero(stay) < 3 * len(stay):
                one, two, x, y, away, away_odd = (np.compress(stay, z, axis=1) for z in (one, two, x, y, away, away_odd))
                who, end, total, most = who[stay], end[stay], total[stay], most[stay]
    return out


def within(a: list[str], b: list[str], most: np.ndarray) -> np.ndarray:
    """Which pairs of texts, none empty, are at most so many edits apart; pairs of like lengths go together."""
    n, m = (np.array([len(t) for t in x], np.int64) for x in (a, b))
    out = np.zeros(len(a), bool)
    order = np.flatnonzero(np.abs(n - m) <= most)
    order = order[np.argsort((n + m)[order], kind="stable")]
    total, start = (n + m)[order], 0
    while start < len(order):
        like = int(np.searchsorted(total, LONGER * total[start] + 16))
        at = order[start : min(like, start + max(1, CELLS // (int(most[order[start]]) + 2)))]
        out[at] = _banded([a[k] for k in at], [b[k] for k in at], n[at], m[at], most[at])
        start += len(at)
    return out


def alike_of(text: dict[int, str], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """`alike` of pairs of named texts."""
    out = np.zeros(len(u), bool)
    size = np.array([[len(text[x]), len(text[y])] for x, y in zip(u.tolist(), v.tolist())], np.int64).reshape(-1, 2)
    can = np.abs(size[:, 0] - size[:, 1]) <= allowed(size.max(1))
    long = np.flatnonzero(can & (size.max(1) > LONG))
    can[long] = may_be_alike(text, u[long], v[long])
    left = []
    for k in np.flatnonzero(can).tolist():
        a, b, most = text[int(u[k])], text[int(v[k])], int(allowed(size[k].max()))
        a, b = trimmed(a, b)
        if max(len(a), len(b)) <= most or len(a) > LONG and most_edits(a, b) <= most:
            out[k] = True
        elif a and b:
            left.append((k, a, b, most))
    if left:
        k, a, b, most = zip(*left)
        out[list(k)] = within(a, b, np.array(most, np.int64))
    return out


def sketches_near(h: np.ndarray, x, size: np.ndarray, y) -> np.ndarray:
    """Which SimHashes differ in at most APART bits, their lines' lengths allowing the similarity."""
    return (np.bitwise_count(h ^ x).sum(-1) <= APART) & keyed_alike(size, y)


def chunk_links(h: np.ndarray, size: np.ndarray) -> tuple[list, list]:
    """The smallest spanning forest, by bits that differ, of the near pairs of a chunk of rows in name order.

    Where one group's lines are nearer to each other than to other lines, the
    forest holds a tree of that group, whichever links outside it prove wrong. Of
    pairs equally near the one with the smaller names counts, in every chunk, so
    the blocks that some lines share have most links in common.
    """
    n = len(h)
    place, none = np.arange(n), np.int64(1) << 60

    def keys(x):
        """(bits, smaller place, larger place) of the pairs of rows x with all rows, as one integer."""
        d = np.bitwise_count(h ^ h[x]).sum(-1).astype(np.int64)
        out = (d << 40) | (np.minimum(place, x) << 20) | np.maximum(place, x)
        return np.where((d > APART) | ~keyed_alike(size, size[x]), none, out)

    whole = None
    if n <= 256:
        d = np.bitwise_count(h[:, None] ^ h[None]).sum(-1).astype(np.int64)
        whole = (d << 40) | (np.minimum(place[:, None], place) << 20) | np.maximum(place[:, None], place)
        whole[(d > APART) | ~keyed_alike(size[:, None], size)] = none
    u, v = [], []
    best, done, x = np.full(n, none), np.zeros(n, bool), 0
    for _ in range(n - 1):
        done[x] = True
        np.minimum(best, keys(x) if whole is None else whole[x], out=best)
        best[done] = none
        x = int(best.argmin())
        key = int(best[x])
        if key == none:  # the next tree
            x = int(done.argmin())
            continue
        u.append(key >> 20 & 0xFFFFF)
        v.append(key & 0xFFFFF)
    return u, v


def bucket_links(key: np.ndarray, h: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[slice]]:
    """(links' ends, hot buckets) of rows in key and name order.

    Buckets of up to SMALL rows have all pairs compared, all buckets at a time;
    larger ones have a smallest spanning forest of the near pairs, what it leaves
    out being for `apart_links`; those above BLOCK rows are handed back.
    """
    first = starts_of(key)
    many = np.diff(np.append(first, len(key)))
    small = np.repeat(many <= SMALL, many)
    us, vs, hot = [], [], []
    for d in range(1, min(SMALL, int(many.max(initial=1)))):
        at = np.flatnonzero((key[:-d] == key[d:]) & small[:-d])
        at = at[sketches_near(h[at], h[at + d], size[at], size[at + d])]
        us.append(at)
        vs.append(at + d)
    for f, m in zip(first[many > SMALL].tolist(), many[many > SMALL].tolist()):
        if m > BLOCK:
            hot.append(slice(f, f + m))
            continue
        u, v = chunk_links(h[f : f + m], size[f : f + m])
        us.append(np.array(u, np.int64) + f)
        vs.append(np.array(v, np.int64) + f)
    none = [np.zeros(0, np.int64)]
    return np.concatenate(us + none), np.concatenate(vs + none), hot


def apart_links(x: tuple, y: tuple | None = None):
    """(names, names) of near pairs of rows (name, SimHash, length, component) in different components.

    Of one chunk's rows among themselves, or of one chunk's with another's; some
    rows at a time.
    """
    name, h, size, root = x
    other, g, length, top = y or x
    for a in range(0, len(name), ROWS):
        r = slice(a, a + ROWS)
        near = root[r, None] != top
        if y is None:
            near &= np.arange(len(name))[r, None] < np.arange(len(name))
        u, v = np.nonzero(near)
        if len(u):
            ok = sketches_near(h[u + a], g[v], size[u + a], length[v])
            yield name[u[ok] + a], other[v[ok]]


def allowed(longer):
    """The edits that the similarity allows between texts of which one has so many characters."""
    return longer * (10 - round(10 * SIMILARITY)) // 10


def keyed_alike(size: np.ndarray, x) -> np.ndarray:
    """Which lengths allow the edit similarity to a text of length x."""
    return np.abs(size - x) <= allowed(np.maximum(size, x))


def letters(texts: list[str]) -> np.ndarray:
    """Counts of each text's characters, dealt to 64 classes."""
    out = np.zeros((len(texts), 64), np.int32)
    for row, t in zip(out, texts):
        row += np.bincount(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32) & 63, minlength=64).astype(np.int32)
    return out


def bigrams(texts: list[str]) -> np.ndarray:
    """Counts of each text's pairs of neighbouring characters, dealt to 256 classes, up to 255."""
    code = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    owner = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
    inner = owner[1:] == owner[:-1]
    kind = (code[:-1] * 31 + code[1:]) * 0x9E3779B1 >> 16 & 255
    counts = np.bincount((owner[1:] * 256 + kind)[inner], minlength=256 * len(texts))
    return np.minimum(counts, 255).astype(np.int16).reshape(-1, 256)


def may_be_alike(text: dict[int, str], u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Which pairs of named texts their pairs of characters do not show to be unlike.

    An edit takes away at most two such pairs and brings at most two, so no alike
    pair is ruled out.
    """
    size = np.array([[len(text[x]), len(text[y])] for x, y in zip(u.tolist(), v.tolist())], np.int64).reshape(-1, 2)
    out = np.zeros(len(u), bool)
    for r in common.runs_of(np.arange(len(u)) // PAIRS + np.cumsum(size.sum(1)) // common.PIECE_BYTES):
        names, at = np.unique(np.concatenate([u[r], v[r]]), return_inverse=True)
        count = bigrams([text[x] for x in names.tolist()])
        x, y = np.split(at, 2)
        out[r] = np.abs(count[x] - count[y]).sum(1) <= 4 * allowed(size[r].max(1))
    return out


def _spanning(texts: list[str]) -> list[tuple[int, int]]:
    """A spanning forest of the alike pairs of short texts.

    Pairs are left out beforehand only where lengths or counts of characters
    show that they cannot be alike: an edit changes at most two counts by one.
    """
    if len(texts) == 2:
        return [(0, 1)] if alike(*texts) else []
    size, count = np.array([len(x) for x in texts], np.int64), letters(texts)
    left, out = np.arange(len(texts)), []
    while len(left) > 1:
        queue, left = [int(left[0])], left[1:]
        while queue and len(left):
            x = queue.pop()
            can = keyed_alike(size[left], size[x]) & (np.abs(count[left] - count[x]).sum(1) <= 2 * allowed(np.maximum(size[left], size[x])))
            near = [k for k in np.flatnonzero(can) if alike(texts[x], texts[left[k]])]
            if near:
                out += [(x, int(left[k])) for k in near]
                queue += left[near].tolist()
                left = np.delete(left, near)
    return out


_FIRST = "struct<none: boolean, i: bigint, k: bigint, line: int>"


def _parcels(rows: list) -> pa.RecordBatch:
    """(shard, parcel) rows."""
    return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary())], ["to", "parcel"])


def _dealt(to: np.ndarray):
    """(shard, positions) of entries by their shard."""
    order = np.argsort(to, kind="stable")
    for r in common.runs_of(to[order]):
        yield int(to[order[r.start]]), order[r]


def _shards(values: np.ndarray, n: int):
    """(shard, positions) of values dealt by value."""
    yield from _dealt((mix64(values.astype(np.uint64)) % np.uint64(n)).astype(np.int32))


def _spans(begin: np.ndarray, many: np.ndarray) -> np.ndarray:
    """The positions of runs one after another."""
    many = many.astype(np.int64)
    return np.repeat(begin - (np.cumsum(many) - many), many) + np.arange(many.sum())


def _gathered(batches) -> list[tuple]:
    return [unpack(x) for batch in batches for x in batch.column("parcel").to_pylist()]


def _by_kind(batches) -> tuple[tuple | None, list[tuple]]:
    """(a shard's own parcel, of kind 0; all others)."""
    own, others = None, []
    for batch in batches:
        for kind, p in zip(batch.column("kind").to_pylist(), batch.column("parcel").to_pylist()):
            if kind:
                others.append(unpack(p))
            else:
                own = p
    return (None if own is None else unpack(own)), others


def _joined(parts: list[tuple], kinds: str) -> list[np.ndarray]:
    """Columns of parcels one after another; of no parcels, empty ones."""
    return [np.concatenate([p[c] for p in parts]) if parts else np.zeros(0, k) for c, k in enumerate(kinds.split())]


def line_drops(docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(i, k, drop): the numbers of the lines that go, of documents (i id, k text hash, t text).

    A line's occurrences and signature lie in the shard of its form's hash, as one
    row a shard; a form is called by its shard and its number there. What becomes
    rows is candidates and dropped lines.
    """
    spark = docs.sparkSession
    n = common.partitions(spark)

    def described_pieces(batches):
        for batch in batches:
            for part in common.pieces(batch, "t"):
                lines, row, number = split_lines(part.column("t"))
                forms = Forms(lines)
                keep = np.flatnonzero(forms.size >= max(1, min_words))
                ids = part.column("i")
                seen = (forms.hash[keep, 0], forms.hash[keep, 1], np.asarray(ids.is_null())[row[keep]], ids.fill_null(0).to_numpy()[row[keep]], part.column("k").to_numpy()[row[keep]], number[keep].astype(np.int32))
                name, which = np.unique(seen[0], return_index=True)
                which = keep[which]
                items, sim, own, key = signatures(forms, which)
                exact = np.flatnonzero((forms.chars[which] >= 4) & (forms.chars[which] <= EXACT))
                order = np.argsort(own, kind="stable")
                many = np.bincount(own, minlength=len(items))
                yield seen, (name[exact], np.array(forms.text(which[exact]), object)), (name[items], forms.chars[which[items]].astype(np.int32), sim, many.astype(np.int32)), key[order]

    def lines_of(batches):
        """Parcels of occurrences, of short lines' texts and of items with their blocks, by the shard of the form."""
        held = []

        def dealt():
            seen, exact, items = (tuple(np.concatenate(c) for c in zip(*(h[k] for h in held))) for k in range(3))
            key = np.concatenate([h[3] for h in held])
            held.clear()
            begin = np.cumsum(items[3], dtype=np.int64) - items[3]
            a, b = (dict(_shards(x[0], n)) for x in (exact, items))
            none = np.zeros(0, np.int64)
            rows = []
            for to, at in _shards(seen[0], n):
                e, i = a.get(to, none), b.get(to, none)
                took = _spans(begin[i], items[3][i])
                rows.append((to, pack(*(c[at] for c in seen)), pack(*(c[e] for c in exact), *(c[i] for c in items), key[took])))
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int32()), pa.array([r[1] for r in rows], pa.binary()), pa.array([r[2] for r in rows], pa.binary())], ["to", "seen", "signs"])

        for piece in described_pieces(batches):
            held.append(piece)
            if len(held) == PIECES:
                yield dealt()
        if held:
            yield dealt()
        common.give_back()

    def store(batches):
        """One row a shard: all occurrences by form, the first one first, and each form's signature once."""
        to, seen, signs = None, [], []
        for batch in batches:
            for x, a, b in zip(*(batch.column(c).to_pylist() for c in ("to", "seen", "signs"))):
                to = x
                seen.append(unpack(a))
                signs.append(unpack(b))
        if to is None:
            return
        h1, h2, none, i, k, line = (np.concatenate(c) for c in zip(*seen))
        seen.clear()
        order = np.lexsort((line, k, i, none, h2, h1))
        h1, h2 = h1[order], h2[order]
        start = np.flatnonzero(np.concatenate([[True], (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]))
        form = h1[start]
        exact, text, name, chars, sim, many, key = (np.concatenate([s[c] for s in signs]) for c in range(7))
        signs.clear()
        begin = np.cumsum(many, dtype=np.int64) - many
        e = np.unique(exact, return_index=True)[1]
        order_ = np.lexsort((sim[:, 0], name))  # a line's items as words and as trigrams differ in their SimHashes
        new = np.concatenate([[True], (np.diff(name[order_]) != 0) | (np.diff(sim[order_, 0]) != 0)]) if len(order_) else np.zeros(0, bool)
        it = order_[new]
        number = lambda x: np.searchsorted(form, x).astype(np.int32)
        parcels = [pack(none[order], i[order], k[order], line[order], start), pack(number(exact[e]), text[e], number(name[it]), chars[it], sim[it], many[it], key[_spans(begin[it], many[it])])]
        yield pa.RecordBatch.from_arrays([pa.array([to], pa.int32()), *(pa.array([p], pa.binary()) for p in parcels)], ["to", "seen", "signs"])
        common.give_back()

    dealt = docs.mapInArrow(lines_of, "to int, seen binary, signs binary").repartitionById(n, F.col("to"))
    stored = common.checkpoint(dealt.mapInArrow(store, "to int, seen binary, signs binary"), free=True)

    def deal(batches):
        """Blocks with their forms and SimHashes to the blocks' shards; ways to shorten short lines likewise."""
        for batch in batches:
            for own, signs in zip(batch.column("to").to_pylist(), batch.column("signs").to_pylist()):
                exact, text, form, chars, sim, many, key = unpack(signs)
                item = np.repeat(np.arange(len(many)), many)
                for to, p in _shards(key, n):
                    at = item[p]
                    yield _parcels([(to, pack(0, own, key[p], form[at], sim[at], chars[at]))])
                found = [(x, k) for k, t in enumerate(text.tolist()) for x in deletion_keys(t)]
                if found:
                    short, at = (np.array(c, np.int64) for c in zip(*found))
                    for to, p in _shards(short, n):
                        yield _parcels([(to, pack(1, own, short[p].astype(np.uint64), exact[at[p]], text[at[p]].tolist()))])

    def pairs_of(kind: int, u, v):
        """Links by the shard that compares them, each pair once."""
        u, v = np.minimum(u, v), np.maximum(u, v)
        order = np.lexsort((v, u))
        u, v = u[order], v[order]
        new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])]) & (u != v) if len(u) else np.zeros(0, bool)
        u, v = u[new], v[new]
        return [(kind, to, pack(u[p], v[p])) for to, p in _shards(mix64(u.view(np.uint64)) ^ v.view(np.uint64), n)]

    NEAR, SURE, HOT, LARGE = range(4)

    def chunk_pairs(block: tuple, key: int, same: bool):
        """Parcels of a hot block's pairs of chunks, each to a task of its own; with `same` also of one chunk alone."""
        edges = [*range(0, len(block[0]), BLOCK), len(block[0])]
        chunk = [tuple(c[a:b] for c in block) for a, b in zip(edges[:-1], edges[1:])]
        for x in range(len(chunk)):
            for y in range(x + (not same), len(chunk)):
                to = int(mix64(np.array([key + x * 65537 + y & 0xFFFFFFFFFFFFFFFF], np.uint64))[0] % np.uint64(n))
                yield common.parcel_batch([(HOT, to, pack(chunk[x], chunk[y] if x < y else None))])

    def meet(batches):
        parts = _gathered(batches)
        for kind in (0, 1):
            got = [p for p in parts if p[0] == kind]
            if not got:
                continue
            key = np.concatenate([p[2] for p in got])
            name = np.concatenate([(p[1] << 32) + p[3].astype(np.int64) for p in got])
            order = np.lexsort((name, key))
            key, name = key[order], name[order]
            if kind:
                text = [t for p in got for t in p[4]]
                u, v = [], []
                for r in common.runs_of(key):
                    for x, y in _spanning([text[k] for k in order[r]]):
                        u.append(name[r][x])
                        v.append(name[r][y])
                yield common.parcel_batch(pairs_of(SURE, np.array(u, np.int64), np.array(v, np.int64)))
                continue
            again = np.concatenate([[False], key[1:] == key[:-1]]) if len(key) else np.zeros(0, bool)
            again[:-1] |= again[1:]  # blocks of one line alone are most, and done with
            key, name, order = key[again], name[again], order[again]
            sim, chars = np.concatenate([p[4] for p in got])[order], np.concatenate([p[5] for p in got])[order].astype(np.int64)
            u, v, hot = bucket_links(key, sim, chars)
            yield common.parcel_batch(pairs_of(NEAR, name[u], name[v]))
            for r in hot:  # the forests of all pairs of chunks hold one of the whole
                yield from chunk_pairs((name[r], sim[r], chars[r]), int(key[r.start]), False)
            if len(key):  # lines that are near to no other need no second look
                first = starts_of(key)
                many = np.diff(np.append(first, len(key)))
                near = np.zeros(len(key), bool)
                near[u] = near[v] = True
                for r in hot:
                    near[r] = True
                at = np.flatnonzero(near & np.repeat(many > SMALL, many))
                if len(at):
                    yield common.parcel_batch([(LARGE, int(mix64(key[:1])[0] % np.uint64(n)), pack(key[at], name[at], sim[at], chars[at]))])

    def meet_chunks(batches):
        for batch in batches:
            for p in batch.column("parcel").to_pylist():
                name, sim, chars = (np.concatenate(c) for c in zip(*unpack(p)))
                u, v = chunk_links(sim, chars)
                yield common.parcel_batch(pairs_of(NEAR, name[np.array(u, np.int64)], name[np.array(v, np.int64)]))

    met = common.checkpoint(stored.select("to", "signs").mapInArrow(deal, "to int, parcel binary").repartitionById(n, F.col("to")).mapInArrow(meet, common.PARCEL_DDL), free=True)
    hot = met.where(F.col("kind") == HOT)
    large = met.where(F.col("kind") == LARGE)
    met = met.where(F.col("kind") <= SURE)
    if not hot.isEmpty():
        met = met.unionByName(hot.repartitionById(n, F.col("to")).mapInArrow(meet_chunks, common.PARCEL_DDL))

    def once(batches):
        """A shard's distinct pairs."""
        got: list = [[], []]
        to = None
        for batch in batches:
            for kind, t, p in zip(*(batch.column(c).to_pylist() for c in ("kind", "to", "parcel"))):
                to = t
                got[kind].append(unpack(p))
        for kind, parts in enumerate(got):
            if parts:
                u, v = _joined(parts, "i8 i8")
                order = np.lexsort((v, u))
                u, v = u[order], v[order]
                new = np.concatenate([[True], (u[1:] != u[:-1]) | (v[1:] != v[:-1])])
                yield common.parcel_batch([(kind, to, pack(u[new], v[new]))])

    pairs = met.repartitionById(n, F.col("to")).mapInArrow(once, common.PARCEL_DDL)
    pairs = common.checkpoint(pairs, free=True)

    def asked(batches):
        """Which shard has which lines of the pairs, and whether their texts are asked for or only their first occurrences."""
        for batch in batches:
            for kind, own, p in zip(*(batch.column(c).to_pylist() for c in ("kind", "to", "parcel"))):
                node = common.distinct(np.concatenate(unpack(p)))
                yield common.parcel_batch([(1, to, pack(kind != SURE, own, node[at])) for to, at in _dealt((node >> 32).astype(np.int32))])

    occurrences = stored.select(F.lit(0).alias("kind"), "to", F.col("seen").alias("parcel"))

    def answered(batches):
        """First occurrences of the lines that were asked for."""
        seen, questions = _by_kind(batches)
        if not questions:
            return
        node = common.distinct(np.concatenate([p[2] for p in questions]))
        near = np.zeros(len(node), bool)
        for text, _, some in questions:
            near[np.searchsorted(node, some)] |= text
        none, i, k, line, start = seen
        at = start[node & 0xFFFFFFFF]
        told = pa.StructArray.from_arrays([pa.array(none[at]), pa.array(i[at], mask=none[at]), pa.array(k[at]), pa.array(line[at])], ["none", "i", "k", "line"])
        yield pa.RecordBatch.from_arrays([pa.array(node), told, pa.array(near)], ["form", "first", "near"])

    firsts = occurrences.unionByName(pairs.mapInArrow(asked, common.PARCEL_DDL)).repartitionById(n, F.col("to"))
    firsts = common.checkpoint(firsts.mapInArrow(answered, f"form long, first {_FIRST}, near boolean"), free=True)

    def texts_of(batches):
        """Normal forms of lines to the shards of the forms."""
        for batch in batches:
            node, form = [], []
            for text, want in zip(batch.column("t").to_pylist(), batch.column("w").to_pylist()):
                lines = text.split("\n")
                node += [w["form"] for w in want]
                form += [normal_form(lines[w["line"]]) for w in want]
            node, form = np.array(node, np.int64), np.array(form, object)
            yield common.parcel_batch([(0, to, pack(node[at], form[at])) for to, at in _dealt((node >> 32).astype(np.int32))])

    # of all lines of candidate pairs once: the second look's lines are among them
    wanted = firsts.where("near").select("first.i", "first.k", F.struct("first.line", "form").alias("w")).groupBy("i", "k").agg(F.collect_list("w").alias("w"))
    texts = docs.join(wanted, docs["i"].eqNullSafe(wanted["i"]) & (docs["k"] == wanted["k"])).select("t", "w")
    texts = common.checkpoint(texts.mapInArrow(texts_of, common.PARCEL_DDL), free=True)

    def handed(batches):
        """Normal forms to the shards that compare them."""
        parts: list[list] = [[], []]
        for batch in batches:
            for kind, p in zip(batch.column("kind").to_pylist(), batch.column("parcel").to_pylist()):
                parts[kind].append(unpack(p))
        if not parts[1]:
            return
        node, form = (np.concatenate(c) for c in zip(*parts[0]))
        order = np.argsort(node, kind="stable")
        node, form = node[order], form[order]
        for _, by, some in parts[1]:
            yield common.parcel_batch([(HOT, by, pack(some, form[np.searchsorted(node, some)]))])

    def compare(batches):
        """The pairs whose texts are alike."""
        text: dict[int, str] = {}
        u, v = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for batch in batches:
            for kind, p in zip(batch.column("kind").to_pylist(), batch.column("parcel").to_pylist()):
                if kind == HOT:
                    names, forms = unpack(p)
                    text.update(zip(names.tolist(), forms.tolist()))
                elif kind == NEAR:
                    u, v = unpack(p)
                else:  # known already
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in unpack(p)], ["u", "v"])
        good = alike_of(text, u, v)
        yield pa.RecordBatch.from_arrays([pa.array(u[good]), pa.array(v[good])], ["u", "v"])
        text.clear()
        common.give_back()

    def alike_pairs(pairs: DataFrame) -> DataFrame:
        """The alike pairs (u, v) of distinct pairs by shard."""
        question = pairs.where(F.col("kind") == NEAR).mapInArrow(asked, common.PARCEL_DDL)
        held = texts.unionByName(question).repartitionById(n, F.col("to")).mapInArrow(handed, common.PARCEL_DDL)
        return pairs.unionByName(held).repartitionById(n, F.col("to")).mapInArrow(compare, "u long, v long")

    def grouped(links: DataFrame) -> DataFrame:
        """(form, top) of all lines that have a link."""
        linked = components(links).withColumnsRenamed({"node": "form", "root": "top"})
        return common.checkpoint(linked.unionByName(linked.select(F.col("top").alias("form"), "top").distinct()), free=True)

    linked = grouped(alike_pairs(pairs))

    def second_look(batches):
        """Large blocks' lines to the shards of their forms."""
        for batch in batches:
            for own, p in zip(batch.column("to").to_pylist(), batch.column("parcel").to_pylist()):
                key, name, sim, chars = unpack(p)
                for to, at in _dealt((name >> 32).astype(np.int32)):
                    yield common.parcel_batch([(LARGE, to, pack(own, key[at], name[at], sim[at], chars[at]))])

    def tops(batches):
        """Forms' components to the shards of the forms."""
        for batch in batches:
            form, top = (np.asarray(batch.column(c)) for c in ("form", "top"))
            yield common.parcel_batch([(NEAR, to, pack(form[at], top[at])) for to, at in _dealt((form >> 32).astype(np.int32))])

    def told_tops(batches):
        """Large blocks' lines with their components, back to the blocks' shards; a line without links is its own."""
        known, lines = [], []
        for batch in batches:
            for kind, p in zip(batch.column("kind").to_pylist(), batch.column("parcel").to_pylist()):
                (known if kind == NEAR else lines).append(p)
        form, top = _joined([unpack(p) for p in known], "i8 i8")
        order = np.argsort(form)
        form, top = form[order], top[order]
        for p in lines:
            own, key, name, sim, chars = unpack(p)
            root = name
            if len(form):
                at = np.minimum(np.searchsorted(form, name), len(form) - 1)
                root = np.where(form[at] == name, top[at], name)
            yield common.parcel_batch([(LARGE, own, pack(key, name, sim, chars, root))])

    def still_apart(batches):
        """Near pairs of large blocks' lines in different components."""
        parts = _gathered(batches)
        if not parts:
            return
        key, name, sim, chars, root = (np.concatenate(c) for c in zip(*parts))
        parts.clear()
        order = np.lexsort((name, key))
        key, root = key[order], root[order]
        for r in common.runs_of(key):
            if (root[r] == root[r.start]).all():
                continue
            block = tuple(c[order[r]] for c in (name, sim)) + (chars[order[r]].astype(np.int64), root[r])
            if len(block[0]) > BLOCK:
                yield from chunk_pairs(block, int(key[r.start]), True)
                continue
            for u, v in apart_links(block):
                yield common.parcel_batch(pairs_of(NEAR, u, v))

    def apart_chunks(batches):
        for batch in batches:
            for p in batch.column("parcel").to_pylist():
                for u, v in apart_links(*unpack(p)):
                    yield common.parcel_batch(pairs_of(NEAR, u, v))

    if not large.isEmpty():
        told = large.mapInArrow(second_look, common.PARCEL_DDL).unionByName(linked.mapInArrow(tops, common.PARCEL_DDL))
        told = told.repartitionById(n, F.col("to")).mapInArrow(told_tops, common.PARCEL_DDL)
        left = common.checkpoint(told.repartitionById(n, F.col("to")).mapInArrow(still_apart, common.PARCEL_DDL), free=True)
        hot = left.where(F.col("kind") == HOT)
        left = left.where(F.col("kind") != HOT)
        if not hot.isEmpty():
            left = left.unionByName(hot.repartitionById(n, F.col("to")).mapInArrow(apart_chunks, common.PARCEL_DDL))
        left = common.checkpoint(left.repartitionById(n, F.col("to")).mapInArrow(once, common.PARCEL_DDL), free=True)
        if not left.isEmpty():  # each of these lines has a near one, so its first occurrence was asked for before
            linked = grouped(alike_pairs(left).unionByName(linked.where("form <> top").select(F.col("form").alias("u"), F.col("top").alias("v"))))

    firsts = firsts.select("form", "first").join(linked, "form")
    kept = firsts.groupBy("top").agg(F.min("first").alias("stay"))
    moved = firsts.join(kept, "top").where("first <> stay").select("form", "stay.*")

    def staying(batches):
        for batch in batches:
            form, none, i, k, line = (batch.column(c).fill_null(0).to_numpy() if c == "i" else np.asarray(batch.column(c)) for c in ("form", "none", "i", "k", "line"))
            yield common.parcel_batch([(1, to, pack(form[at] & 0xFFFFFFFF, none[at], i[at], k[at], line[at])) for to, at in _dealt((form >> 32).astype(np.int32))])

    def dropped(batches):
        """Of each form all occurrences but its first, or all if another form's line stays for it."""
        seen, moves = _by_kind(batches)
        if seen is None:
            return
        gone = _joined(moves, "i8 ? i8 i8 i4")
        *rows, start = seen
        stay = [c[start] for c in rows]
        for c, g in zip(stay, gone[1:]):
            c[gone[0]] = g
        many = np.diff(np.append(start, len(rows[0])))
        out = np.zeros(len(rows[0]), bool)
        for c, s in zip(rows, stay):
            out |= c != np.repeat(s, many)
        none, i, k, line = (c[out] for c in rows)
        order = np.lexsort((line, k, i, none))
        none, i, k, line = (c[order] for c in (none, i, k, line))
        new = np.concatenate([[True], (none[1:] != none[:-1]) | (i[1:] != i[:-1]) | (k[1:] != k[:-1])]) if len(i) else np.zeros(0, bool)
        begin = np.flatnonzero(new)
        ends = pa.array(np.append(begin, len(line)).astype(np.int32))
        yield pa.RecordBatch.from_arrays([pa.array(i[begin], mask=none[begin]), pa.array(k[begin]), pa.ListArray.from_arrays(ends, pa.array(line))], ["i", "k", "drop"])

    gone = occurrences.unionByName(moved.mapInArrow(staying, common.PARCEL_DDL)).repartitionById(n, F.col("to")).mapInArrow(dropped, "i long, k long, drop array<int>")
    return common.checkpoint(gone.groupBy("i", "k").agg(F.array_distinct(F.flatten(F.collect_list("drop"))).alias("drop")), free=True)


def without_near_lines(docs: DataFrame, id_col: str = "doc_id", text: str = "text", n_lines: str | None = None, n_removed: str | None = None, min_words: int = MIN_WORDS) -> DataFrame:
    """`docs` with of each group of near-duplicate lines one occurrence left, over the whole table.

    Lines of fewer than `min_words` words always stay and start no group, and
    blank ones in any case. A null text stays null. A row without an id takes part after all
    others. Rows with one id and one text count as one document, so each keeps
    what it keeps. An empty table gives an empty one. All columns pass through;
    `n_lines` and `n_removed` name columns to add (a column so named is replaced).
    """
    common.ship(docs.sparkSession)
    added = [c for c in (n_lines, n_removed) if c]
    own = [c for c in docs.columns if c != text and c not in added]
    row = F.struct(*[docs[f"`{c}`"] for c in own]).alias("r") if own else F.struct(F.lit(0).alias("_")).alias("r")
    t = docs[f"`{text}`"].cast("string")
    src = docs.select(row, t.alias("t"), docs[f"`{id_col}`"].try_cast("long").alias("i"), F.xxhash64(t).alias("k"))
    drops = line_drops(src.where("t IS NOT NULL").select("i", "k", "t"), min_words).withColumnsRenamed({"i": "di", "k": "dk"})
    both = src.join(drops, src["i"].eqNullSafe(drops["di"]) & (src["k"] == drops["dk"]), "left").select("r", "t", "drop")
    both = both.withColumn("lines", F.when(F.col("drop").isNotNull(), F.split("t", "\n", -1)))
    stay = F.array_except(F.sequence(F.lit(0), F.size("lines") - 1), F.col("drop"))  # by hashing, so linear
    left = F.array_join(F.transform(stay, lambda k: F.get("lines", k)), "\n")
    values = {
        text: F.when(F.col("drop").isNull(), F.col("t")).otherwise(left),
        n_lines: F.coalesce(F.length("t") - F.length(F.replace("t", F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long"),
        n_removed: F.greatest(F.size("drop"), F.lit(0)).cast("long"),
    }
    return both.select(*[values[c].alias(c) if c == text else F.col(f"r.`{c}`") for c in docs.columns if c not in added], *[values[c].alias(c) for c in added])
