"""Shortest edit scripts between two lists of lines.

The longest common subsequence is found by halves: one list is cut in the middle, and
the place to cut the other follows from the lengths of the common subsequences of either half
with every prefix and suffix, which a row of bits holds. So memory is a few rows, and a
step works on all positions at once.
"""

from __future__ import annotations

import numpy as np


def _prefix_lengths(a: list[int], b: list[int]) -> np.ndarray:
    """For each k the length of the longest common subsequence of a[:k] and b."""
    n = len(a)
    places: dict[int, list[int]] = {}
    for k, x in enumerate(a):
        places.setdefault(x, []).append(k)
    often: dict[int, int] = {}  # masks of lines with many places; those are few
    full = (1 << n) - 1
    row = full
    for x in b:
        at = places.get(x)
        if not at:
            continue
        mask = often.get(x)
        if mask is None:
            mask = 0
            for k in at:
                mask |= 1 << k
            if len(at) > 8:
                often[x] = mask
        hit = row & mask
        row = ((row + hit) | (row - hit)) & full
    bits = np.unpackbits(np.frombuffer(row.to_bytes(n // 8 + 1, "little"), np.uint8), count=n, bitorder="little")
    return np.concatenate([[0], np.cumsum(1 - bits.astype(np.int64))])


def common(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Index pairs of a longest common subsequence, in order."""
    out = []
    todo = [(0, len(a), 0, len(b))]
    while todo:
        i, j, k, m = todo.pop()
        while i < j and k < m and a[i] == b[k]:
            out.append((i, k))
            i, k = i + 1, k + 1
        tail = 0
        while i < j and k < m and a[j - 1] == b[m - 1]:
            j, m, tail = j - 1, m - 1, tail + 1
        out += [(j + t, m + t) for t in range(tail)]
        if i == j or k == m:
            continue
        if m - k == 1:
            at = next((p for p in range(i, j) if a[p] == b[k]), None)
            if at is not None:
                out.append((at, k))
            continue
        mid = (k + m) // 2
        head = _prefix_lengths(a[i:j], b[k:mid])
        rest = _prefix_lengths(a[i:j][::-1], b[mid:m][::-1])[::-1]
        cut = i + int(np.argmax(head + rest))
        todo += [(i, cut, k, mid), (cut, j, mid, m)]
    return sorted(out)


def edits(old: list[str], new: list[str]) -> list[tuple[int, int, int, int]]:
    """(start in old, lines removed, start in new, lines added), from 0, in order; as few lines as possible."""
    codes: dict[str, int] = {}
    a, b = ([codes.setdefault(x, len(codes)) for x in side] for side in (old, new))
    # a line that the other side does not have is in no common subsequence
    both = set(a) & set(b)
    i, k = ([p for p, x in enumerate(side) if x in both] for side in (a, b))
    kept = [(i[p], k[q]) for p, q in common([a[p] for p in i], [b[q] for q in k])]
    out, x, y = [], 0, 0
    for p, q in [*kept, (len(a), len(b))]:
        if p > x or q > y:
            out.append((x, p - x, y, q - y))
        x, y = p + 1, q + 1
    return out


def patched(old: list[str], new: list[str], script: list[tuple[int, int, int, int]]) -> list[str]:
    """The old lines with a script applied, whose added lines are read off the new ones."""
    out, at = [], 0
    for i, gone, k, added in script:
        out += old[at:i] + new[k : k + added]
        at = i + gone
    return out + old[at:]


def unified(old: list[str], new: list[str], script: list[tuple[int, int, int, int]], context: int = 3) -> str:
    """The script as hunks with their surroundings; a last line without an end is marked."""
    groups: list[list[tuple[int, int, int, int]]] = []
    for e in script:
        if groups and e[0] - (groups[-1][-1][0] + groups[-1][-1][1]) <= 2 * context:
            groups[-1].append(e)
        else:
            groups.append([e])

    def put(sign: str, line: str) -> str:
        return f"{sign}{line}" if line.endswith("\n") else f"{sign}{line}\n\\ No newline at end of file\n"

    out = []
    for g in groups:
        low, high = max(0, g[0][0] - context), min(len(old), g[-1][0] + g[-1][1] + context)
        first = g[0][2] - (g[0][0] - low)
        grown = sum(e[3] - e[1] for e in g)
        count = (high - low, high - low + grown)
        start = [s + 1 if n else s for s, n in zip((low, first), count)]
        head = [str(s) if n == 1 else f"{s},{n}" for s, n in zip(start, count)]
        out.append(f"@@ -{head[0]} +{head[1]} @@\n")
        at = low
        for i, gone, k, added in g:
            out += [put(" ", x) for x in old[at:i]] + [put("-", x) for x in old[i : i + gone]] + [put("+", x) for x in new[k : k + added]]
            at = i + gone
        out += [put(" ", x) for x in old[at:high]]
    return "".join(out)
