"""Plain, slow versions of the operators, and shared inputs."""

import math
import random
import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
MESSY = "doc_id long, text string, lang string, source string, n_chars long, kept string, score double, t string, i int, r int"


def messy(spark, rows, parts=3):
    """(doc_id, text) rows as documents with columns whose names operators also use."""
    return spark.createDataFrame([(i, t, "en", f"src{(i or 0) % 20}", len(t or ""), "x", 0.5, "t", 1, 2) for i, t in rows], MESSY).repartition(parts)


def prose(seed, n, copies=0.2):
    """Random texts with shared passages, exact and near copies, ties, nulls and blanks."""
    rng = random.Random(seed)
    words = ["".join(rng.choice("abcdeé") for _ in range(rng.randrange(2, 8))) for _ in range(60)]
    passages = [" ".join(rng.choice(words) for _ in range(k)) for k in (8, 10, 11, 12, 14, 20, 60)]
    rows = []
    for i in range(n):
        parts = [rng.choice(passages) if rng.random() < 0.3 else " ".join(rng.choice(words) for _ in range(rng.randrange(1, 40))) for _ in range(rng.randrange(0, 6))]
        text = rng.choice([" ", "\n", ""]).join(parts)
        if rows and rng.random() < copies:
            text = rng.choice(rows)[1]
            if text and rng.random() < 0.5:
                w = text.split(" ")
                w[rng.randrange(len(w))] = f"new{i}"
                text = " ".join(w)
        rows.append((i, text))
    return rows + [(n, None), (n + 1, ""), (n + 2, " \n\t "), (None, rows[0][1]), rows[3], (4, "another text of the same id " * 3)]


def repeats(words):
    """The longest repeat that starts at each word."""
    n, out = len(words), []
    for i in range(n):
        best = 0
        for j in range(n):
            k = 0
            while i != j and i + k < n and j + k < n and words[i + k] == words[j + k]:
                k += 1
            best = max(best, k)
        out.append(best)
    return out


def covered(words, least):
    hit = set()
    for i, k in enumerate(repeats(words)):
        if k >= least:
            hit.update(range(i, i + k))
    return len(hit)


def removed(rows):
    """(id, bytes, spans, kept) after removal of 50-byte strings that start in a smaller id."""
    first = {}
    for i, t in rows:
        b = (t or "").encode()
        if i is not None:
            for p in range(len(b) - 49):
                first[b[p : p + 50]] = min(i, first.get(b[p : p + 50], i))
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        if i is not None:
            for p in range(len(b) - 49):
                if first[b[p : p + 50]] < i:
                    gone[p : p + 50] = [True] * 50
        spans = []
        for p, g in enumerate(gone):
            if g and (p == 0 or not gone[p - 1]):
                spans.append(p)
            if g and (p + 1 == len(b) or not gone[p + 1]):
                spans.append(p + 1)
        out.append((i, len(b), spans, bytes(x for x, g in zip(b, gone) if not g)))
    return out


def lowered(text):
    return bytes(c + 32 if 65 <= c <= 90 else c for c in (text or "").encode())


def ppm(texts, learn, order=5):
    """log10 probabilities by prediction by partial matching, method C with exclusion."""
    low = [lowered(t) for t in texts]
    counts = defaultdict(lambda: defaultdict(int))
    for t, use in zip(low, learn):
        s = bytes(order) + t + b"\0"
        for p in range(order, len(s) if use else 0):
            for k in range(order + 1):
                counts[s[p - k : p]][s[p]] += 1
    out = []
    for t in low:
        s, total = bytes(order) + t + b"\0", 0.0
        for p in range(order, len(s)):
            excluded: set = set()
            for k in range(order, -1, -1):
                seen = counts.get(s[p - k : p])
                if not seen:
                    continue
                offer = {x: n for x, n in seen.items() if x not in excluded}
                size = sum(offer.values()) + len(offer)
                if s[p] in offer:
                    total += math.log10(offer[s[p]] / size)
                    break
                if offer:
                    total += math.log10(len(offer) / size)
                excluded |= set(seen)
            else:
                total -= math.log10(256 - len(counts.get(b"", {})))
        out.append(total)
    return out


def shingles(text):
    w = WORD.findall((text or "").lower())
    return frozenset(tuple(w[k : k + 5]) for k in range(len(w) - 4)) if len(w) >= 5 else frozenset([tuple(w)] if w else [])


def near_groups(rows):
    """{row: (class id, links)} for (id, text) rows with an id, by all pairs."""
    rows = [r for r in rows if r[0] is not None]
    sets = [shingles(t) for _, t in rows]
    up = list(range(len(rows)))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    links = [0] * len(rows)
    for a in range(len(rows)):
        for b in range(a):
            both = len(sets[a] & sets[b])
            if both and 10 * both >= 8 * (len(sets[a]) + len(sets[b]) - both):
                links[a] += 1
                links[b] += 1
                up[top(a)] = top(b)
    low = {}
    for k, (i, _) in enumerate(rows):
        low[top(k)] = min(i, low.get(top(k), i))
    return [(rows[k][0], low[top(k)], links[k]) for k in range(len(rows))]


def levenshtein(a, b):
    p = list(range(len(b) + 1))
    for i, x in enumerate(a):
        row = [i + 1]
        for j, y in enumerate(b):
            row.append(min(p[j] + (x != y), p[j + 1] + 1, row[j] + 1))
        p = row
    return p[-1]
