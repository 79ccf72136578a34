"""The audits of filters and of sources, and decontamination, against brute force."""

import random
import re
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F

from lintel.llm import decontaminate, filter_audit, queries, source_audit
from tests.llm import brute


def _failed(rows):
    """The letters each (id, text) row fails."""
    least = {}
    for i, t in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    out = []
    for i, t in rows:
        t = t or ""
        w = brute.WORD.findall(t)
        tests = [len(w) < 200, 100 * len(set(w)) < 50 * len(w), 100 * sum("A" <= c <= "Z" for c in t) > 2 * len(t), any(c in "#$%&*|" for c in t), i is not None and least[t] < i]
        out.append("".join(x for x, bad in zip("ABCDE", tests) if bad))
    return out


def _steps(cases):
    """{(part, order, step): counts} of (part, failed letters, good, toxic) documents, one document at a time."""
    out = {}
    for part in {c[0] for c in cases}:
        mine = [c[1:] for c in cases if c[0] == part]
        total = dict.fromkeys("ABCDE", 0)
        for order in map("".join, permutations("ABCDE")):
            left = mine
            for k, x in enumerate(order):
                gone = [c for c in left if x in c[0]]
                kept = [c for c in left if x not in c[0]]
                fails = [c for c in mine if x in c[0]]
                out[part, order, k + 1] = [len(kept), len(gone), len(fails) - len(gone), sum(c[0] == x for c in mine), sum(c[1] for c in gone), sum(c[2] for c in gone)]
                total[x] += len(gone)
                left = kept
        for order in map("".join, permutations("ABCDE")):
            for k, x in enumerate(order):
                out[part, order, k + 1].append(total[x])
    return out


def test_filter_audit(spark):
    long = " ".join(f"W{k}" for k in range(300))
    rows = brute.prose(11, 80) + [(200 + k, t) for k, t in enumerate([long, long, long.lower(), long + " #", "a b " * 150, "é" * 30, "\x0b\x0c", None, "100% sure", "100% sure"])] + [(None, long), (None, long), (200, long)]
    docs = brute.messy(spark, rows).withColumn("source", F.when(F.col("doc_id") % 7 == 0, None).when(F.col("doc_id") % 7 == 1, "").otherwise(F.col("source")))
    marks = {i: (i % 3 == 0, i % 5 == 0) for i in range(0, 210, 2)}
    labels = spark.createDataFrame([(i, int(g), int(t)) for i, (g, t) in marks.items()] + [(0, None, None), (None, 1, 1), (4, 0, 1), (999, 1, 1)], "doc_id long, quality int, toxic int")
    marks[4] = (marks[4][0], True)
    text = F.coalesce("text", F.lit(""))
    got = filter_audit.audit(docs, labels, queries.audit_conditions(text), F.col("source"), "E").collect()
    cases = []
    for (i, _), failed in zip(rows, _failed(rows)):
        source = "" if i is not None and i % 7 < 2 else f"src{(i or 0) % 20}"
        cases.append((source, failed, *(marks.get(i, (False, False)))))
    want = _steps(cases)
    assert len(got) == len(want) and len(want) % 600 == 0
    assert {(r.part, r.filter_order, r.step): list(r[3:]) for r in got} == want


def test_filter_audit_of_nothing(spark):
    docs, labels = brute.messy(spark, []), spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(docs, labels, queries.audit_conditions(F.col("text")), F.col("source"), "E").count() == 0
    one = brute.messy(spark, [(1, None)])
    got = filter_audit.audit(one, labels, {"x": F.lit(True), "y": F.lit(False)}, F.col("lang")).orderBy("filter_order", "step").collect()
    assert [tuple(r) for r in got] == [("en", "xy", 1, 0, 1, 0, 1, 0, 0, 2), ("en", "xy", 2, 0, 0, 0, 0, 0, 0, 0), ("en", "yx", 1, 1, 0, 0, 0, 0, 0, 0), ("en", "yx", 2, 0, 1, 0, 1, 0, 0, 2)]


def test_lattice_size(spark):
    assert filter_audit.lattice_paths(spark, "ABCDE").count() == 600
    one = spark.createDataFrame([("a", 0, 1, 0, 0)], "part string, failed int, n long, n_good long, n_toxic long")
    assert filter_audit.lattice_edges(one, "ABCDE").count() == 80


_W13 = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _hits(text, items, n):
    """(hit word positions, item ids) by comparing every window."""
    w = _W13.findall(brute.lowered(text).decode())
    hit, found = set(), set()
    for i, t in items:
        v = _W13.findall(brute.lowered(t).decode())
        grams = {tuple(v[k : k + n]) for k in range(max(1, len(v) - n + 1))} if v else set()
        for g in grams:
            for p in range(len(w) - len(g) + 1):
                if tuple(w[p : p + len(g)]) == g:
                    hit.update(range(p, p + len(g)))
                    found.add(i)
    return len(w), hit, sorted(str(i) for i in found if i is not None)


def _contaminated_rows():
    rng = random.Random(13)
    vocab = ["Ab", "b", "É", "é9", "d_d", "0", "x", "y"]
    text = lambda k: rng.choice([" ", "-", ", "]).join(rng.choice(vocab) for _ in range(k))
    items = [(k, text(rng.choice([12, 15, 30]))) for k in range(12)] + [(20, text(7)), (21, text(2) + " zz"), (22, "zz"), (23, ""), (24, None), (None, text(14)), (100, "x " * 30), (1, text(11))]
    rows = []
    for i in range(120):
        body = [text(rng.randrange(0, 25))]
        for _ in range(rng.randrange(0, 3)):
            w = _W13.findall((rng.choice(items)[1] or ""))
            a = rng.randrange(len(w) + 1)
            body += [" ".join(w[a : a + rng.choice([5, 9, 10, 11, 40])]).replace("b", "B").replace("É", "é" if rng.random() < 0.1 else "É"), text(rng.randrange(0, 9))]
        rows.append((i, rng.choice(["! ", " ", "\n"]).join(body)))
    return rows + [(500, None), (501, ""), (None, items[0][1]), (None, items[0][1]), rows[3], rows[3], (502, items[1][1] * 50)], items


@pytest.mark.parametrize("most", [20_000, 1])
@pytest.mark.parametrize("n", [10, 4])
def test_decontamination(spark, most, n):
    rows, items = _contaminated_rows()
    docs, bench = brute.messy(spark, rows), spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.flagged(docs, bench, n=n, most=most).collect()
    want = []
    for i, t in rows:
        k, hit, found = _hits(t, items, n)
        want.append((i, k, len(hit), found))
    key = lambda r: repr(tuple(r))
    assert sorted(map(tuple, got), key=key) == sorted(want, key=key)
    assert 20 < sum(r.n_hit > 0 for r in got) < len(rows)
    left = decontaminate.decontaminated(docs, bench, "documents", n=n, most=most)
    assert left.columns == docs.columns
    assert sorted((r.doc_id or 0, r.text or "") for r in left.collect()) == sorted((i or 0, t or "") for i, t in rows if not _hits(t, items, n)[1])
    cut = []
    for i, t in rows:
        _, hit, _ = _hits(t, items, n)
        parts = list(re.finditer(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or ""))
        if hit:
            ends = [m.start() for m in parts[1:]] + [len(t)]
            t = t[: parts[0].start()] + "".join(t[m.start() : e] for k, (m, e) in enumerate(zip(parts, ends)) if k not in hit)
        cut.append((i or 0, t or ""))
    assert sorted((r.doc_id or 0, r.text or "") for r in decontaminate.decontaminated(docs, bench, n=n, most=most).collect()) == sorted(cut)


def test_decontamination_without_a_benchmark(spark):
    docs, none = brute.messy(spark, [(1, "a b"), (None, None)]), spark.createDataFrame([], "item_id long, text string")
    assert sorted((r.doc_id or 0, r.n_words, r.n_hit, r["items"]) for r in decontaminate.flagged(docs, none).collect()) == [(0, 0, 0, []), (1, 2, 0, [])]
    assert decontaminate.decontaminated(docs, none).count() == 2 and decontaminate.flagged(brute.messy(spark, []), none).count() == 0
    long = brute.messy(spark, [(1, "q " * 200_000 + "a b c d e f g h i j k")])
    item = spark.createDataFrame([(5, "b c d e f g h i j k")], "item_id long, text string")
    assert [(r.n_words, r.n_hit, r["items"]) for r in decontaminate.flagged(long, item).collect()] == [(200_011, 10, ["5"])]


def _divergence(rows, least, top):
    """(lang, source, part, item): (value, rank) by the definition."""
    term = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    count, have, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for lang, source, t in rows:
        lang, source = lang or "", source or ""
        w = term.findall(brute.lowered(t).decode())
        groups[lang].add(source)
        count[lang, source].update(w)
        have[lang].update(set(w))
    out = {}
    for lang, sources in groups.items():
        kept = [w for w, k in have[lang].items() if k >= least]

        def shares(c, kept=kept):
            size = sum(c[w] for w in kept)
            return {w: 1 + 10**9 * (c[w] + 5) // (size + 5 * len(kept)) for w in kept}

        whole = shares(sum((count[lang, s] for s in sources), Counter()))
        p = {s: shares(count[lang, s]) for s in sources}
        for s in sources:
            pairs = [(sum(abs(p[s][w] - p[o][w]) for w in kept), o) for o in sources if o != s]
            terms = [(p[s][w] - whole[w], w) for w in kept if count[lang, s][w] > 0 and p[s][w] > whole[w]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                for k, (v, x) in enumerate(sorted(found, key=lambda f: (-f[0], f[1].encode()))[:most]):
                    out[lang, s, part, x] = (v, k + 1)
    return out


def test_source_divergence(spark, monkeypatch):
    monkeypatch.setattr(source_audit, "COUNT_BYTES", 2000)  # several counts a task, where the task is forked with it
    rng = random.Random(12)
    langs, sources = ["en", "en", "de", "", None, "one"], ["a", "b", "é", "", None, "src"]
    rows = [(rng.choice(langs), rng.choice(sources), t) for _, t in brute.prose(12, 300)] + [("none", "x", "1 2 3"), ("none", "y", None), ("zz", "x", "Ünï\x00Wort wort WORT"), ("en", "late", ""), ("en", "big", "word other " * 40_000)]
    rows = [(a if a != "one" else "one", s if a != "one" else "only", t) for a, s, t in rows]
    df = spark.createDataFrame([(k, t, a, s, "x", 1) for k, (a, s, t) in enumerate(rows)], "doc_id long, text string, lang string, source string, term string, n int").repartition(5)
    for least, top in ((30, 50), (5, 3), (10_000, 50)):
        got = source_audit.divergence(df, min_docs=least, top=top).collect()
        want = _divergence(rows, least, top)
        assert len(got) == len(want)
        assert {(r.lang, r.source, r.part, r["item"]): (r.value, r["rank"]) for r in got} == want
    assert any(k[2] == "term" for k in _divergence(rows, 30, 50)) and want["none", "x", "pair", "y"] == (0, 1)
    assert source_audit.divergence(df.where("false")).count() == 0


def test_source_divergence_beyond_64_bits(spark):
    sizes = spark.createDataFrame([("en", "a", "t", 10**12, None, None, 0), ("en", "b", "u", 10**12, None, None, 0), ("en", "a", None, 10**12, 2 * 10**12, 2, 0), ("en", "b", None, 10**12, 2 * 10**12, 2, 0)], "lang string, source string, term string, n long, lang_size long, n_terms long, b int").coalesce(1)
    got = sizes.mapInArrow(source_audit._compared(5, 10**9, 50), source_audit._FOUND_DDL).collect()
    p, q, low = 1 + 10**9 * (10**12 + 5) // (10**12 + 10), 1 + 10**9 * (10**12 + 5) // (2 * 10**12 + 10), 1 + 10**9 * 5 // (10**12 + 10)
    assert sorted(map(tuple, got)) == [("pair", "en", "a", "b", 2 * (p - low)), ("term", "en", "a", "t", p - q), ("term", "en", "b", "u", p - q)]
