"""Repetition rules and the classifier."""

import math
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from lintel.llm import discriminant, queries, repetition
from tests.llm import brute


def test_suffix_array_against_all_pairs():
    rng = random.Random(5)
    for _ in range(120):
        docs = [[rng.randrange(3) for _ in range(rng.randrange(0, 25))] for _ in range(4)]
        word = np.array([x for d in docs for x in d], np.int64)
        text = np.array([k for k, d in enumerate(docs) for _ in d], np.int64)
        assert repetition.longest_repeats(word, text).tolist() == [x for d in docs for x in brute.repeats(d)]


def test_counts(spark):
    rows = brute.prose(1, 40) + [(900, "x " * 300), (901, "#a *b* |\n#a *b* |\n\n\n" * 5), (902, "é\x0bb\x0cc " * 4)]
    got = repetition.quality(brute.messy(spark, rows)).collect()
    want = []
    for i, t in rows:
        t = t or ""
        w = brute.WORD.findall(t)
        lines = [x for x in t.split("\n") if brute.WORD.search(x)]
        want.append((i, len(w), sum(map(len, w)), sum(t.count(c) for c in repetition.SYMBOLS), len(lines) - len(set(lines)), brute.covered(w, 3), brute.covered(w, 8), max(brute.repeats(w), default=0)))
    key = lambda r: repr(r)
    assert sorted(((r.doc_id, *[r[c] for c in repetition.FIELDS]) for r in got), key=key) == sorted(want, key=key)
    for r in got:
        base = r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words
        assert r.base_failed == base and r.kept == (not base and 100 * r.n_covered_words <= 30 * r.n_words and r.longest_repeat <= 50)


def test_long_text_and_filter(spark):
    long = " ".join(str(k) for k in range(200_000))
    df = brute.messy(spark, [(1, long), (2, "a b " * 100), (3, None)])
    out = repetition.filtered(df)
    assert [r.doc_id for r in out.collect()] == [1] and out.columns == df.columns
    assert repetition.filtered(df.where("false")).count() == 0


def test_query_matches_sql(spark, sf_dir, same_rows):
    same_rows(queries.op1_suffix_repetition(spark, sf_dir), queries.OP1_SQL)


def test_discriminant_held_out(spark, sf_dir):
    out = queries.op4_discriminant(spark, "/root/testdata/sf0.01").collect()
    labels = {r.doc_id: r.quality for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect()}
    held = [(r.score, labels[r.doc_id]) for r in out if r.held_out and r.doc_id in labels]
    good, bad = [s for s, y in held if y], [s for s, y in held if not y]
    auc = np.mean([(g > b) + 0.5 * (g == b) for g in good for b in bad])
    assert auc > 0.97 and np.mean([s >= 0.5 for s in good]) > 0.95
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 3 == 1) and r.predicted == (r.score >= 0.5) for r in out)


def test_discriminant_densities():
    rng = np.random.default_rng(0)
    x = [rng.normal(k, 1 + k, (400, 3)) for k in range(2)]
    n, sums, products = np.array([400.0, 400.0]), np.stack([v.sum(0) for v in x]), np.stack([v.T @ v for v in x])
    m = discriminant.Model.fitted(n, sums, products)
    z = (x[1][0] - m.centre) / m.scale
    away = np.clip(z, -discriminant.CUT, discriminant.CUT)
    by_hand = []
    for k in range(2):
        cov = m.factor[k] @ m.factor[k].T
        d = away - m.mean[k]
        by_hand.append(m.log_prior[k] - 0.5 * np.log(np.linalg.det(cov)) - 0.5 * d @ np.linalg.solve(cov, d))
    assert np.isclose(m.scores(x[1][:1])[0], 1 / (1 + np.exp((by_hand[0] - by_hand[1]) / discriminant.SOFTNESS)))


def test_figures_by_hand():
    texts = ["One two THREE!! 44, four. five\none two\n\none two", "", None, "Ää #x|y extraordinarily", "a b c a b c a b c"]
    share = lambda part, whole: math.log((part + 0.5) / (max(whole - part, 0) + 0.5))
    for t, row in zip(texts, discriminant.figures_of(pa.array(texts))):
        t = t or ""
        words, raw, lines = brute.WORD.findall(t), t.encode(), t.split("\n")
        size = [len(w) for w in words]
        mean = sum(size) / max(1, len(words))
        letters = sum(c.isascii() and c.isalpha() for c in t)
        among = lambda chars: sum(t.count(c) for c in chars)
        real = [x for x in lines if brute.WORD.search(x)]
        want = {
            "words": math.log1p(len(words)), "word_length": math.log1p(mean), "word_spread": math.log1p(math.sqrt(max(0, sum(n * n for n in size) / max(1, len(words)) - mean**2))),
            "symbols": share(among(repetition.SYMBOLS), len(raw)), "capitals": share(sum(c.isascii() and c.isupper() for c in t), letters), "digits": share(among("0123456789"), len(raw)), "stops": share(among(".,;:"), len(raw)), "shouts": share(among("!?"), len(raw)),
            "other_marks": share(among("\"'()[]{}/\\@^_`~+=-"), len(raw)), "accents": share(sum(194 <= b < 245 for b in raw), len(raw)), "repeated_windows": share(brute.covered(words, 3), len(words)), "covered": share(brute.covered(words, 8), len(words)),
            "repeated_lines": share(len(real) - len(set(real)), len(lines)), "distinct_words": share(len(set(words)), len(words)), "distinct_letters": math.log1p(len(set(raw))), "line_words": math.log1p(len(words) / len(lines)), "line_ends": share(t.count(".\n"), len(lines)),
            "capital_words": share(sum("A" <= w[0] <= "Z" for w in words), len(words)), "short_words": share(sum(n <= 3 for n in size), len(words)), "long_words": share(sum(n >= 12 for n in size), len(words)),
        }
        assert dict(zip(discriminant.FIGURES, row)) == pytest.approx(want), t


@pytest.mark.parametrize("labels", [[], [(1, 1)], [(1, 1), (2, 1), (3, None), (None, 0), (4, 7)]])
def test_discriminant_without_two_classes(spark, labels):
    df = brute.messy(spark, [(1, "a b"), (2, None), (3, ""), (None, "x" * 100_000)])
    y = spark.createDataFrame(labels, "doc_id long, quality int")
    got = discriminant.scored(df, y, F.lit(True)).collect()
    assert len(got) == 4 and {r.score for r in got} == {0.5}


def test_discriminant_empty(spark):
    df = brute.messy(spark, [(1, "a")]).where("false")
    assert discriminant.scored(df, spark.createDataFrame([], "doc_id long, quality int"), F.lit(True)).count() == 0
