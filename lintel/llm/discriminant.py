"""Quality classifier: a regularised quadratic discriminant over document statistics.

A text becomes some twenty figures (lengths, character classes, repetition,
vocabulary, line shapes), each transformed to be closer to normal: counts by
logarithms, shares by a shifted logit. Training gathers for each class the number
of documents, the sums and the sums of products, a bounded row for each task, and
sums them by Spark; no row is sampled. Each class covariance is shrunk to the
pooled one and to its diagonal, and its Cholesky factor is computed once on the
driver, inverted, and sent along. A document's score is the logistic of the
difference of the two log densities, whose Mahalanobis terms are products with the
cached inverse factors, divided by the softness that makes the learning rows
likeliest.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lintel.llm import common, repetition

FIGURES = [
    "words", "word_length", "word_spread", "symbols", "capitals", "digits", "stops", "shouts", "other_marks", "accents",
    "repeated_windows", "covered", "repeated_lines", "distinct_words", "distinct_letters", "line_words", "line_ends", "capital_words", "short_words", "long_words",
]
#: Standardised figures are cut here, so that one odd figure cannot decide alone.
CUT = 5.0
#: Shares of the pooled covariance and of the diagonal in each class covariance.
TO_POOLED, TO_DIAGONAL = 0.2, 0.2
#: Log-density differences are divided by one of these before the logistic, or they would all round to 0 or 1; the first where nothing is fitted.
SOFTNESS = 4.0
SOFTNESSES = 2.0 ** np.arange(-4, 25, 0.5)


def _class_table(chars: str | bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars.encode() if isinstance(chars, str) else chars)] = True
    return out


_TABLES = {
    "symbols": _class_table(repetition.SYMBOLS),
    "capitals": _class_table(bytes(range(65, 91))),
    "digits": _class_table(bytes(range(48, 58))),
    "stops": _class_table(".,;:"),
    "shouts": _class_table("!?"),
    "other_marks": _class_table("\"'()[]{}/\\@^_`~+=-"),
    "accents": _class_table(bytes(range(194, 245))),
    "letters": _class_table(bytes(range(97, 123)) + bytes(range(65, 91))),
}


def _share(part: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """A share as a logit, with half a case added to either side."""
    return np.log((part + 0.5) / (np.maximum(whole - part, 0) + 0.5))


def figures_of(texts: pa.Array) -> np.ndarray:
    """The transformed figures, one row a text; an empty text has finite ones, too."""
    n = len(texts)
    s = repetition.stats_of(texts, 8)
    buf, off = common.flat(texts)
    size = np.diff(off).astype(float)

    owner = np.repeat(np.arange(n), np.diff(off))
    histogram = np.bincount(owner * 256 + buf, minlength=256 * n).reshape(n, 256)
    c = {k: histogram @ t.astype(np.int64) for k, t in _TABLES.items()}
    values, row = common.words_of(texts)
    length = np.asarray(pc.utf8_length(values)).astype(float)
    words = s["n_words"].astype(float)
    sums, squares = (np.bincount(row, w, n) for w in (length, length**2))
    mean = sums / np.maximum(words, 1)
    spread = np.sqrt(np.maximum(squares / np.maximum(words, 1) - mean**2, 0))
    code, _ = common.codes_of(values)
    distinct = np.bincount(common.distinct(row.astype(np.int64) << 32 | code) >> 32, minlength=n)
    letters = (histogram > 0).sum(1)
    raw = _flat_first_bytes(values)
    line_count = histogram[:, 10] + 1
    ends = np.bincount(owner[:-1][(buf[1:] == 10) & (buf[:-1] == 46)], minlength=n)[:n] if len(buf) else np.zeros(n)
    count = lambda mask: np.bincount(row[mask], minlength=n)
    return np.stack(
        [
            np.log1p(words), np.log1p(mean), np.log1p(spread),
            _share(c["symbols"], size), _share(c["capitals"], c["letters"]), _share(c["digits"], size), _share(c["stops"], size), _share(c["shouts"], size), _share(c["other_marks"], size), _share(c["accents"], size),
            _share(s["n_repeat_words"], words), _share(s["n_covered_words"], words), _share(s["n_dup_lines"], line_count),
            _share(distinct, words), np.log1p(letters), np.log1p(words / line_count), _share(ends, line_count),
            _share(count((raw >= 65) & (raw <= 90)), words), _share(count(length <= 3), words), _share(count(length >= 12), words),
        ],
        axis=1,
    )


def _flat_first_bytes(values: pa.Array) -> np.ndarray:
    """The first byte of each word."""
    buf, off = common.flat(values)
    return buf[off[:-1]] if len(values) else np.zeros(0, np.uint8)


@dataclass
class Model:
    """Two classes' priors, means and Cholesky factors over standardised figures."""

    centre: np.ndarray
    scale: np.ndarray
    log_prior: np.ndarray
    mean: np.ndarray
    factor: np.ndarray
    inverse: np.ndarray
    softness: float = SOFTNESS

    @staticmethod
    def fitted(n: np.ndarray, sums: np.ndarray, products: np.ndarray, centre=None, scale=None) -> Model | None:
        """From each class's count, sums and sums of products; None without rows of both."""
        if min(n) < 2:
            return None
        d = sums.shape[1]
        total = n.sum()
        if centre is None:
            centre = sums.sum(0) / total
            scale = np.sqrt(np.maximum(np.diag(products.sum(0)) / total - centre**2, 1e-12))
        mean = sums / n[:, None]
        own = products / n[:, None, None] - mean[:, :, None] * mean[:, None, :]
        own /= scale[:, None] * scale[None, :]
        pooled = np.tensordot(n / total, own, 1)
        factor = np.empty_like(own)
        for k in range(2):
            s = (1 - TO_POOLED) * own[k] + TO_POOLED * pooled
            s = (1 - TO_DIAGONAL) * s + TO_DIAGONAL * np.diag(np.maximum(np.diag(s), 0.05))
            factor[k] = np.linalg.cholesky(s + 1e-6 * np.eye(d))
        return Model(centre, scale, np.log(n / total), (mean - centre) / scale, factor, np.tril(np.linalg.inv(factor)))

    def cut(self, x: np.ndarray) -> np.ndarray:
        """Standardised figures, cut."""
        return np.clip((x - self.centre) / self.scale, -CUT, CUT)

    def difference(self, x: np.ndarray) -> np.ndarray:
        """The log density of class 1 less that of class 0."""
        z, density = self.cut(x), []
        for k in range(2):
            away = self.inverse[k] @ (z - self.mean[k]).T
            density.append(self.log_prior[k] - np.log(np.diag(self.factor[k])).sum() - 0.5 * (away**2).sum(0))
        return density[1] - density[0]

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of class 1, softened."""
        return 1 / (1 + np.exp(np.clip(-self.difference(x) / self.softness, -700, 700)))


def with_figures(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(i, x): each row's id and its figures, as packed doubles."""

    def run(batches):
        for batch in batches:
            for part in common.pieces(batch, "t"):
                x = figures_of(part.column("t"))
                yield pa.RecordBatch.from_arrays([part.column("i"), pa.array([v.tobytes() for v in x], pa.binary())], ["i", "x"])

    return docs.select(docs[f"`{id_col}`"].try_cast("long").alias("i"), docs[f"`{text}`"].cast("string").alias("t")).mapInArrow(run, "i long, x binary")


def fit(figures: DataFrame, labels: DataFrame) -> Model | None:
    """The model of all `labels` (i, y) rows that have figures; y is 0 or 1, one row an id.

    Three passes over the labelled rows, each of which sums a fixed number of
    figures: means and spreads; the moments of the figures as they are scored, cut;
    the loss of each softness.
    """
    d = len(FIGURES)
    joined = common.checkpoint(figures.join(labels, "i").select("x", "y"))

    def summed(of, size: int) -> np.ndarray:
        def run(batches):
            flat = np.zeros(size)
            for batch in batches:
                if batch.num_rows:
                    flat += of(np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, d), batch.column("y").to_numpy())
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(size, dtype=np.int32)), pa.array(flat)], ["at", "v"])

        out = np.zeros(size)
        for at, v in joined.mapInArrow(run, "at int, v double").groupBy("at").agg(F.sum("v")).collect():  # a fixed number of rows
            out[at] = v
        return out

    def moments(x, y):
        own = [x[y == k] for k in range(2)]
        return np.concatenate([[len(v) for v in own], *(v.sum(0) for v in own), *((v.T @ v).ravel() for v in own)])

    def parts(flat):
        return flat[:2], flat[2 : 2 + 2 * d].reshape(2, d), flat[2 + 2 * d :].reshape(2, d, d)

    size = 2 + 2 * d + 2 * d * d
    rough = Model.fitted(*parts(summed(moments, size)))
    if rough is None:
        return None
    model = Model.fitted(*parts(summed(lambda x, y: moments(rough.centre + rough.cut(x) * rough.scale, y), size)), rough.centre, rough.scale)

    def losses(x, y):
        margin = np.where(y == 1, 1, -1) * model.difference(x)
        return np.logaddexp(0, -margin[:, None] / SOFTNESSES).sum(0)

    model.softness = float(SOFTNESSES[np.argmin(summed(losses, len(SOFTNESSES)))])
    return model


def scored(docs: DataFrame, labels: DataFrame, learn, id_col: str = "doc_id", text: str = "text", label: str = "quality") -> DataFrame:
    """One row per row of `docs`: id, `score` and `predicted`.

    `labels` has the id and a 0/1 column; `learn` is a condition on the id column
    `i` saying which of them to learn from. Labels that are null or neither 0 nor
    1 and ids that are null are not learnt from; an id labelled more than once
    counts once, with its lowest label; rows that repeat an id are all learnt
    from. An id that is no integer counts as null. A null text counts as empty. Without two rows of each class all scores
    are 0.5. An empty table gives an empty one. Other columns are left out.
    """
    common.ship(docs.sparkSession)
    figures = common.checkpoint(with_figures(docs, id_col, text))
    y = labels.select(labels[f"`{id_col}`"].try_cast("long").alias("i"), labels[f"`{label}`"].cast("int").alias("y"))
    y = y.where("i IS NOT NULL AND y IN (0, 1)").where(learn).groupBy("i").agg(F.min("y").alias("y"))
    model = fit(figures, y)

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            x = np.frombuffer(b"".join(batch.column("x").to_pylist()), np.float64).reshape(-1, len(FIGURES))
            score = model.scores(x) if model else np.full(len(x), 0.5)
            yield pa.RecordBatch.from_arrays([batch.column("i"), pa.array(score), pa.array((score >= 0.5).astype(np.int32))], ["i", "score", "predicted"])

    return figures.mapInArrow(run, "i long, score double, predicted int").withColumnRenamed("i", id_col)
