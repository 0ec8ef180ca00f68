"""Quality classifier: a regularised quadratic discriminant on document statistics.

Each document becomes a short vector of transformed statistics of its whole
text. Per class, Spark sums the first and second moments over every labelled
training row; the two covariances are shrunk towards their pooled diagonal
and factored once (Cholesky). A document's score is the logistic of the
difference of the two log densities (Mahalanobis distances through the cached
factors) plus the log prior odds.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import lean, stored
from .texthash import CHUNK, give_back, raw_texts, slices, tidy, word_hashes, word_starts

FEATURES = ("log_bytes", "upper", "symbols", "bars", "digits", "exclaims", "punct", "mean_word", "blank_share", "line_repeat", "mean_line", "caps_start", "echo")
#: Share of the pooled diagonal in each class covariance.
SHRINKAGE = 0.1
THRESHOLD = 0.3
#: Labelled rows up to which a filter looks up their documents before it computes vectors; their ids are broadcast.
FEW_LABELS = 100_000

# Byte classes, one column each: upper, lower and non-ASCII, digit, '!', '|', plain punctuation, other symbols, white space.
_CLASSES = 8


def _byte_classes() -> np.ndarray:
    table = np.full(256, 6, dtype=np.uint8)
    table[[b for b in range(256) if chr(b).isascii() and chr(b).isupper()]] = 0
    table[[b for b in range(256) if b >= 128 or chr(b).islower()]] = 1
    table[[b for b in range(48, 58)]] = 2
    table[ord("!")] = 3
    table[ord("|")] = 4
    table[[ord(c) for c in ".,;:?'\"()-"]] = 5
    table[[9, 10, 11, 12, 13, 32]] = 7
    return table


_TABLE = _byte_classes()


def document_vectors(text: pa.Array) -> np.ndarray:
    """One row of ``FEATURES`` for each text; null is empty, an empty text is all zeros.

    Works on slices of about ``CHUNK`` bytes, so that the working arrays do not grow with the batch.
    """
    return np.vstack([np.zeros((0, len(FEATURES))), *(_slice_vectors(text.slice(a, b - a)) for a, b in slices(text, CHUNK))])


def _slice_vectors(text: pa.Array) -> np.ndarray:
    n = len(text)
    raw, bounds = raw_texts(text)
    starts = word_starts(raw, bounds)
    hashes, ends = word_hashes(raw, starts), np.searchsorted(starts, bounds)
    words = np.diff(ends).astype(float)
    size = np.diff(bounds).astype(float)
    of_doc = np.repeat(np.arange(n), np.diff(ends))
    caps = np.bincount(of_doc[_TABLE[raw[starts]] == 0], minlength=n)
    echo = np.zeros(n)
    if len(hashes) > 1:
        same = (hashes[1:] == hashes[:-1]) & (of_doc[1:] == of_doc[:-1])
        echo = np.bincount(of_doc[1:][same], minlength=n).astype(float)
    sums = np.zeros((n, 256))
    lines, distinct = np.ones(n), np.ones(n)
    view = raw.tobytes()
    for i in range(n):
        sums[i] = np.bincount(raw[bounds[i] : bounds[i + 1]], minlength=256)
        part = view[bounds[i] : bounds[i + 1]].split(b"\n")
        lines[i], distinct[i] = len(part), len(set(part))
    sums = sums @ np.eye(_CLASSES)[_TABLE]
    per_byte, per_word = 1 / np.maximum(size, 1), 1 / np.maximum(words, 1)
    upper, _, digits, bang, bars, punct, symbols, _ = sums.T
    body = np.maximum(size - sums[:, 7], 0)
    return np.column_stack([
        np.log1p(size), np.sqrt(upper * per_byte), np.sqrt(symbols * per_byte), np.sqrt(bars * per_word), np.sqrt(digits * per_byte), np.sqrt(bang * per_word),
        np.sqrt(punct * per_word), np.log1p(body * per_word), sums[:, 7] * per_byte, 1 - distinct / lines, np.log1p(size / lines), np.sqrt(caps * per_word), np.sqrt(echo * per_word),
    ])


def with_vectors(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id`` and the vector ``x`` for each row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = document_vectors(b.column(1))
            flat = pa.array(x.ravel(), pa.float64())
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(FEATURES)), flat)
            yield pa.RecordBatch.from_arrays([b.column(0), lists], ["id", "x"])

    return rows.mapInArrow(run, f"id {kind}, x array<double>")


@dataclass(frozen=True)
class Model:
    """Means and inverse Cholesky factors for the classes 0 and 1."""

    means: np.ndarray
    whiten: np.ndarray
    log_det: np.ndarray
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        gap = np.full(len(x), self.log_odds)
        for c, sign in ((0, -1.0), (1, 1.0)):
            z = (x - self.means[c]) @ self.whiten[c].T
            gap += sign * (-0.5 * (z * z).sum(axis=1) - 0.5 * self.log_det[c])
        return 1 / (1 + np.exp(-np.clip(gap, -40, 40)))


def fit(vectors: DataFrame, label: Column | str = "label", shrinkage: float = SHRINKAGE) -> Model | None:
    """Fit on ``vectors(x, label)``; rows whose label is neither 0 nor 1 are left out.

    Only sums leave the executors: d + d(d+1)/2 numbers for each class. None
    without two rows of either class.
    """
    d = len(FEATURES)
    pairs = [(i, j) for i in range(d) for j in range(i, d)]
    x = lambda i: F.get("x", i)
    label = F.col(label) if isinstance(label, str) else label
    sums = vectors.withColumn("label", label).filter(F.col("label").isin(0, 1)).groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.sum(x(i)) for i in range(d)]).alias("first"), F.array(*[F.sum(x(i) * x(j)) for i, j in pairs]).alias("second"))
    got = {int(r["label"]): r for r in sums.collect()}
    if any(c not in got or got[c]["n"] < 2 for c in (0, 1)):
        return None
    n = np.array([got[c]["n"] for c in (0, 1)], dtype=float)
    means = np.array([np.array(got[c]["first"]) / got[c]["n"] for c in (0, 1)])
    covs = np.zeros((2, d, d))
    for c in (0, 1):
        for (i, j), s in zip(pairs, got[c]["second"], strict=True):
            covs[c, i, j] = covs[c, j, i] = s / n[c] - means[c, i] * means[c, j]
    pooled = np.diag((covs * n[:, None, None]).sum(axis=0) / n.sum())
    target = np.diag(np.maximum(pooled, 1e-6))
    factors = [np.linalg.cholesky((1 - shrinkage) * c + shrinkage * target) for c in covs]
    return Model(means, np.array([np.linalg.inv(f) for f in factors]), np.array([2 * np.log(np.diag(f)).sum() for f in factors]), float(np.log(n[1] / n[0])))


def held_out(id_col: Column) -> Column:
    """The test fold: crc32 of the id as text is a multiple of 5; a null id is held out."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def _kept_column(model: Model | None, flat: float, threshold: float):
    def kept(text: pa.Array) -> pa.Array:
        x = document_vectors(text)
        give_back()
        return pa.array(np.full(len(x), flat) >= threshold if model is None else model.score(x) >= threshold, pa.bool_())

    kept.__annotations__ = {"text": pa.Array, "return": pa.Array}
    return F.arrow_udf(kept, "boolean")


def training_marks(labels: DataFrame, id_col: str, label_col: str) -> DataFrame:
    marks = labels.select(F.col(id_col).alias("lid"), F.col(label_col).cast("int").alias("label"))
    return marks.filter(~held_out(F.col("lid")) & F.col("label").isin(0, 1))


def trained(rows: DataFrame, marks: DataFrame, shrinkage: float) -> tuple[Model | None, float]:
    """The model from ``rows(id, x)`` and ``marks(lid, label)`` of the training fold; and the score where there is none."""
    train = rows.join(marks, F.col("id") == F.col("lid")).select("x", "label")
    model, flat = fit(train, "label", shrinkage), 0.5
    if model is None:
        share = marks.agg(F.avg("label")).first()[0]
        flat = flat if share is None else float(share)
    return model, flat


def without_rejected(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, shrinkage: float = SHRINKAGE) -> DataFrame:
    """The rows of ``docs`` that score at least ``threshold``, all columns as they were.

    Trains like ``quality_scores``, with the same rules for nulls, blanks, long
    texts, repeats and ids; the rows themselves are scored where they lie,
    without a shuffle. An empty table stays empty.
    """
    lean(docs.sparkSession)
    marks = training_marks(labels, id_col, label_col)
    named = docs
    if marks.count() <= FEW_LABELS:
        named = docs.join(F.broadcast(marks.select("lid")), docs[id_col] == F.col("lid"), "left_semi")
    model, flat = trained(with_vectors(named, id_col, text_col), marks, shrinkage)
    return docs.filter(_kept_column(model, flat, threshold)(F.col(text_col).cast("string")))


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", threshold: float = THRESHOLD, shrinkage: float = SHRINKAGE) -> DataFrame:
    """Score every row of ``docs``: ``id_col``, ``held_out``, ``score``, ``predicted``.

    Labels are learned only from rows outside the held-out fold; all of them
    are used. Null text is empty and gets a score like any other, texts of any
    length are measured whole; an empty table gives no rows; null labels and
    labels of unknown documents are left out. A document that several
    label rows name counts once for each. Repeated rows get the same score.
    Without two training rows in either class every score is the share of
    label 1 in training, 0.5 without any. Other columns are not looked at.
    """
    lean(docs.sparkSession)
    rows = stored(with_vectors(docs, id_col, text_col), "quality-vectors")
    model, flat = trained(rows, training_marks(labels, id_col, label_col), shrinkage)
    kind = rows.schema["id"].dataType.simpleString()

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy(zero_copy_only=False).reshape(len(b), -1)
            s = np.full(len(x), flat) if model is None else model.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64())], ["id", "score"])

    scored = rows.mapInArrow(run, f"id {kind}, score double")
    return scored.select(F.col("id").alias(id_col), held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
