"""Toxicity: cumulative-link ordinal regression on the words of a text.

Severity is an ordered grade, 0 and up.  For every step between grades the model gives
``P(grade > j) = sigmoid(weights . words - threshold[j])``; the weights are shared by all steps and the thresholds are
ordered.  The expected severity of a text is the sum of these probabilities.  With the two grades of a yes-or-no label
there is one threshold.

Features are the distinct words of a text, folded to lower case, and the first four to six bytes of longer words, so that
inflected forms share a feature; all as 64-bit hashes.  The model is fitted on at most
``MAX_LABELLED`` labelled documents, those with the smallest hash of their id, and keeps the ``MAX_FEATURES`` features that
go most clearly with the grade, in ``LEAST_DOCS`` documents at least and with a chi-square of ``LEAST_CLEAR`` at least.  Both bounds are what lets the fit run on
the driver; scoring reads all documents and all of their text, without a shuffle.

A document labelled more than once has its highest grade; labels without id or grade are not used; a label without a
document teaches nothing.  A null or empty text has no words and gets the severity of a text without any sign.  Without
labels, or with one grade only, every severity is that grade (0 without labels).  Every input row gives one row.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import chunks, in_arrow, table, texts
from shelfwise.llm.words import heads_of, scan_words, text_buffers

MAX_LABELLED = 20_000
MAX_FEATURES = 1_000
LEAST_DOCS = 5
#: Least chi-square (one degree of freedom) of a feature and the grade; noise among a million features stays below.
LEAST_CLEAR = 25.0
RIDGE = 1e-4
STEPS = 400
HEADS = (4, 5, 6)
PIECE_BYTES = 1 << 20

SCHEMA = "doc_id bigint, severity double, grade int, toxic boolean"
_ARROW = pa.schema([("doc_id", pa.int64()), ("severity", pa.float64()), ("grade", pa.int32()), ("toxic", pa.bool_())])


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -40, 40)))


class Model:
    """Sorted feature hashes, their weights, and the ordered thresholds."""

    def __init__(self, features: np.ndarray, weights: np.ndarray, thresholds: np.ndarray, lowest: int = 0):
        self.features, self.weights, self.thresholds, self.lowest = features, weights, thresholds, lowest

    def beyond(self, signs: np.ndarray) -> np.ndarray:
        """P(grade > j) for each row and step."""
        return _sigmoid(signs[:, None] - self.thresholds[None, :])

    def severity(self, column: pa.Array) -> np.ndarray:
        texts_of, features = present(column, self.features)
        signs = np.bincount(texts_of, weights=self.weights[features], minlength=len(column))
        return self.lowest + self.beyond(signs[: len(column)]).sum(axis=1)


def features_of(column: pa.Array) -> tuple[list[np.ndarray], np.ndarray]:
    """Hashes of all words and of their heads (0: none), side by side, and where each text's words start."""
    data, offsets = text_buffers(column)
    hashes, first, end, starts = scan_words(data, offsets, folded=True)
    return [hashes, *(heads_of(data, first, end, HEADS) if len(hashes) else [hashes] * len(HEADS))], starts


def present(column: pa.Array, features: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct features: number of the text, number of the feature."""
    if not len(features):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    found, starts = features_of(column)
    pairs = []
    for hashes in found:
        at = np.searchsorted(features, hashes)
        at[at == len(features)] = 0
        hits = np.flatnonzero(features[at] == hashes)
        pairs.append((np.searchsorted(starts, hits, side="right") - 1) * len(features) + at[hits])
    pairs = np.unique(np.concatenate(pairs))
    return pairs // len(features), pairs % len(features)


def fit(rows: list[np.ndarray], grades: np.ndarray, features: np.ndarray) -> Model:
    """Full-batch Adam on the likelihood with a ridge; rows hold the feature numbers of each document."""
    lowest, steps = int(grades.min()), int(grades.max() - grades.min())
    grades = grades - lowest
    lengths = np.array([len(r) for r in rows])
    document = np.repeat(np.arange(len(rows)), lengths)
    feature = np.concatenate(rows).astype(np.int64) if lengths.sum() else np.zeros(0, np.int64)
    # Thresholds as a first one and the logarithms of the gaps, so that they stay in order.
    shares = np.clip([(grades > j).mean() for j in range(steps)], 1e-3, 1 - 1e-3)
    starts = np.maximum.accumulate(np.log((1 - shares) / shares) + 1e-3 * np.arange(steps))
    parameters = np.concatenate([np.zeros(len(features)), starts[:1], np.log(np.maximum(np.diff(starts), 1e-3))])
    first, second = np.zeros_like(parameters), np.zeros_like(parameters)
    count = len(features)
    for step in range(1, STEPS + 1):
        weights, gaps = parameters[:count], np.exp(parameters[count + 1 :])
        thresholds = parameters[count] + np.concatenate([[0.0], np.cumsum(gaps)])
        signs = np.bincount(document, weights=weights[feature], minlength=len(rows))
        beyond = np.concatenate(
            [np.ones((len(rows), 1)), _sigmoid(signs[:, None] - thresholds[None, :]), np.zeros((len(rows), 1))], axis=1
        )
        own, over = beyond[np.arange(len(rows)), grades], beyond[np.arange(len(rows)), grades + 1]
        chance = np.maximum(own - over, 1e-9)
        low, high = own * (1 - own) / chance, over * (1 - over) / chance  # slopes at the two borders of a grade
        by_sign = -(low - high) / len(rows)
        by_threshold = np.zeros(steps + 2)
        np.add.at(by_threshold, grades, low / len(rows))
        np.add.at(by_threshold, grades + 1, -high / len(rows))
        by_threshold = by_threshold[1:-1]
        later = np.cumsum(by_threshold[::-1])[::-1]  # moving one threshold moves all after it
        gradient = np.concatenate(
            [np.bincount(feature, weights=by_sign[document], minlength=count) + RIDGE * weights, later[:1], later[1:] * gaps]
        )
        first = 0.9 * first + 0.1 * gradient
        second = 0.999 * second + 0.001 * gradient**2
        parameters = parameters - 0.1 * (first / (1 - 0.9**step)) / (np.sqrt(second / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(parameters[count + 1 :])
    return Model(features, parameters[:count], parameters[count] + np.concatenate([[0.0], np.cumsum(gaps)]), lowest)


def learn(docs: DataFrame, grades: DataFrame, max_labelled: int = MAX_LABELLED) -> Model:
    """Fit on ``grades`` (``doc_id``, ``grade``) and the texts of their documents."""
    labelled = grades.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("grade").cast("int").alias("grade"))
    sample = (
        labelled.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id").agg(F.max("grade").alias("grade"))
        .orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_labelled)
    )
    # At most max_labelled ids and grades: small enough to be sent to every task.
    rows = texts(docs).join(F.broadcast(sample), "doc_id").select("doc_id", "grade", "text")
    counts = (
        in_arrow(rows, _count, "feature bigint, n bigint, total bigint").groupBy("feature")
        .agg(F.sum("n").alias("n"), F.sum("total").alias("total"))
    )
    overall = sample.agg(F.avg("grade").alias("mean"), F.var_pop("grade").alias("variance"), F.min("grade").alias("low")).first()
    if not overall["variance"]:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), int(overall["low"] or 0))
    clear = F.pow(F.col("total") - F.col("n") * overall["mean"], F.lit(2)) / (F.col("n") * overall["variance"])
    chosen = counts.where((F.col("n") >= LEAST_DOCS) & (clear >= LEAST_CLEAR)).orderBy(F.desc(clear), "feature").limit(MAX_FEATURES).collect()
    features = np.sort(np.array([r["feature"] for r in chosen], dtype=np.int64).view(np.uint64))
    # Rows of at most MAX_FEATURES numbers each.
    found = in_arrow(rows, _presence(features), "doc_id bigint, grade int, features array<int>").collect()
    found.sort(key=lambda r: (r["doc_id"], r["features"]))
    if len({r["grade"] for r in found}) < 2:
        return Model(np.zeros(0, np.uint64), np.zeros(0), np.zeros(0), found[0]["grade"] if found else 0)
    return fit([np.array(r["features"], dtype=np.int64) for r in found], np.array([r["grade"] for r in found]), features)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = pa.schema([("feature", pa.int64()), ("n", pa.int64()), ("total", pa.int64())])
    for whole in batches:
        for batch in chunks(whole, 8 * PIECE_BYTES):
            found, starts = features_of(batch.column("text"))
            if not len(batch):
                continue
            distinct = []
            for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
                own = np.unique(np.concatenate([hashes[low:high] for hashes in found]))
                distinct.append(own[own != 0])
            grades = np.repeat(batch.column("grade").to_numpy(zero_copy_only=False), [len(d) for d in distinct])
            features, where = np.unique(np.concatenate(distinct), return_inverse=True)
            yield table(arrow, features.view(np.int64), np.bincount(where, minlength=len(features)),
                        np.bincount(where, weights=grades, minlength=len(features)).astype(np.int64))


def _presence(features: np.ndarray):
    arrow = pa.schema([("doc_id", pa.int64()), ("grade", pa.int32()), ("features", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, 8 * PIECE_BYTES):
                documents, numbers = present(batch.column("text"), features)
                cuts = np.searchsorted(documents, np.arange(1, len(batch)))
                yield table(arrow, batch.column("doc_id"), batch.column("grade"), np.split(numbers, cuts))

    return run


def scored(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """Expected severity of every document, the nearest grade, and whether it is at ``least`` (toxic)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, PIECE_BYTES):
                severity = model.severity(batch.column("text"))
                yield table(_ARROW, batch.column("doc_id"), severity, np.floor(severity + 0.5).astype(np.int32), severity >= least)

    return in_arrow(texts(docs), run, SCHEMA)


def without_toxic(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """The documents whose expected severity is below ``least``, with all their columns; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, PIECE_BYTES):
                yield batch.filter(pa.array(model.severity(batch.column("text")) < least))

    return in_arrow(docs, run, docs.schema)
