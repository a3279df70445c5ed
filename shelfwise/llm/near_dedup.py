"""MinHash near-dedup: improved consistent weighted sampling over TF-IDF shingles.

The shingles of a text are its runs of five words (letters and digits, ASCII letters folded; a shorter text with words is
one shingle).  A shingle weighs its count in the text times ``1 + IDF_SHARE ln(N / df) / ln(N)``: what stands in many of the
N documents says less about being a copy.  The share is small because in a group of thousands of copies the shared text is
frequent and the edits are rare; with it, a text that differs from another by the same edits is like it in a group of any
size.  Document frequencies come from a sketch of fixed
size, two rows of hashed counters over all shingles of all documents; an entry's expected load from other shingles is taken
off, and the lesser of the two rows counts.

Improved consistent weighted sampling draws ``SAMPLES`` samples of each text, such that two texts draw the same sample with
the probability of their weighted Jaccard similarity.  ``ROWS`` samples make a band; texts with an equal band are
candidates (see ``linking``), and candidates are verified by their weighted Jaccard similarity, ``LEAST`` at least.  The classes are the
connected components of the verified links and of equal texts.

Equal texts are copies of each other, empty ones too.  A null text is like nothing.  A text without a word is like its
exact copies only.  A document of null id cannot be named, so it is in no class but its own; rows of equal id share a class.
Texts are read whole; further columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import linking
from shelfwise.llm.frames import chunks, in_arrow, table, texts
from shelfwise.llm.words import bytes_buffers, scan_words, shingles, text_buffers

SHINGLE = 5
LEAST = 0.8
IDF_SHARE = 0.25
SAMPLES = 64
ROWS = 4
#: The document-frequency sketch: rows by counters, 8 bytes each on the driver (8 MB in all).
SKETCH = (2, 1 << 19)
#: It is gathered in pieces of this many counters.
SKETCH_PIECE = 1 << 14
PIECE_BYTES = 1 << 18

# Random variates of the sampling, as quantiles that 16 bits of a hash choose from: ln c and r of Gamma(2, 1) and beta.
_LEVELS = 1 << 16


def _gamma_quantiles() -> np.ndarray:
    """Gamma(2, 1) at the midpoints of equal shares: P(x) = 1 - (1 + x) exp(-x), solved by bisection."""
    goal = (np.arange(_LEVELS) + 0.5) / _LEVELS
    low, high = np.zeros(_LEVELS), np.full(_LEVELS, 40.0)
    for _ in range(60):
        middle = (low + high) / 2
        less = 1 - (1 + middle) * np.exp(-middle) < goal
        low, high = np.where(less, middle, low), np.where(less, high, middle)
    return (low + high) / 2


_R = _gamma_quantiles().astype(np.float32)
_LN_C = np.log(_gamma_quantiles()).astype(np.float32)
_rng = np.random.default_rng(4)
_FACTORS = _rng.integers(1, 2**64, SAMPLES, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _rng.integers(0, 2**64, SAMPLES, dtype=np.uint64)
_BAND = _rng.integers(1, 2**64, ROWS + 1, dtype=np.uint64) | np.uint64(1)


def _rows_of(hashes: np.ndarray) -> list[np.ndarray]:
    """Counter of each shingle in each row of the sketch."""
    size = np.uint64(SKETCH[1] - 1)
    return [((hashes >> np.uint64(8 + 24 * row)) & size).astype(np.int64) for row in range(SKETCH[0])]


def _distinct(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Distinct shingles of each text and their counts."""
    hashes, _, _, starts = scan_words(*text_buffers(column), folded=True)
    return [np.unique(s, return_counts=True) for s in shingles(hashes, starts, SHINGLE)]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A task's sketch in pieces, and its number of documents as piece -1."""
    arrow = pa.schema([("piece", pa.int32()), ("counts", pa.binary())])
    counts, documents = np.zeros(SKETCH, dtype=np.int64), 0
    for whole in batches:
        documents += len(whole)
        for batch in chunks(whole, 4 * PIECE_BYTES):
            found = _distinct(batch.column("text"))
            if found:
                for row, at in zip(counts, _rows_of(np.concatenate([s for s, _ in found]))):
                    row += np.bincount(at, minlength=SKETCH[1])
    pieces = counts.astype(np.uint32).reshape(-1, SKETCH_PIECE)
    yield table(arrow, [-1, *range(len(pieces))], [np.array([documents], dtype=np.uint32).tobytes(), *(p.tobytes() for p in pieces)])


def _add(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    total = sum(np.frombuffer(c.as_py(), dtype=np.uint32).astype(np.int64) for c in rows.column("counts"))
    return pa.table({"piece": pa.array([key[0].as_py()], pa.int32()), "counts": pa.array([total.tobytes()], pa.binary())})


class Weights:
    """Inverse document frequencies of shingles."""

    def __init__(self, counts: np.ndarray, documents: int):
        self.documents = max(documents, 2)
        load = counts.sum(axis=1, keepdims=True) / counts.shape[1]
        self.frequency = np.maximum(counts - load, 1.0).astype(np.float32)

    def idf(self, hashes: np.ndarray) -> np.ndarray:
        frequency = np.minimum.reduce([row[at] for row, at in zip(self.frequency, _rows_of(hashes))])
        rarity = np.log(self.documents / np.minimum(frequency, self.documents)) / math.log(self.documents)
        return 1.0 + IDF_SHARE * rarity


def weights(docs: DataFrame) -> Weights:
    """Document frequencies of all shingles of all documents."""
    parts = in_arrow(texts(docs).select("text"), _count, "piece int, counts binary")
    rows = parts.groupBy("piece").applyInArrow(_add, "piece int, counts binary").collect()
    counts = {r["piece"]: np.frombuffer(r["counts"], dtype=np.int64) for r in rows}
    pieces = SKETCH[0] * SKETCH[1] // SKETCH_PIECE
    empty = np.zeros(SKETCH_PIECE, dtype=np.int64)
    return Weights(np.concatenate([counts.get(p, empty) for p in range(pieces)]).reshape(SKETCH), int(counts.get(-1, [0])[0]))


def samples(hashes: np.ndarray, weight: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Consistent weighted samples, texts by SAMPLES, as hashes of the drawn (shingle, level).

    ``hashes`` and ``weight`` are the texts' distinct shingles one text after another, from ``starts``.  With r and c from
    Gamma(2, 1) and beta uniform, all fixed by the shingle's hash, the level is ``t = floor(ln w / r + beta)`` and the shingle
    with the least ``ln c - r (t - beta + 1)`` is drawn.
    """
    found = np.empty((len(starts), SAMPLES), dtype=np.uint64)
    ln_weight = np.log(weight).astype(np.float32)
    lengths = np.diff(np.append(starts, len(hashes)))
    for k in range(SAMPLES):
        bits = (hashes * _FACTORS[k] + _OFFSETS[k]).view(np.uint16).reshape(-1, 4)
        r = _R[bits[:, 2]]
        beta = bits[:, 1].astype(np.float32) * np.float32(1 / _LEVELS)
        level = np.floor(ln_weight / r + beta)
        arrival = _LN_C[bits[:, 3]] - r * (level - beta + np.float32(1))
        least = np.minimum.reduceat(arrival, starts)
        drawn = np.flatnonzero(arrival == np.repeat(least, lengths))
        owner = np.searchsorted(starts, drawn, side="right") - 1
        first = np.ones(len(drawn), dtype=bool)
        first[1:] = owner[1:] != owner[:-1]  # of equal arrivals the least hash
        drawn = drawn[first]
        found[:, k] = hashes[drawn] + level[drawn].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    return found


def bands(drawn: np.ndarray) -> np.ndarray:
    """Keys of the bands, texts by SAMPLES / ROWS."""
    count = SAMPLES // ROWS
    total = np.broadcast_to(np.arange(1, count + 1, dtype=np.uint64) * _BAND[ROWS], (len(drawn), count)).copy()
    for j in range(ROWS):
        total += drawn[:, j::ROWS] * _BAND[j]
    total ^= total >> np.uint64(29)
    total *= np.uint64(0xBF58476D1CE4E5B9)
    return (total ^ (total >> np.uint64(32))).view(np.int64)


def _signatures(weigh: Weights):
    arrow = pa.schema([("id", pa.int64()), ("digest", pa.string()), ("bands", pa.list_(pa.int64())), ("samples", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in chunks(whole, PIECE_BYTES):
                found = _distinct(batch.column("text"))
                rows = np.flatnonzero([len(s) for s, _ in found])
                keys, bytes_of = [np.zeros(0, np.int64)] * len(found), [b""] * len(found)
                if len(rows):
                    hashes = np.concatenate([found[i][0] for i in rows])
                    weight = np.concatenate([found[i][1] for i in rows]) * weigh.idf(hashes)
                    starts = np.concatenate([[0], np.cumsum([len(found[i][0]) for i in rows])[:-1]])
                    drawn = samples(hashes, weight, starts)
                    for i, key, byte in zip(rows.tolist(), bands(drawn), (drawn >> np.uint64(23)).astype(np.uint8)):
                        keys[i], bytes_of[i] = key, byte.tobytes()
                yield table(arrow, batch.column("id"), batch.column("digest"), keys, bytes_of)

    return run


def similarity(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], weigh: Weights) -> float:
    """Weighted Jaccard similarity of two texts' distinct shingles and counts."""
    both = np.union1d(a[0], b[0])
    if not len(both):
        return 0.0
    idf = weigh.idf(both)
    left, right = np.zeros(len(both)), np.zeros(len(both))
    left[np.searchsorted(both, a[0])] = a[1]
    right[np.searchsorted(both, b[0])] = b[1]
    return float((np.minimum(left, right) * idf).sum() / (np.maximum(left, right) * idf).sum())


def _verify(weigh: Weights, least: float):
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 64):
                batch = whole.slice(low, 64)
                left, right = _distinct(batch.column("text_a")), _distinct(batch.column("text_b"))
                near = [similarity(a, b, weigh) >= least for a, b in zip(left, right)]
                kept = batch.select(["a", "b"]).filter(pa.array(near, type=pa.bool_()))
                yield table(arrow, kept.column("a"), kept.column("b"))

    return lambda sides: in_arrow(sides, run, "a bigint, b bigint")


def _features(weigh: Weights) -> linking.Features:
    """Shingles with their weights; one that a text has several times comes as often, told apart by its number."""

    def run(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
        found = []
        for hashes, counts in _distinct(column):
            number = np.arange(counts.sum()) - np.repeat(np.cumsum(counts) - counts, counts)
            elements = np.repeat(hashes, counts) + number.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
            order = np.argsort(elements)
            found.append((elements[order], np.repeat(weigh.idf(hashes).astype(np.float64), counts)[order]))
        return found

    return run


def near_classes(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """Of every known id that shares a class with another id: the least id of the class, as (``id``, ``class_id``)."""
    weigh = weights(docs)
    known = linking.known_texts(docs)
    signed = in_arrow(known, _signatures(weigh), "id bigint, digest string, bands array<bigint>, samples binary")
    return linking.classes_with_copies(known, signed, _verify(weigh, least), _features(weigh), least)


def classified(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """One row per document: ``doc_id``, the least id of its class (its own when it is like no other), and whether it is
    the one that stands for its class."""
    ids = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"))
    found = near_classes(docs, least).groupBy("id").agg(F.min("class_id").alias("class_id"))
    own = ids.join(found, ids["doc_id"] == found["id"], "left")
    return own.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id")).withColumn(
        "kept", F.coalesce(F.col("class_id") == F.col("doc_id"), F.lit(True))
    )


def one_of_each(docs: DataFrame, least: float = LEAST) -> DataFrame:
    """The documents that stand for their class, with all columns."""
    others = near_classes(docs, least).where("id <> class_id").select(F.col("id").alias("doc_id")).distinct()
    return docs.join(others.hint("merge"), "doc_id", "left_anti").select(docs.columns)
