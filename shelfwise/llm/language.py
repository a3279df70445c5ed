"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, a word's edge counting as a letter), most
frequent first.  A document goes to the language whose profile is nearest by out-of-place distance: for each n-gram of the
document's own profile, how far its rank is from its rank in the language's profile, ``PROFILE`` where it is not there.

Learning counts the n-grams of all labelled texts, per task and then per n-gram; only the ``PROFILE`` most frequent of each
label reach the driver.  Labels are language names, so there are at most some thousands of them.

Ties: equally frequent n-grams go by code point, equally near languages by name.  A null text or one without a letter is
``und`` with score 0, and so is every text when nothing was learned.  Rows with a null label or a null or empty text teach
nothing.  Texts are read whole, in pieces, whatever their length.  Every input row gives one row, repeated rows and null
ids too; further columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.frames import in_arrow, table

PROFILE = 300
EDGE = 1  # stands for a word's edge
SHIFT = 21  # bits of a code point
PIECE = 1 << 20
#: A task sends out its counts when it holds this many n-grams.
HELD_GRAMS = 2_000_000

SCHEMA = "doc_id bigint, held_out boolean, lang_pred string, score double"
_ARROW = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("lang_pred", pa.string()), ("score", pa.float64())])
_COUNTS = pa.schema([("lang", pa.string()), ("gram", pa.int64()), ("n", pa.int64())])


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    return np.array([chr(c).isalpha() for c in range(0x110000)])


def letters(text: str | None) -> np.ndarray:
    """Lower-case code points of the letters, with one EDGE for everything between, before and after words."""
    if not text:
        return np.zeros(0, np.int64)
    points = np.frombuffer(text.lower().encode("utf-32-le", "replace"), dtype=np.uint32)
    kept = _letters()[points]
    points = np.where(kept, points, EDGE).astype(np.int64)
    follows = np.ones(len(points), dtype=bool)
    follows[1:] = kept[:-1]
    points = points[kept | follows]
    if not kept.any():
        return np.zeros(0, np.int64)
    head = [] if points[0] == EDGE else [EDGE]
    tail = [] if points[-1] == EDGE else [EDGE]
    return np.concatenate([np.array(head, np.int64), points, np.array(tail, np.int64)])


def counted(points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams, ascending, and how often each occurs."""
    found = []
    for low in range(0, max(len(points), 1), PIECE):
        part = points[low : low + PIECE + 2]  # two more, for n-grams that begin in this piece
        own = min(PIECE, len(part))
        one = part[:own]
        two = (part[: len(part) - 1] << SHIFT | part[1:])[:own]
        three = (part[: len(part) - 2] << (2 * SHIFT) | part[1:-1] << SHIFT | part[2:])[:own]
        two = two[(part[: len(two)] != EDGE) | (part[1 : len(two) + 1] != EDGE)]
        three = three[part[1 : len(three) + 1] != EDGE]
        found.append(np.unique(np.concatenate([one[one != EDGE], two, three]), return_counts=True))
    return found[0] if len(found) == 1 else _added(found)


def _added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    grams, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
    total = np.bincount(where, weights=np.concatenate([n for _, n in parts]), minlength=len(grams))
    return grams, total.astype(np.int64)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}

    def sent() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            grams, counts = _added(parts)
            yield table(_COUNTS, [lang] * len(grams), grams, counts)
        held.clear()

    def add(lang: str, waiting: list[np.ndarray]) -> None:
        held.setdefault(lang, []).append(counted(np.concatenate(waiting)))
        if len(held[lang]) >= 16:
            held[lang] = [_added(held[lang])]

    for batch in batches:
        waiting: dict[str, list[np.ndarray]] = {}
        sizes: dict[str, int] = {}
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
            points = letters(text.as_py())
            waiting.setdefault(lang, []).append(points)
            sizes[lang] = sizes.get(lang, 0) + len(points)
            if sizes[lang] >= PIECE:
                add(lang, waiting.pop(lang))
                sizes[lang] = 0
        for lang, parts in waiting.items():
            add(lang, parts)
        if sum(len(g) for parts in held.values() for g, _ in parts) > HELD_GRAMS:
            yield from sent()
    yield from sent()


class Profiles:
    """All languages' profiles as one table: sorted n-grams by languages, with the rank in each."""

    def __init__(self, ranked: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in ranked})
        self.grams = np.unique(np.array([g for _, g, _ in ranked], dtype=np.int64))
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, dtype=np.int32)
        for lang, gram, rank in ranked:
            self.ranks[np.searchsorted(self.grams, gram), self.langs.index(lang)] = rank

    def nearest(self, text: str | None) -> tuple[str, float]:
        points = letters(text)
        if not len(points) or not self.langs:
            return "und", 0.0
        grams, counts = counted(points)
        top = grams[np.argsort(-counts, kind="stable")[:PROFILE]]
        at = np.searchsorted(self.grams, top)
        at[(at == len(self.grams)) | (self.grams[np.minimum(at, len(self.grams) - 1)] != top)] = len(self.grams)
        theirs = self.ranks[at]
        out_of_place = np.where(theirs < 0, PROFILE, np.abs(theirs - np.arange(len(top), dtype=np.int32)[:, None]))
        distances = out_of_place.sum(axis=0)
        best = int(np.argmin(distances))
        return self.langs[best], 1.0 - float(distances[best]) / (PROFILE * len(top))


def learn(labelled: DataFrame) -> Profiles:
    """Profiles of every value of ``lang``, from all rows of (``lang``, ``text``)."""
    rows = labelled.select(F.col("lang").cast("string").alias("lang"), F.col("text").cast("string").alias("text")).where(
        "lang IS NOT NULL AND text IS NOT NULL"
    )
    counts = in_arrow(rows, _count, "lang string, gram bigint, n bigint").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    order = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    ranked = counts.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= PROFILE)
    return Profiles([(r["lang"], r["gram"], r["rank"] - 1) for r in ranked.collect()])


def fold(doc_id: Column) -> Column:
    return F.crc32(doc_id.cast("string").cast("binary")) % 4


def identify(docs: DataFrame, profiles: Profiles, held_out: Column) -> DataFrame:
    """The nearest language of every text and how near it is, 0 to 1; no shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [profiles.nearest(text.as_py()) for text in batch.column("text")]
            yield table(_ARROW, batch.column("doc_id"), batch.column("held_out"), *(zip(*found) if found else ([], [])))

    rows = docs.select(
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.coalesce(held_out, F.lit(False)).alias("held_out"),
        F.col("text").cast("string").alias("text"),
    )
    return in_arrow(rows, run, SCHEMA)


def predicted(docs: DataFrame) -> DataFrame:
    """Learn from the documents whose fold is not 2 and predict all of them.  A null id is in no fold."""
    folds = fold(F.col("doc_id"))
    return identify(docs, learn(docs.where(folds != 2)), folds == 2)
