"""Benchmark decontamination by pigeonhole edit matching.

Texts and test items are compared in a normal form: ASCII letters in lower case, every run of other ASCII characters than
letters and digits as one space.  An item of n characters may be found with up to ``floor(n * error_rate)`` edits.  It is
cut into one piece more than that, so that at least one piece must occur unchanged in any match.  One Aho-Corasick
automaton finds all pieces of all items in one pass over a text; around each hit Myers' bit-parallel algorithm computes the
least edit distance between the item and any part of the text there.

The items are the query set.  They are held in blocks of at most ``BLOCK_CHARS`` characters, each of which goes over all
documents, so nothing of unbounded size is ever sent to the executors.

A null text holds no item; null items, and items without a letter or digit, are never found.  Equal items are found alike,
each under its own id.  Items of a null id take part too.  Repeated documents give repeated rows.  Texts are read whole.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import in_arrow, table, texts

ERROR_RATE = 0.07
BLOCK_CHARS = 4_000_000

SCHEMA = "doc_id bigint, item_id bigint, distance int, budget int, start bigint, end bigint"
_ARROW = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("distance", pa.int32()), ("budget", pa.int32()),
                    ("start", pa.int64()), ("end", pa.int64())])

_FOLD = np.full(256, 32, dtype=np.uint8)
_FOLD[128:] = np.arange(128, 256)
for _first, _last in ("09", "az"):
    _FOLD[ord(_first) : ord(_last) + 1] = np.arange(ord(_first), ord(_last) + 1)
_FOLD[ord("A") : ord("Z") + 1] = np.arange(ord("a"), ord("z") + 1)


def normal(text: str | None) -> str:
    if not text:
        return ""
    folded = _FOLD[np.frombuffer(text.encode("utf-8", "replace"), dtype=np.uint8)]
    space = folded == 32
    space[1:] &= space[:-1]
    space[0] = False
    return folded[~space].tobytes().decode().strip(" ")


def least_distance(pattern: str, masks: dict[str, int], text: str, most: int) -> tuple[int, int]:
    """Myers: the least edit distance of the pattern to any substring of the text, and where the first such one ends.

    The distance is ``most + 1`` when no substring is within ``most``.
    """
    size = len(pattern)
    last, full = 1 << (size - 1), (1 << size) - 1
    up, down, score = full, 0, size
    best, end = most + 1, -1
    for j, character in enumerate(text):
        equal = masks.get(character, 0)
        across = (((equal & up) + up) ^ up) | equal | down
        equal |= down
        rise = down | (~(across | up) & full)
        fall = up & across
        if rise & last:
            score += 1
        elif fall & last:
            score -= 1
        rise = (rise << 1) & full  # a match may start anywhere, so the first row stays 0
        fall = (fall << 1) & full
        up = fall | (~(equal | rise) & full)
        down = rise & equal
        if score < best:
            best, end = score, j + 1
    return best, end


def masks_of(pattern: str) -> dict[str, int]:
    masks: dict[str, int] = {}
    for i, character in enumerate(pattern):
        masks[character] = masks.get(character, 0) | 1 << i
    return masks


class Items:
    """A block of normal test items with their pieces in one automaton."""

    def __init__(self, items: list[tuple[int | None, str]], error_rate: float):
        self.items = []
        self.automaton = ahocorasick.Automaton()
        pieces: dict[str, list[tuple[int, int]]] = {}
        for item_id, text in items:
            budget = math.floor(len(text) * error_rate)
            number = len(self.items)
            self.items.append((item_id, text, budget, masks_of(text)))
            cuts = [len(text) * k // (budget + 1) for k in range(budget + 2)]
            for low, high in zip(cuts[:-1], cuts[1:]):
                pieces.setdefault(text[low:high], []).append((number, low))
        for piece, uses in pieces.items():
            self.automaton.add_word(piece, (len(piece), tuple(uses)))
        self.automaton.make_automaton()

    def found(self, text: str) -> Iterator[tuple[int, int, int, int]]:
        """Number of each item found in a normal text, its distance, and where the nearest match begins and ends."""
        if not self.items:
            return
        regions: dict[int, list[list[int]]] = {}
        for last, (length, uses) in self.automaton.iter(text):
            for number, offset in uses:
                _, item, budget, _ = self.items[number]
                start = last + 1 - length - offset
                low, high = max(0, start - budget), min(len(text), start + len(item) + budget)
                known = regions.setdefault(number, [])
                if known and low <= known[-1][1] and low >= known[-1][0]:
                    known[-1][1] = max(high, known[-1][1])
                else:
                    known.append([low, high])
        for number, places in regions.items():
            _, item, budget, masks = self.items[number]
            best = (budget + 1, 0, 0)
            for low, high in places:
                distance, end = least_distance(item, masks, text[low:high], budget)
                if distance < best[0]:
                    best = (distance, low, low + end)
            if best[0] <= budget:
                distance, low, end = best
                back = text[max(low, end - len(item) - budget) : end][::-1]
                reverse = item[::-1]
                _, length = least_distance(reverse, masks_of(reverse), back, budget)
                yield number, distance, end - length, end


def _blocks(benchmark: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """All items in normal form, in blocks of bounded size."""
    rows = benchmark.select(F.col("item_id").cast("bigint").alias("item_id"), F.col("text").cast("string").alias("text")).where(
        "text IS NOT NULL"
    )
    block, size = [], 0
    for row in rows.toLocalIterator():
        item = normal(row["text"])
        if not item:
            continue
        if block and size + len(item) > BLOCK_CHARS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], item))
        size += len(item)
    if block:
        yield block


def matches(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """Every document and test item it holds: least distance, the budget, and the place in the document's normal form."""
    rows, found = texts(docs), None
    for block in _blocks(benchmark):
        part = in_arrow(rows, _matcher(block, error_rate), SCHEMA)
        found = part if found is None else found.unionAll(part)
    return docs.sparkSession.createDataFrame([], SCHEMA) if found is None else found


def _matcher(block: list[tuple[int | None, str]], error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block, error_rate)
        for batch in batches:
            rows = [
                (doc_id, items.items[number][0], distance, items.items[number][2], start, end)
                for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text"))
                for number, distance, start, end in items.found(normal(text.as_py()))
            ]
            if rows:
                yield table(_ARROW, *zip(*rows))

    return run


def without_items(docs: DataFrame, benchmark: DataFrame, error_rate: float = ERROR_RATE) -> DataFrame:
    """The documents that hold no test item, with all their columns; no shuffle."""
    kept = docs
    for block in _blocks(benchmark):
        kept = in_arrow(kept, _cleaner(block, error_rate), docs.schema)
    return kept


def _cleaner(block: list[tuple[int | None, str]], error_rate: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items = Items(block, error_rate)
        for batch in batches:
            clean = [next(items.found(normal(text.as_py())), None) is None for text in batch.column("text")]
            yield batch.filter(pa.array(clean, type=pa.bool_()))

    return run
