"""Document fingerprints: MinHash over five-word shingles, with universal hash functions in vectorised numpy.

A fingerprint is the least value of each of ``FUNCTIONS`` multiply-shift hash functions over the hashes of the text's
shingles, kept to 16 bits each and written as hexadecimal text.  The share of equal parts of two fingerprints estimates
the Jaccard similarity of their shingle sets.  Words are runs of letters and digits, ASCII letters folded to lower case; a
text of one to four words is a single shingle; texts without a word have the fingerprint of the empty set.  Equal texts
have equal fingerprints.

A null text is an empty one; texts are read whole.  ``with_edits`` compares each document with an edited text made from the
next document in descending order of id (a null id comes after all others, rows of equal id go by text).  Every input row
gives one row; further columns are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm import linking
from shelfwise.llm.frames import chunks, in_arrow, partitions, ship, table, texts
from shelfwise.llm.words import bytes_buffers, scan_words, shingles, text_buffers

SHINGLE = 5
FUNCTIONS = 128
PIECE_BYTES = 1 << 19

_rng = np.random.default_rng(61)
_FACTORS = _rng.integers(1, 2**64, FUNCTIONS, dtype=np.uint64) | np.uint64(1)
_OFFSETS = _rng.integers(0, 2**64, FUNCTIONS, dtype=np.uint64)

SCHEMA = ("doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, "
          "near_edited double, near_next double")
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()),
                    ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()),
                    ("near_next", pa.float64())])


def signatures(texts: list[bytes]) -> np.ndarray:
    """One row of FUNCTIONS 16-bit values per text."""
    found = np.full((len(texts), FUNCTIONS), 0xFFFF, dtype=np.uint16)
    hashes, _, _, starts = scan_words(*bytes_buffers(texts), folded=True)
    parts = list(shingles(hashes, starts, SHINGLE))
    rows = np.flatnonzero([len(p) for p in parts])
    if not len(rows):
        return found
    values = np.concatenate([parts[r] for r in rows])
    begins = np.concatenate([[0], np.cumsum([len(parts[r]) for r in rows])[:-1]])
    for k in range(FUNCTIONS):
        least = np.minimum.reduceat((values * _FACTORS[k] + _OFFSETS[k]) >> np.uint64(32), begins)
        found[rows, k] = least.astype(np.uint16)
    return found


def edited(text: str, following: str) -> str:
    """The last third of the code points replaced by as many from the start of the following text, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def _hex(row: np.ndarray) -> str:
    return row.astype(">u2").tobytes().hex()


def _compared(rows: list[tuple[int | None, str]]) -> pa.RecordBatch:
    """One row for each document but the last, which is only the next of the one before it."""
    changed = [edited(text, following).encode("utf-8", "surrogatepass") for (_, text), (_, following) in zip(rows, rows[1:])]
    plain = signatures([text.encode("utf-8", "surrogatepass") for _, text in rows])
    altered = signatures(changed)
    return table(
        _ARROW,
        [doc_id for doc_id, _ in rows[:-1]],
        [len(text) for _, text in rows[:-1]],
        [hashlib.sha256(c).hexdigest() for c in changed],
        [_hex(s) for s in plain[:-1]],
        [_hex(s) for s in altered],
        (plain[:-1] == altered).mean(axis=1),
        (plain[:-1] == plain[1:]).mean(axis=1),
    )


def _in_order(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order; the last ones, marked as copies, only follow the block's last document."""
    rows: list[tuple[int | None, str]] = []
    ended = False
    for whole in batches:
        for batch in chunks(whole, PIECE_BYTES):
            for place, doc_id, text in zip(*(batch.column(c).to_pylist() for c in ("place", "doc_id", "text"))):
                if not ended:
                    rows.append((doc_id, text or ""))
                    ended = place % 2 == 1
            if len(rows) > 1:
                yield _compared(rows)
                rows = rows[-1:]


def with_edits(docs: DataFrame) -> DataFrame:
    """Fingerprints of every document and of its edited text, and how like they and the next document's are.

    Documents go to blocks of neighbouring ids, one block per shuffle partition, with a copy of the document that follows
    the block's last one.  So the texts are shuffled once, and only one id per block reaches the driver.
    """
    spark = docs.sparkSession
    ship(spark)
    lowest = F.lit(-(2**63)).cast("bigint")
    rows = texts(docs).withColumn("key", F.coalesce("doc_id", lowest))
    ids = rows.select("key")
    blocks = max(1, partitions(spark))
    splits = ids.stat.approxQuantile("key", [i / blocks for i in range(1, blocks)], 0.1 / blocks) if blocks > 1 else []
    bounds = np.unique(np.array(splits, dtype=np.float64))

    def block_of(keys: pd.Series) -> np.ndarray:
        return np.searchsorted(bounds, keys.to_numpy().astype(np.float64), side="right")

    @F.pandas_udf("int")
    def own_block(keys: pd.Series) -> pd.Series:
        return pd.Series(block_of(keys), dtype="int32")

    heads = sorted(ids.select("key", own_block("key").alias("block")).groupBy("block").agg(F.max("key").alias("key")).collect())
    # The first document of a block also follows the last one of the block above; the very first follows the very last.
    above = {head["key"]: heads[(i + 1) % len(heads)]["block"] for i, head in enumerate(heads)}

    @F.pandas_udf("array<int>")
    def places(keys: pd.Series) -> pd.Series:
        own = block_of(keys).tolist()
        return pd.Series([[2 * b, 2 * above[k] + 1] if k in above else [2 * b] for k, b in zip(keys.tolist(), own)])

    placed = rows.withColumn("place", F.explode(places("key")))
    ordered = placed.repartitionById(blocks, F.expr("place div 2").cast("int")).sortWithinPartitions(
        F.col("place") % 2, F.desc("key"), F.asc_nulls_first("text")
    )
    return in_arrow(ordered.select("place", "doc_id", "text"), _in_order, SCHEMA)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    arrow = pa.schema([("id", pa.int64()), ("digest", pa.string()), ("bands", pa.list_(pa.int64())), ("samples", pa.binary())])
    for whole in batches:
        for batch in chunks(whole, PIECE_BYTES):
            found = signatures([text.encode("utf-8", "surrogatepass") for text in batch.column("text").to_pylist()])
            # Four values make the 64 bits of a band; the band's place goes into its key.
            keys = found[:, :64].copy().view(np.uint64) * _FACTORS[:16] + _OFFSETS[:16]
            empty = (found == 0xFFFF).all(axis=1)
            rows = [np.zeros(0, np.int64) if none else key for key, none in zip(keys.view(np.int64), empty)]
            yield table(arrow, batch.column("id"), batch.column("digest"), rows,
                        [row.astype(np.uint8).tobytes() for row in found[:, :64]])


def _jaccard(least: float):
    arrow = pa.schema([("a", pa.int64()), ("b", pa.int64())])

    def sets(column: pa.Array) -> list[set[int]]:
        hashes, _, _, starts = scan_words(*text_buffers(column), folded=True)
        return [set(own.tolist()) for own in shingles(hashes, starts, SHINGLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for low in range(0, len(whole), 64):
                batch = whole.slice(low, 64)
                pairs = zip(sets(batch.column("text_a")), sets(batch.column("text_b")))
                near = pa.array([len(a & b) >= least * len(a | b) > 0 for a, b in pairs], type=pa.bool_())
                yield table(arrow, batch.column("a").filter(near), batch.column("b").filter(near))

    return lambda sides: in_arrow(sides, run, "a bigint, b bigint")


def _features(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    hashes, _, _, starts = scan_words(*text_buffers(column), folded=True)
    sets = [np.unique(own) for own in shingles(hashes, starts, SHINGLE)]
    return [(own, np.ones(len(own))) for own in sets]


def near_classes(docs: DataFrame, least: float = 0.8) -> DataFrame:
    """Of every known id that shares a class with another id: the least id of the class, as (``id``, ``class_id``).

    Fingerprints are cut into 16 bands of four values, equal bands are joined, and candidates are verified by the Jaccard
    similarity of their shingle sets (see ``linking``).
    """
    known = linking.known_texts(docs)
    signed = in_arrow(known, _signed, "id bigint, digest string, bands array<bigint>, samples binary")
    return linking.classes_with_copies(known, signed, _jaccard(least), _features, least)
