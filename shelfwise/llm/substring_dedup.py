"""Substring dedup: every document is factored, relative Lempel-Ziv style, against reference blocks that cover the corpus.

A word is a run of anything but the space and the bytes 9 to 13; a window is ``WINDOW`` consecutive words of a document.
A window is repeated when its word sequence also starts in a document of smaller id.  The longest runs of repeated windows
are the factors, and the words they cover are removed.  Windows are judged on the input, not on what is left.

The reference is an index of windows, cut by hash into blocks that together hold every window which may be repeated:

1. Documents go to text blocks (the only time their texts are shuffled; all later steps reuse that exchange).
2. Each text block lists its anchors, the least hash of the five-word runs in each window.  Equal windows have equal
   anchors, and there are several times fewer anchors than windows.
3. The hash blocks of anchors find those that stand in two documents or more, and tell the text blocks.
4. Each text block sends its windows with such an anchor, once each and with the smallest id, to the hash blocks.
5. The hash blocks look every window up among all others and tell the text blocks which also start in a smaller document
   elsewhere.
6. Each text block marks these windows and those repeated within the block, joins them to factors and cuts these out.

Hashes travel as sorted binary arrays, at most one entry per text block, however many copies there are: a window that
stands in a third of all documents is a few bytes per block.  A window is known by 96 bits of hash.

A null text has no words.  A document of null id is neither a reference nor cut, since nothing is smaller than null.  Rows
of equal id are judged alike and never against each other.  Texts are read whole; every input row gives one row.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import partitions, ship, texts
from shelfwise.llm.words import runs_of, scan_words, text_buffers

WINDOW = 13
ANCHOR = 5
#: Text blocks per shuffle partition, and the least number of hash blocks.
TEXT_BLOCKS = 4
HASH_BLOCKS = 64

SCHEMA = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())])
_ANCHORS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("once", pa.binary()), ("more", pa.binary())])
_SHARED = pa.schema([("block", pa.int32()), ("anchors", pa.binary())])
_WINDOWS = pa.schema([("part", pa.int32()), ("block", pa.int32()), ("low", pa.binary()), ("high", pa.binary()),
                      ("first", pa.binary())])
_REPEATED = pa.schema([("block", pa.int32()), ("low", pa.binary()), ("high", pa.binary())])


class Block:
    """The documents of a text block and their windows, given by the first word of each."""

    def __init__(self, rows: pa.Table):
        column = rows.column("text").combine_chunks()
        self.column = column if isinstance(column, pa.Array) else column.chunk(0)
        self.ids = rows.column("doc_id").to_pylist()
        self.data, self.offsets = text_buffers(self.column)
        self.hashes, self.first, self.end, self.starts = scan_words(self.data, self.offsets, folded=False)
        counts = np.diff(self.starts)
        self.document = np.repeat(np.arange(len(self.ids)), counts)
        number = np.array([0 if i is None else i for i in self.ids], dtype=np.int64)
        self.known = np.array([i is not None for i in self.ids], dtype=bool)
        size = max(len(self.hashes) - WINDOW + 1, 0)
        same = self.document[:size] == self.document[WINDOW - 1 :]
        self.windows = np.flatnonzero(same & self.known[self.document[:size]])
        self.id_of = number[self.document[self.windows]]

    def anchors(self) -> np.ndarray:
        runs = runs_of(self.hashes, ANCHOR)
        least, width, goal = runs, 1, WINDOW - ANCHOR + 1
        while width < goal:  # sliding minimum by doubling
            step = min(width, goal - width)
            least = np.minimum(least[: len(least) - step], least[step:])
            width += step
        return least[self.windows]

    def keys(self) -> tuple[np.ndarray, np.ndarray]:
        low = runs_of(self.hashes, WINDOW, salt=7)[self.windows]
        high = (runs_of(self.hashes, WINDOW, salt=29)[self.windows] >> np.uint64(32)).astype(np.uint32)
        return low, high


def _groups(*keys: np.ndarray) -> np.ndarray:
    """Where a new value begins in sorted keys."""
    if not len(keys[0]):
        return np.zeros(0, np.int64)
    new = np.ones(len(keys[0]), dtype=bool)
    new[1:] = False
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def _cuts(hashes: np.ndarray, parts: int) -> list[int]:
    """Borders of the hash blocks in sorted hashes."""
    borders = [np.uint64((p << 64) // parts) for p in range(1, parts)]
    return [0, *np.searchsorted(hashes, np.array(borders, dtype=np.uint64)).tolist(), len(hashes)]


def _joined(column: pa.ChunkedArray, kind: type) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=kind)


def _list_anchors(parts: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        block = Block(rows)
        anchors, ids = block.anchors(), block.id_of
        changes = _groups(anchors, ids)  # neighbouring windows mostly have the same anchor
        anchors, ids = anchors[changes], ids[changes]
        order = np.argsort(anchors, kind="stable")
        anchors, ids = anchors[order], ids[order]
        starts = _groups(anchors)
        several = np.minimum.reduceat(ids, starts) != np.maximum.reduceat(ids, starts) if len(starts) else np.zeros(0, bool)
        distinct = anchors[starts]
        once, more = distinct[~several], distinct[several]
        out = [
            (p, key[0].as_py(), once[a:b].tobytes(), more[c:d].tobytes())
            for p, (a, b, c, d) in enumerate(zip(*(x for hashes in (once, more) for cuts in [_cuts(hashes, parts)]
                                                   for x in (cuts[:-1], cuts[1:]))))
            if b > a or d > c
        ]
        return pa.Table.from_pylist([dict(zip(_ANCHORS.names, r)) for r in out], schema=_ANCHORS)

    return run


def _share_anchors(rows: pa.Table) -> pa.Table:
    """Per text block, the anchors that stand in another document too, in this block or elsewhere."""
    blocks = rows.column("block").to_pylist()
    once = [np.frombuffer(b, dtype=np.uint64) for b in rows.column("once").to_pylist()]
    more = [np.frombuffer(b, dtype=np.uint64) for b in rows.column("more").to_pylist()]
    every = np.sort(np.concatenate(once + more))
    shared = np.unique(np.concatenate([every[1:][every[1:] == every[:-1]], *more]))
    found = []
    for block, own, certain in zip(blocks, once, more):
        at = np.searchsorted(shared, own)
        at[at == len(shared)] = 0
        own = own[shared[at] == own] if len(shared) else own[:0]
        if len(own) or len(certain):
            found.append({"block": block, "anchors": np.concatenate([own, certain]).tobytes()})
    return pa.Table.from_pylist(found, schema=_SHARED)


def _list_windows(parts: int):
    def run(key: tuple[pa.Scalar, ...], rows: pa.Table, shared: pa.Table) -> pa.Table:
        wanted = np.sort(_joined(shared.column("anchors"), np.uint64)) if len(shared) and len(rows) else None
        if wanted is None or not len(wanted):
            return _WINDOWS.empty_table()
        block = Block(rows)
        anchors = block.anchors()
        at = np.searchsorted(wanted, anchors)
        at[at == len(wanted)] = 0
        candidates = np.flatnonzero(wanted[at] == anchors)
        low, high = (k[candidates] for k in block.keys())
        ids = block.id_of[candidates]
        order = np.argsort(low, kind="stable")
        low, high, ids = low[order], high[order], ids[order]
        starts = _groups(low, high)
        first = np.minimum.reduceat(ids, starts) if len(starts) else ids
        low, high = low[starts], high[starts]
        cuts = _cuts(low, parts)
        out = [
            {"part": p, "block": key[0].as_py(), "low": low[a:b].tobytes(), "high": high[a:b].tobytes(),
             "first": first[a:b].tobytes()}
            for p, (a, b) in enumerate(zip(cuts[:-1], cuts[1:]))
            if b > a
        ]
        return pa.Table.from_pylist(out, schema=_WINDOWS)

    return run


def _look_up(rows: pa.Table) -> pa.Table:
    """Per text block, its windows that also start in a document smaller than all of the block's own."""
    blocks = rows.column("block").to_pylist()
    low, high, first = (_joined(rows.column(c), k) for c, k in (("low", np.uint64), ("high", np.uint32), ("first", np.int64)))
    lengths = [len(b) // 8 for b in rows.column("low").to_pylist()]
    order = np.argsort(low, kind="stable")
    starts = _groups(low[order], high[order])
    least = np.repeat(np.minimum.reduceat(first[order], starts), np.diff(np.append(starts, len(order))))
    repeated = np.zeros(len(order), dtype=bool)
    repeated[order] = least < first[order]
    found, at = [], 0
    for block, length in zip(blocks, lengths):
        own = np.flatnonzero(repeated[at : at + length]) + at
        if len(own):
            found.append({"block": block, "low": low[own].tobytes(), "high": high[own].tobytes()})
        at += length
    return pa.Table.from_pylist(found, schema=_REPEATED)


def _repeated_words(block: Block, repeated: pa.Table) -> np.ndarray:
    """Whether each word of the block lies in a factor."""
    low, high = block.keys()
    order = np.argsort(low, kind="stable")
    starts = _groups(low[order], high[order])
    marked = np.zeros(len(low), dtype=bool)
    if len(starts):
        ids = block.id_of[order]
        marked[order] = np.repeat(np.minimum.reduceat(ids, starts), np.diff(np.append(starts, len(order)))) < ids
    if len(repeated) and len(low):
        theirs, their_high = _joined(repeated.column("low"), np.uint64), _joined(repeated.column("high"), np.uint32)
        by_hash = np.argsort(theirs)
        theirs, their_high = theirs[by_hash], their_high[by_hash]
        at = np.searchsorted(theirs, low)
        at[at == len(theirs)] = 0
        marked |= (theirs[at] == low) & (their_high[at] == high)
    # Factors: words covered by neighbouring marked windows, from the first word of the first to the last of the last.
    depth = np.zeros(len(block.hashes) + 1, dtype=np.int64)
    begins = block.windows[marked]
    depth[begins] += 1
    depth[begins + WINDOW] -= 1
    return np.cumsum(depth)[:-1] > 0


def _cut(key: tuple[pa.Scalar, ...], rows: pa.Table, repeated: pa.Table) -> pa.Table:
    block = Block(rows)
    removed = _repeated_words(block, repeated)
    kept = np.flatnonzero(~removed)
    documents = block.document[kept]
    counts = np.bincount(documents, minlength=len(block.ids))
    # Kept words with one space behind each but a document's last: copied out by one mask over the bytes.
    follows = np.ones(len(kept), dtype=np.int64)
    follows[np.cumsum(counts)[counts > 0] - 1] = 0
    data = np.append(block.data, np.uint8(32))
    ends = block.end[kept]
    data[ends[follows == 1]] = 32
    change = np.zeros(len(data) + 2, dtype=np.int8)
    change[block.first[kept]] += 1
    change[ends + follows] -= 1
    mask = np.cumsum(change, dtype=np.int8)[: len(data)] > 0
    joined = data[mask].tobytes()
    sizes = np.bincount(documents, weights=ends + follows - block.first[kept], minlength=len(block.ids)).astype(np.int64)
    cuts = [0, *np.cumsum(sizes).tolist()]
    words = np.diff(block.starts)
    return pa.Table.from_arrays(
        [
            pa.array(block.ids, pa.int64()), pa.array(words, pa.int64()), pa.array(words - counts, pa.int64()),
            pa.array([hashlib.sha256(joined[a:b]).hexdigest() for a, b in zip(cuts[:-1], cuts[1:])]),
        ],
        schema=_ARROW,
    )


def _blocks(docs: DataFrame, blocks: int) -> DataFrame:
    rows = texts(docs)
    return rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(blocks)).cast("int"))


def kept_words(docs: DataFrame) -> DataFrame:
    """Of every document the number of words, of removed words, and the digest of the kept words joined by one space."""
    ship(docs.sparkSession)
    blocks = TEXT_BLOCKS * partitions(docs.sparkSession)
    parts = max(HASH_BLOCKS, blocks // 32)
    rows = _blocks(docs, blocks)
    anchors = rows.groupBy("block").applyInArrow(_list_anchors(parts), "part int, block int, once binary, more binary")
    shared = anchors.groupBy("part").applyInArrow(_share_anchors, "block int, anchors binary")
    windows = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(
        _list_windows(parts), "part int, block int, low binary, high binary, first binary"
    )
    repeated = windows.groupBy("part").applyInArrow(_look_up, "block int, low binary, high binary")
    return rows.groupBy("block").cogroup(repeated.groupBy("block")).applyInArrow(_cut, SCHEMA)


def sql() -> str:
    """The same rows in DuckDB's SQL, with the windows' words written out."""
    return rf"""
WITH source AS (
  SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents),
placed AS (SELECT r, doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i FROM source),
windows AS (
  SELECT *, string_agg(word, ' ') OVER w AS sequence, count(*) OVER w AS size
  FROM placed WINDOW w AS (PARTITION BY r ORDER BY i ROWS BETWEEN CURRENT ROW AND {WINDOW - 1} FOLLOWING)),
judged AS (
  SELECT *, size = {WINDOW} AND coalesce(doc_id > min(doc_id) FILTER (WHERE size = {WINDOW}) OVER (PARTITION BY sequence), false)
            AS repeated
  FROM windows),
marked AS (
  SELECT *, coalesce(bool_or(repeated) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN {WINDOW - 1} PRECEDING AND CURRENT ROW), false)
            AS gone
  FROM judged)
SELECT any_value(s.doc_id) AS doc_id, count(word) AS n_words, count(word) FILTER (WHERE gone) AS n_removed,
       sha256(coalesce(string_agg(word, ' ' ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM source AS s LEFT JOIN marked AS m ON m.r = s.r GROUP BY s.r"""
