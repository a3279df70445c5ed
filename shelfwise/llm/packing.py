"""Hierarchical multi-length packing of tokenized documents into training sequences.

Documents are routed to tiers by length: whole windows of the longest context are cut off first, and the rest goes to the
shortest context that holds it.  Tiers are packed from the longest down, each window opened by its tier's longest rest.
The gap that is left in a window is filled from the shorter tiers by the largest rest that fits whole; when none fits, the
longest rest is cut to fill the gap and what remains of it is routed anew.  So every window is full, short documents go
first into the gaps of long windows, and a window costs one cut at most.  Sequences of one tier are dealt to step groups of
about equal tokens in order of attention cost, back and forth, so that the steps of a tier cost alike.

Every task packs the documents of its own input partition, a bounded block of tokens at a time, without a shuffle; rests that
fill no window go on to the next block.  At most once a task, fewer tokens than one window are left: they fill windows of
smaller powers of two.  No token is padding.  Ids of sequences hold the number of the partition, so a task that runs again
gives the same rows as long as its partition has the same rows in the same order, as a file scan does.

A null text is an empty one; an empty text is the end id alone.  Every input row is a document of its own, repeated rows and
null ids too.  Further columns of the input are not read.
"""

from __future__ import annotations

import os
from bisect import bisect_left, bisect_right, insort
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import chunks, in_arrow, table, texts

#: Context sizes, powers of two.
TIERS = (256, 512, 1024, 2048)
END_ID = 1
#: Tokens of a training step.
STEP_TOKENS = 1 << 17
#: Texts are tokenized in pieces of about this many bytes and packed in blocks of this many tokens.
PIECE_BYTES = 1 << 23
BLOCK_TOKENS = 1 << 22
#: Words whose ids are remembered by a worker process; beyond it the memory starts anew.
REMEMBERED_WORDS = 1_000_000
#: Longer words are not remembered.
REMEMBERED_BYTES = 64
#: Words tokenized in one call.
CALL = 2_000

SCHEMA = ("doc_id bigint, start bigint, length bigint, doc_tokens bigint, sequence_id bigint, offset bigint, tier int, "
          "step_group bigint, ids binary")
_ARROW = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("length", pa.int64()), ("doc_tokens", pa.int64()),
                    ("sequence_id", pa.int64()), ("offset", pa.int64()), ("tier", pa.int32()), ("step_group", pa.int64()),
                    ("ids", pa.binary())])
#: Numbers of sequences and steps of one partition.
_SERIALS = 1 << 36

_STOPS = b".,;:!?"


# Byte-level tokenizers write a byte as the character of its number if that is printable, and the others, in order, as the
# characters from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
_BYTE_CHARACTERS = {byte: 256 + k for k, byte in enumerate(b for b in range(256) if b not in _PRINTABLE) if byte > 127}


def _is_small_latin(word: bytes) -> bool:
    """Whether a word has only letters below U+0250 that are their own lower case; those are in normal form C too."""
    text = word.decode()
    return text.isalpha() and max(text) < "\u0250" and text.lower() == text


class WordIds:
    """Ids of texts by a tokenizer that never joins what white space divides, learned once per distinct word.

    Lower-casing ASCII letters and taking the marks off the end of a word first changes no id and makes fewer words: the
    tokenizer lower-cases, and divides letters and digits from marks.  The strings of special tokens in a text are text.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # tasks share the cores already
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        # For words of small Latin letters, all that the tokenizer does before it looks for merges is to write their bytes
        # as characters.
        self.merges_only = Tokenizer(self.tokenizer.model)
        self.merges_only.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.known: dict[bytes, bytes] = {}
        self.long: set[bytes] = set()

    def _one_by_one(self, words: list[bytes]) -> list[bytes]:
        found = self.tokenizer.encode_batch_fast([w.decode() for w in words], add_special_tokens=False)
        return [np.array(e.ids, dtype="<u4").tobytes() for e in found]

    def _together(self, words: list[bytes]) -> list[bytes]:
        """Words of small Latin letters, in one text: each is one word of the tokenizer, and is seen by its end."""
        joined = b" ".join(words)
        text = joined.decode("latin-1")
        text = text if joined.isascii() else text.translate(_BYTE_CHARACTERS)
        ids = np.array(self.merges_only.encode(text, add_special_tokens=False).ids, dtype="<u4")
        raw, bounds = ids.tobytes(), (4 * (np.flatnonzero(self.ends[ids]) + 1)).tolist()
        return [raw[low:high] for low, high in zip([0, *bounds], bounds)]

    def _learn(self, words: Iterable[bytes]) -> None:
        parted, wanted = [], set()
        for word in words:
            stem = word.rstrip(_STOPS)
            if len(stem) < len(word) and stem[-1:].isalnum():
                parted.append((word, stem))
                wanted.update((stem, word[len(stem) :]))
            else:
                wanted.add(word)
        new = wanted.difference(self.known)
        ascii, latin, others = [], [], []
        for word in new:
            (ascii if word.isalpha() else latin if _is_small_latin(word) else others).append(word)
        for some, encode in ((ascii, self._together), (latin, self._together), (others, self._one_by_one)):
            for low in range(0, len(some), CALL):
                part = some[low : low + CALL]
                self.known.update(zip(part, encode(part)))
        self.known.update((word, self.known[stem] + self.known[word[len(stem) :]]) for word, stem in parted)
        self.long.update(word for word in chain(new, (word for word, _ in parted)) if len(word) > REMEMBERED_BYTES)

    def ids(self, documents: list[str | None]) -> list[bytes]:
        """Little-endian 32-bit ids of each text."""
        split = [(text or "").encode().lower().split() for text in documents]
        if len(self.known) > REMEMBERED_WORDS:
            self.known = {}
        self._learn(set().union(*split).difference(self.known))
        found = [b"".join(map(self.known.__getitem__, words)) for words in split]
        for word in self.long:
            del self.known[word]
        self.long = set()
        return found


_learned: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The tokenizer of a worker process, which remembers words between tasks."""
    if path not in _learned:
        _learned[path] = WordIds(path)
    return _learned[path]


Piece = tuple[int, int, int]  # document, start, length


class Rests:
    """Pieces by length, with the longest and the largest that fits at hand."""

    def __init__(self) -> None:
        self.by_length: dict[int, list[Piece]] = {}
        self.lengths: list[int] = []

    def add(self, piece: Piece) -> None:
        length = piece[2]
        if length not in self.by_length:
            self.by_length[length] = []
            insort(self.lengths, length)
        self.by_length[length].append(piece)

    def _take(self, length: int) -> Piece:
        some = self.by_length[length]
        piece = some.pop()
        if not some:
            del self.by_length[length]
            self.lengths.pop(bisect_left(self.lengths, length))
        return piece

    def longest(self) -> int:
        return self.lengths[-1] if self.lengths else 0

    def take_longest(self) -> Piece:
        return self._take(self.lengths[-1])

    def take_fitting(self, gap: int) -> Piece | None:
        at = bisect_right(self.lengths, gap)
        return self._take(self.lengths[at - 1]) if at else None


def pack(documents: list[tuple[int, int, int]], tiers: tuple[int, ...]) -> tuple[list[tuple[int, list[Piece]]], list[Piece]]:
    """Full windows ``(tier, pieces)`` of documents ``(number, start, end)``, and the pieces that fill no window.

    The pieces left over are together shorter than the longest tier.
    """
    top = tiers[-1]
    windows: list[tuple[int, list[Piece]]] = []
    rests = Rests()
    for number, start, end in documents:
        while end - start >= top:
            windows.append((top, [(number, start, top)]))
            start += top
        if end > start:
            rests.add((number, start, end - start))
    for shorter, tier in zip((*reversed(tiers[:-1]), 0), reversed(tiers)):
        while rests.longest() > shorter:
            window, gap = [], tier
            while gap and rests.lengths:
                piece = rests.take_fitting(gap) if window else rests.take_longest()
                if piece is None:
                    number, start, length = rests.take_longest()
                    piece = (number, start, gap)
                    rests.add((number, start + gap, length - gap))
                window.append(piece)
                gap -= piece[2]
            if gap:  # nothing is left
                return windows, window
            windows.append((tier, window))
    return windows, []


def halved(pieces: list[Piece], tiers: tuple[int, ...]) -> list[tuple[int, list[Piece]]]:
    """Full windows of the few tokens that are left, of powers of two from the longest down."""
    windows, size = [], tiers[-1]
    left = sum(length for _, _, length in pieces)
    queue = list(reversed(pieces))
    while left:
        while size > left:
            size //= 2
        window, gap = [], size
        while gap:
            number, start, length = queue.pop()
            window.append((number, start, min(length, gap)))
            if length > gap:
                queue.append((number, start + gap, length - gap))
            gap -= window[-1][2]
        windows.append((size, window))
        left -= size
    return windows


def step_groups(windows: list[tuple[int, list[Piece]]], step_tokens: int) -> list[int]:
    """A step for each window: one tier a step, about ``step_tokens`` each, dealt by cost back and forth."""
    groups, first = [0] * len(windows), 0
    by_tier: dict[int, list[int]] = {}
    for k, (tier, _) in enumerate(windows):
        by_tier.setdefault(tier, []).append(k)
    for tier in sorted(by_tier):
        members = sorted(by_tier[tier], key=lambda k: -sum(length * length for _, _, length in windows[k][1]))
        steps = max(1, round(len(members) * tier / step_tokens))
        for place, k in enumerate(members):
            turn, at = divmod(place, steps)
            groups[k] = first + (at if turn % 2 == 0 else steps - 1 - at)
        first += steps
    return groups


class _Packer:
    """Packs the documents of one task block by block, and numbers sequences and steps."""

    def __init__(self, partition: int, tiers: tuple[int, ...], step_tokens: int):
        self.tiers, self.step_tokens = tiers, step_tokens
        self.sequence = self.step = partition * _SERIALS
        self.documents: list[tuple[int | None, bytes]] = []  # id and token ids
        self.waiting: list[Piece] = []
        self.tokens = 0

    def add(self, doc_id: int | None, ids: bytes) -> None:
        self.waiting.append((len(self.documents), 0, len(ids) // 4))
        self.documents.append((doc_id, ids))
        self.tokens += len(ids) // 4

    def packed(self, last: bool) -> Iterator[pa.RecordBatch]:
        """Rows of all full windows; what fills none stays, unless this is the task's last block."""
        windows, rest = pack([(number, start, start + length) for number, start, length in self.waiting], self.tiers)
        if last:
            windows += halved(rest, self.tiers)
            rest = []
        groups = step_groups(windows, self.step_tokens)
        rows = []
        for (tier, window), group in zip(windows, groups):
            offset = 0
            for number, start, length in window:
                doc_id, ids = self.documents[number]
                rows.append((doc_id, start, length, len(ids) // 4, self.sequence, offset, tier, self.step + group,
                             ids[4 * start : 4 * (start + length)]))
                offset += length
            self.sequence += 1
        self.step += max(groups, default=-1) + 1
        kept = {number: k for k, number in enumerate(dict.fromkeys(number for number, _, _ in rest))}
        self.documents = [self.documents[number] for number in kept]
        self.waiting = [(kept[number], start, length) for number, start, length in rest]
        self.tokens = sum(length for _, _, length in self.waiting)
        for low in range(0, len(rows), 20_000):
            yield table(_ARROW, *zip(*rows[low : low + 20_000]))


def packed(docs: DataFrame, tokenizer: str, tiers: tuple[int, ...] = TIERS, end_id: int = END_ID,
           step_tokens: int = STEP_TOKENS) -> DataFrame:
    """One row per piece of a document: its place in the document and in a sequence, and its little-endian ``ids``.

    ``tokenizer`` is a file that exists on every executor.  ``tier`` is the size of the piece's sequence.
    """
    sizes = tuple(sorted(tiers))
    if not sizes or any(size < 1 or size & (size - 1) for size in sizes):
        raise ValueError("tiers must be powers of two")
    end = np.array([end_id], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = word_ids(tokenizer)
        packer = _Packer(TaskContext.get().partitionId(), sizes, step_tokens)
        for whole in batches:
            for batch in chunks(whole, PIECE_BYTES):
                for doc_id, ids in zip(batch.column("doc_id").to_pylist(), encoder.ids(batch.column("text").to_pylist())):
                    packer.add(doc_id, ids + end)
                if packer.tokens >= BLOCK_TOKENS:
                    yield from packer.packed(last=False)
        yield from packer.packed(last=True)

    return in_arrow(texts(docs), run, SCHEMA)


def sequences(pieces: DataFrame) -> DataFrame:
    """One row per sequence, ready to train on: its ``ids`` in order, and the ``lengths`` of its documents' pieces."""
    ordered = F.sort_array(F.collect_list(F.struct("offset", "length", "ids")))
    return (
        pieces.groupBy("sequence_id", "tier", "step_group").agg(ordered.alias("parts"))
        .select("sequence_id", "tier", "step_group", F.col("parts.length").alias("lengths"),
                F.aggregate("parts.ids", F.lit(b""), lambda found, ids: F.concat(found, ids)).alias("ids"))
    )


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with a checksum of their ids instead of the ids."""
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset", "tier",
        "step_group",
    )
