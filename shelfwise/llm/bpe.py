"""Byte-level BPE encoding and decoding by corpus-level merge replay.

The distinct words of a whole batch of documents are laid out as one array of token ids.  An inverted index maps each
merge (by its rank) to the positions where its pair stands.  Merges are replayed in rank order from a heap: all
positions of a merge are joined at once, and only the pairs with the touched neighbours enter the index anew.  A word
goes through its merges lowest rank first and leftmost first, as an encoder that looks at one word at a time would do:
of several positions in one word only the leftmost is joined, and the others wait in the index, because joining may have
made a pair of lower rank.

Words are the matches of the split pattern, and a word that is itself a token is that token.  Texts are encoded whole;
a null text is an empty one with no tokens.  Every input row gives one row, repeated rows and null ids too.  Further
columns of the input are not read.
"""

from __future__ import annotations

import base64
import gc
import hashlib
import heapq
from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from shelfwise.llm.frames import chunks, in_arrow, table, texts

NEVER = np.int32(2**31 - 1)
#: Documents are encoded in pieces of about this many bytes of text; the words of a piece share one replay.
PIECE_BYTES = 1 << 24
#: Encoded words are remembered between pieces up to this number; beyond it the memory starts anew.
REMEMBERED_WORDS = 400_000

SCHEMA = "doc_id bigint, n_tokens bigint, ids_sha256 string, decoded_sha256 string"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()),
                    ("decoded_sha256", pa.string())])


class Vocabulary:
    """Token bytes by rank, and the rank that joining two tokens gives."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.size = max(ranks.values()) + 1
        self.single = np.array([ranks[bytes([b])] for b in range(256)], dtype=np.int32)
        pairs = [
            (ranks[token[:cut]] * self.size + ranks[token[cut:]], rank)
            for token, rank in ranks.items()
            for cut in range(1, len(token))
            if token[:cut] in ranks and token[cut:] in ranks
        ]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs] or [-1], dtype=np.int64)
        self.merged = np.array([r for _, r in pairs] or [NEVER], dtype=np.int32)

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        """A rank file: one base64 token and its rank per line."""
        with open(path, "rb") as lines:
            return cls({base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)})

    def joined(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair's merge, ``NEVER`` where there is none."""
        wanted = left.astype(np.int64) * self.size + right
        at = np.searchsorted(self.keys, wanted)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == wanted, self.merged[at], NEVER)

    def decode(self, ids: list[int]) -> bytes:
        return b"".join([self.bytes_of[i] for i in ids])


class _Index:
    """Positions by rank, and the ranks that have any in a heap."""

    def __init__(self) -> None:
        self.positions: dict[int, list[np.ndarray]] = {}
        self.heap: list[int] = []

    def add(self, ranks: np.ndarray, positions: np.ndarray) -> None:
        known = ranks != NEVER
        ranks, positions = ranks[known], positions[known]
        if not len(ranks):
            return
        order = np.argsort(ranks, kind="stable")
        ranks, positions = ranks[order], positions[order]
        cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
        for rank, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(positions, cuts)):
            if rank not in self.positions:
                self.positions[rank] = []
                heapq.heappush(self.heap, rank)
            self.positions[rank].append(part)

    def pop(self) -> tuple[int, np.ndarray]:
        rank = heapq.heappop(self.heap)
        return rank, np.sort(np.concatenate(self.positions.pop(rank)))


def replay(words: list[bytes], vocabulary: Vocabulary) -> list[list[int]]:
    """Token ids of each word (not empty), by replaying the merges over all of them together."""
    if not words:
        return []
    data = np.frombuffer(b"".join(words), dtype=np.uint8)
    count = len(data)
    lengths = np.array([len(w) for w in words], dtype=np.int64)
    word = np.repeat(np.arange(len(words), dtype=np.int32), lengths)
    token = vocabulary.single[data]
    after = np.arange(1, count + 1, dtype=np.int32)  # next live position; a word's end is seen by its number
    before = np.arange(-1, count - 1, dtype=np.int32)
    word_after = np.append(word, np.int32(-1))
    # Rank of the pair that starts at each position, now.
    pair = np.full(count, NEVER, dtype=np.int32)
    inner = np.flatnonzero(word[:-1] == word[1:])
    pair[inner] = vocabulary.joined(token[inner], token[inner + 1])
    alive = np.ones(count, dtype=bool)
    index = _Index()
    index.add(pair, np.arange(count, dtype=np.int32))
    while index.heap:
        rank, at = index.pop()
        at = at[pair[at] == rank]
        if not len(at):
            continue
        in_word = word[at]
        leftmost = np.ones(len(at), dtype=bool)
        leftmost[1:] = in_word[1:] != in_word[:-1]
        if not leftmost.all():
            index.add(np.full(int((~leftmost).sum()), rank, dtype=np.int32), at[~leftmost])
            at, in_word = at[leftmost], in_word[leftmost]
        gone = after[at]
        following = after[gone]
        token[at] = rank
        alive[gone] = False
        pair[gone] = NEVER
        after[at] = following
        has_next = word_after[following] == in_word
        before[following[has_next]] = at[has_next]
        pair[at] = NEVER
        left, right = at[has_next], following[has_next]
        pair[left] = vocabulary.joined(token[left], token[right])
        previous = before[at]
        has_previous = (previous >= 0) & (word[previous] == in_word)
        back, own = previous[has_previous], at[has_previous]
        pair[back] = vocabulary.joined(token[back], token[own])
        touched = np.concatenate([left, back])
        index.add(pair[touched], touched)
    ids = token[alive].tolist()
    ends = np.cumsum(np.bincount(word[alive], minlength=len(words))).tolist()
    return [ids[low:high] for low, high in zip([0, *ends], ends)]


class Encoder:
    """Encodes texts piece by piece and remembers each word's result between pieces, up to a bound.

    ``result`` makes what is remembered from a word's ids; by default the ids themselves.
    """

    def __init__(self, vocabulary: Vocabulary, pattern: str, result: Callable[[list[int]], Any] = tuple):
        self.vocabulary = vocabulary
        self.split = regex.compile(pattern).findall
        self.result = result
        self.known: dict[str, Any] = {}

    def words(self, texts: list[str]) -> list[list[str]]:
        """Every text's words, all of which are in ``known`` afterwards."""
        found = [self.split(text) for text in texts]
        if len(self.known) > REMEMBERED_WORDS:
            self.known = {}
        new = set().union(*found).difference(self.known)
        ranks = self.vocabulary.ranks
        split, as_bytes = [], []
        for word in new:
            data = word.encode()
            whole = ranks.get(data)
            if whole is None:
                split.append(word)
                as_bytes.append(data)
            else:
                self.known[word] = self.result([whole])
        self.known.update(zip(split, map(self.result, replay(as_bytes, self.vocabulary))))
        return found

    def encode(self, texts: list[str]) -> list[list[int]]:
        return [[i for word in words for i in self.known[word]] for words in self.words(texts)]


def _digests(encoder: Encoder, texts: list[str]) -> Iterator[tuple[int, str, str]]:
    """Of each text the number of tokens, the digest of its ids and of the decoded bytes.

    Ids are written out and decoded once per distinct word; both are plain concatenations over the words of a text.
    """
    for words in encoder.words(texts):
        counts, listed, decoded = zip(*[encoder.known[word] for word in words]) if words else ((), (), ())
        yield (sum(counts), hashlib.sha256(",".join(listed).encode()).hexdigest(),
               hashlib.sha256(b"".join(decoded)).hexdigest())


def written_out(vocabulary: Vocabulary) -> Callable[[list[int]], tuple[int, str, bytes]]:
    """Makes a word's number of ids, the ids in decimal, and their decoded bytes."""
    return lambda ids: (len(ids), ",".join(map(str, ids)), vocabulary.decode(ids))


def digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Token counts and digests of the encoded and the decoded text of every document; no shuffle.

    ``ranks_path`` must exist on every executor, as an installed package's file does.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.read(ranks_path)
        encoder = Encoder(vocabulary, pattern, written_out(vocabulary))
        gc.freeze()  # millions of remembered words need no tracing
        gc.disable()
        try:
            for whole in batches:
                for batch in chunks(whole, PIECE_BYTES):
                    rows = list(_digests(encoder, [t or "" for t in batch.column("text").to_pylist()]))
                    yield table(_ARROW, batch.column("doc_id"), *zip(*rows))
        finally:  # the worker goes on to other tasks
            gc.enable()
            gc.unfreeze()

    return in_arrow(texts(docs), run, SCHEMA)


def encoded(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Every document's ``doc_id`` and its token ``ids``."""
    arrow = pa.schema([("doc_id", pa.int64()), ("ids", pa.list_(pa.int32()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary.read(ranks_path), pattern)
        for whole in batches:
            for batch in chunks(whole, PIECE_BYTES // 4):
                ids = encoder.encode([t or "" for t in batch.column("text").to_pylist()])
                yield table(arrow, batch.column("doc_id"), ids)

    return in_arrow(texts(docs), run, "doc_id bigint, ids array<int>")


def decoded(tokens: DataFrame, ranks_path: str) -> DataFrame:
    """Texts from ``doc_id`` and ``ids``; null ids give a null text, bytes that are no UTF-8 become U+FFFD."""
    arrow = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = Vocabulary.read(ranks_path)
        for batch in batches:
            found = [None if ids is None else vocabulary.decode(ids).decode(errors="replace")
                     for ids in batch.column("ids").to_pylist()]
            yield table(arrow, batch.column("doc_id"), found)

    return in_arrow(tokens.select("doc_id", "ids"), run, "doc_id bigint, text string")
