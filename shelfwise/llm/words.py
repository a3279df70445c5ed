"""Words and their hashes, found in whole Arrow text columns at once.

A column of texts is one byte buffer with offsets.  Words are located with table look-ups on the bytes and hashed with
prefix sums of a polynomial modulo 2**64, so no Python object is made per word.  Work goes in slices of about
``SLICE`` bytes, so that memory stays bounded for texts of any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

SLICE = 1 << 18
U64 = np.uint64
_STEP = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2**64

_rng = np.random.default_rng(20240817)
# Two byte alphabets.  Folded: words are runs of ASCII letters, digits and all non-ASCII bytes, A-Z read as a-z.
# Plain: words are runs of anything but the space and the bytes 9 to 13, unchanged.
_FOLDED = np.zeros(256, dtype=bool)
_FOLDED[128:] = True
for _first, _last in ("09", "az", "AZ"):
    _FOLDED[ord(_first) : ord(_last) + 1] = True
_PLAIN = np.ones(256, dtype=bool)
_PLAIN[[9, 10, 11, 12, 13, 32]] = False
_VALUES = _rng.integers(1, 2**64, 256, dtype=U64)
_FOLDED_VALUES = _VALUES.copy()
_FOLDED_VALUES[65:91] = _VALUES[97:123]
_FACTORS = _rng.integers(1, 2**64, 64, dtype=U64) | U64(1)

_powers = np.ones(1, dtype=U64)
_inverses = np.ones(1, dtype=U64)


def _geometric(ratio: int, size: int) -> np.ndarray:
    factors = np.full(size, ratio, dtype=U64)
    factors[0] = 1
    return np.cumprod(factors, dtype=U64)


def _grow_powers(length: int) -> None:
    global _powers, _inverses
    if len(_powers) < length:
        size = max(length, SLICE + 1)
        _powers, _inverses = _geometric(_STEP, size), _geometric(pow(_STEP, -1, 2**64), size)


def mixed(h: np.ndarray) -> np.ndarray:
    """Spread every bit of the hashes over all bits (the finalizer of splitmix64)."""
    h = h ^ (h >> U64(30))
    h *= U64(0xBF58476D1CE4E5B9)
    h ^= h >> U64(27)
    h *= U64(0x94D049BB133111EB)
    h ^= h >> U64(31)
    return h


def text_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes and offsets of a text column; a null is an empty text."""
    if column.null_count:
        column = pc.fill_null(column, "")
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    if data is None or ends[-1] == ends[0]:
        return np.zeros(0, np.uint8), ends - ends[0]
    return np.frombuffer(data, dtype=np.uint8)[ends[0] : ends[-1]], ends - ends[0]


def bytes_buffers(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    offsets = np.zeros(len(texts) + 1, np.int64)
    np.cumsum([len(t) for t in texts], out=offsets[1:])
    return np.frombuffer(b"".join(texts), dtype=np.uint8), offsets


def scan_words(data: np.ndarray, offsets: np.ndarray, folded: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, first byte and end byte of every word, and for each text where its words start (one more at the end)."""
    is_word, values = (_FOLDED, _FOLDED_VALUES) if folded else (_PLAIN, _VALUES)
    hashes, firsts, ends = [], [], []
    at, size = 0, len(data)
    while at < size:
        stop = min(size, at + SLICE)
        if stop < size:  # end the slice where a word or a text ends
            while True:
                gaps = np.flatnonzero(~is_word[data[at:stop]])
                text_end = int(offsets[np.searchsorted(offsets, stop, side="right") - 1])
                cut = max(at + int(gaps[-1]) + 1 if len(gaps) else at, text_end)
                if cut > at or stop == size:
                    stop = cut if cut > at else size
                    break
                stop = min(size, stop + 4 * SLICE)
        part = data[at:stop]
        inside = is_word[part]
        begins = inside.copy()
        begins[1:] &= ~inside[:-1]
        closes = inside.copy()
        closes[:-1] &= ~inside[1:]
        low, high = np.searchsorted(offsets, [at, stop])
        edges = offsets[low:high] - at  # a text may touch the next one without a gap
        edges = edges[(edges > 0) & (edges < len(part))]
        begins[edges] = inside[edges]
        closes[edges - 1] = inside[edges - 1]
        first, end = np.flatnonzero(begins), np.flatnonzero(closes) + 1
        _grow_powers(len(part) + 1)
        sums = np.empty(len(part) + 1, dtype=U64)
        sums[0] = 0
        np.cumsum(values[part] * _powers[: len(part)], out=sums[1:])
        h = (sums[end] - sums[first]) * _inverses[first]
        hashes.append(mixed(h))
        firsts.append(first + at)
        ends.append(end + at)
        at = stop
    if not hashes:
        empty = np.zeros(0, np.int64)
        return np.zeros(0, U64), empty, empty, np.zeros(len(offsets), np.int64)
    first = np.concatenate(firsts)
    return np.concatenate(hashes), first, np.concatenate(ends), np.searchsorted(first, offsets)


def heads_of(data: np.ndarray, first: np.ndarray, end: np.ndarray, lengths: tuple[int, ...]) -> list[np.ndarray]:
    """Hashes of the first bytes of each folded word, for each of the ascending lengths; 0 for words not longer."""
    found = []
    total = np.zeros(len(first), dtype=U64)
    for j in range(lengths[-1]):
        inside = np.minimum(first + j, max(len(data) - 1, 0))
        total += _FOLDED_VALUES[data[inside]] * _FACTORS[j]
        if j + 1 in lengths:
            found.append(np.where(end - first > j + 1, mixed(total ^ U64(j + 1)), U64(0)))
    return found


def runs_of(hashes: np.ndarray, length: int, salt: int = 0) -> np.ndarray:
    """Hash of every ``length`` consecutive words, also across texts (the caller leaves those out)."""
    count = len(hashes) - length + 1
    if count <= 0:
        return np.zeros(0, U64)
    total = hashes[:count] * _FACTORS[salt]
    for j in range(1, length):
        total += hashes[j : j + count] * _FACTORS[(salt + j) % 64]
    return mixed(total)


def shingles(hashes: np.ndarray, starts: np.ndarray, length: int) -> Iterator[np.ndarray]:
    """Per text, the hashes of its runs of ``length`` words in order; a shorter text with words is one run."""
    every = runs_of(hashes, length)
    for low, high in zip(starts[:-1].tolist(), starts[1:].tolist()):
        if high - low >= length:
            yield every[low : high - length + 1]
        elif high > low:
            yield runs_of(hashes[low:high], high - low)
        else:
            yield np.zeros(0, U64)


def slices(offsets: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about ``most`` bytes each, one text at least."""
    low, count = 0, len(offsets) - 1
    while low < count:
        high = int(np.searchsorted(offsets, offsets[low] + most, side="right")) - 1
        high = min(max(high, low + 1), count)
        yield low, high
        low = high
