"""Fill-in-middle over seekable compressed frames.

A text is stored as independent zstandard frames of whole units, with the number of units and of code points before each
frame.  A unit is a word with the white space before it, or white space that ends a text.  Two cuts, in units, make prefix,
middle and suffix.  Only the frames that a cut falls into are decompressed and compressed anew as their two parts; all others
are moved as they are, so a rearranged text is again a list of frames, and their concatenation is a plain zstandard stream.
Digests and the rebuilt text come from streaming the frames in order, one at a time.

The marks are ``<P>``, ``<S>`` and ``<M>`` before prefix, suffix and middle.  A text that is empty or holds one of the marks
stays plain, so marks in an output are never ambiguous.  Nothing is shuffled: every input row gives one row, repeated rows
and null ids too.  A null text is an empty one; a null id is hashed as no digits.  A text of any length is cut into frames of
bounded size, unless a single unit is longer.  Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import chunks, in_arrow, table, texts
from shelfwise.llm.words import text_buffers

#: Units in a frame; about 3 kB of prose.
FRAME_UNITS = 512
#: Bytes of text framed at a time.
PIECE_BYTES = 1 << 23
#: Of a hundred texts, those that are rearranged, and of a hundred of these, those whose suffix goes first.
REARRANGED, SUFFIX_FIRST = 50, 80
SEED = 42

PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
_ORDER = {"psm": (PREFIX, SUFFIX, MIDDLE), "spm": (SUFFIX, PREFIX, MIDDLE)}

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_FRAMED = pa.schema([("doc_id", pa.int64()), ("units", pa.list_(pa.int64())), ("chars", pa.list_(pa.int64())),
                     ("marked", pa.bool_()), ("frames", pa.list_(pa.binary()))])
_OUTPUT = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("form", pa.string()), ("prefix_chars", pa.int64()),
                     ("middle_chars", pa.int64()), ("frames", pa.list_(pa.binary()))])
_DIGESTS = pa.schema([*list(_OUTPUT)[:5], ("output_sha256", pa.string()), ("restored_sha256", pa.string())])


def unit_ends(data: np.ndarray) -> np.ndarray:
    """Byte after each unit of one UTF-8 text; white space is ASCII, so units end between characters."""
    if not len(data):
        return np.zeros(0, np.int64)
    space = _SPACE[data]
    closes = ~space
    closes[:-1] &= space[1:]
    closes[-1] = True  # the last word, or the white space that ends the text
    return np.flatnonzero(closes) + 1


def _code_points(data: np.ndarray) -> int:
    return len(data) - int(np.count_nonzero((data & 0xC0) == 0x80))


class Frames:
    """One text: compressed frames, and units and code points before each frame and at the end."""

    def __init__(self, units: list[int], chars: list[int], data: list[bytes]):
        self.units, self.chars, self.data = units, chars, data

    @classmethod
    def of(cls, text: np.ndarray, units_a_frame: int, compress) -> Frames:
        ends = unit_ends(text)
        borders = ends[units_a_frame - 1 :: units_a_frame].tolist()
        if len(ends) and (not borders or borders[-1] < len(text)):
            borders.append(len(text))
        units, chars, data, at = [0], [0], [], 0
        for border in borders:
            part = text[at:border]
            data.append(compress(part.tobytes()))
            chars.append(chars[-1] + _code_points(part))
            at = border
        units += [min(k * units_a_frame, len(ends)) for k in range(1, len(borders) + 1)]
        return cls(units, chars, data)

    def cut(self, unit: int, decompress) -> Cut:
        """The place after ``unit`` units; decompresses a frame only if the place is within one."""
        frame = bisect_right(self.units, unit) - 1
        if self.units[frame] == unit:
            return Cut(frame, 0, b"", self.chars[frame])
        raw = decompress(self.data[frame])
        at = int(unit_ends(np.frombuffer(raw, np.uint8))[unit - self.units[frame] - 1])
        return Cut(frame, at, raw, self.chars[frame] + len(raw[:at].decode()))

    def between(self, first: Cut, last: Cut, compress) -> list[bytes]:
        """Frames of the text from one cut to another."""
        if first.frame == last.frame:
            part = last.raw[first.at : last.at]
            return [compress(part)] if part else []
        start, found = first.frame, []
        if first.at:
            found.append(compress(first.raw[first.at :]))
            start += 1
        found += self.data[start : last.frame]
        if last.at:
            found.append(compress(last.raw[: last.at]))
        return found


class Cut:
    """A place in a text: frame, byte within it (0 at its border), the frame's bytes, code points before the place."""

    def __init__(self, frame: int, at: int, raw: bytes, chars: int):
        self.frame, self.at, self.raw, self.chars = frame, at, raw, chars


def rearranged(text: Frames, form: str, first: int, last: int, compress, decompress) -> tuple[int, int, list[bytes]]:
    """Code points of prefix and middle, and the output's frames, for cuts after ``first`` and ``last`` units."""
    start, end = Cut(0, 0, b"", 0), Cut(len(text.data), 0, b"", text.chars[-1])
    a, b = text.cut(first, decompress), text.cut(last, decompress)
    parts = {PREFIX: (start, a), MIDDLE: (a, b), SUFFIX: (b, end)}
    found: list[bytes] = []
    for mark in _ORDER[form]:
        found.append(compress(mark.encode()))
        found += text.between(*parts[mark], compress)
    return a.chars, b.chars - a.chars, found


def _marks(frames: list[bytes], form: str, decompress, seen) -> tuple[list[int], list[int]]:
    """Bytes before each frame and at the end, and the place of each mark; hands every frame's bytes to ``seen``."""
    wanted = [mark.encode() for mark in _ORDER.get(form, ())]
    before, places, rest = [0], [], b""
    for frame in frames:
        raw = decompress(frame)
        seen(raw)
        window, start = rest + raw, 0
        while len(places) < len(wanted) and (hit := window.find(wanted[len(places)], start)) >= 0:
            places.append(before[-1] - len(rest) + hit)
            start = hit + len(wanted[0])
        rest = window[max(start, len(window) - len(PREFIX) + 1) :]  # a mark may lie across frames
        before.append(before[-1] + len(raw))
    return before, places


def _stream(frames: list[bytes], before: list[int], low: int, high: int, decompress) -> Iterator[bytes]:
    """Bytes ``low`` to ``high`` of an output, decompressing only the frames that hold them."""
    frame = bisect_right(before, low) - 1
    while low < high:
        part = decompress(frames[frame])[low - before[frame] : high - before[frame]]
        yield part
        low += len(part)
        frame += 1


def digests_of(frames: list[bytes], form: str, decompress) -> tuple[str, str]:
    """Digest of an output, and of the text that is rebuilt from the output and its form alone."""
    output = hashlib.sha256()
    before, places = _marks(frames, form, decompress, output.update)
    if form == "plain":
        return output.hexdigest(), output.hexdigest()
    ends = [*places[1:], before[-1]]
    spans = {mark: (place + len(mark), end) for mark, place, end in zip(_ORDER[form], places, ends)}
    restored = hashlib.sha256()
    for mark in (PREFIX, MIDDLE, SUFFIX):
        for part in _stream(frames, before, *spans[mark], decompress):
            restored.update(part)
    return output.hexdigest(), restored.hexdigest()


def framed(docs: DataFrame, units_a_frame: int = FRAME_UNITS) -> DataFrame:
    """Every text as ``frames``, with ``units`` and ``chars`` before each of them and at the end.

    ``marked`` says that the text holds a mark.  A table to write once and to draw any number of rearrangements from.
    """
    marks = [mark.encode() for mark in (PREFIX, SUFFIX, MIDDLE)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress = zstandard.ZstdCompressor(level=3).compress
        for whole in batches:
            for batch in chunks(whole, PIECE_BYTES):
                data, offsets = text_buffers(batch.column("text"))
                raw = [data[low:high] for low, high in zip(offsets[:-1], offsets[1:])]
                found = [Frames.of(text, units_a_frame, compress) for text in raw]
                marked = [any(mark in whole for mark in marks) for whole in map(np.ndarray.tobytes, raw)]
                yield table(_FRAMED, batch.column("doc_id"), [t.units for t in found], [t.chars for t in found], marked,
                            [t.data for t in found])

    return in_arrow(
        texts(docs), run,
        "doc_id bigint, units array<bigint>, chars array<bigint>, marked boolean, frames array<binary>",
    )


def transformed(store: DataFrame, seed: int = SEED, rearranged_of_100: int = REARRANGED,
                suffix_first_of_100: int = SUFFIX_FIRST) -> DataFrame:
    """Every framed text in its form: ``n`` units, code points of prefix and middle (null if plain), output ``frames``."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * k, 8), 16, 10).cast("bigint").alias(f"h{k + 1}") for k in range(4)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        compress, decompress = zstandard.ZstdCompressor(level=3).compress, zstandard.ZstdDecompressor().decompress

        def one(units, chars, marked, frames, h1, h2, h3, h4):
            n = units[-1]
            if not n or marked or h3 % 100 >= rearranged_of_100:
                return n, "plain", None, None, frames
            form = "spm" if h4 % 100 < suffix_first_of_100 else "psm"
            first, last = sorted((h1 % (n + 1), h2 % (n + 1)))
            return n, form, *rearranged(Frames(units, chars, frames), form, first, last, compress, decompress)

        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                columns = [part.column(c).to_pylist() for c in ("units", "chars", "marked", "frames", "h1", "h2", "h3", "h4")]
                yield table(_OUTPUT, part.column("doc_id"), *zip(*map(one, *columns)))

    return in_arrow(
        store.select("doc_id", "units", "chars", "marked", "frames", *draws), run,
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, frames array<binary>",
    )


def output_texts(outputs: DataFrame) -> DataFrame:
    """``doc_id``, ``form`` and the output as ``text``."""
    arrow = pa.schema([("doc_id", pa.int64()), ("form", pa.string()), ("text", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                found = [b"".join(map(decompress, frames)).decode() for frames in part.column("frames").to_pylist()]
                yield table(arrow, part.column("doc_id"), part.column("form"), found)

    return in_arrow(outputs.select("doc_id", "form", "frames"), run, "doc_id bigint, form string, text string")


def digests(outputs: DataFrame) -> DataFrame:
    """Digests of every output and of the text rebuilt from it, instead of its frames."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        decompress = zstandard.ZstdDecompressor().decompress
        for batch in batches:
            for low in range(0, len(batch), 512):
                part = batch.slice(low, 512)
                found = [digests_of(frames, form, decompress)
                         for frames, form in zip(part.column("frames").to_pylist(), part.column("form").to_pylist())]
                yield table(_DIGESTS, *[part.column(c) for c in _OUTPUT.names[:5]], *zip(*found))

    return in_arrow(
        outputs, run,
        "doc_id bigint, n bigint, form string, prefix_chars bigint, middle_chars bigint, output_sha256 string, "
        "restored_sha256 string",
    )
