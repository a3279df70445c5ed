"""Fill-in-middle against a version that works on plain strings."""

import hashlib
import random
import re

import public_tokenizers  # noqa: F401  (the queries' module needs it)
import zstandard

from shelfwise.llm import fill_in_middle, queries

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, units string, frames int, h1 string, form int, n string"


def plainly(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    h = hashlib.sha256(f"42:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    digest = lambda t: hashlib.sha256(t.encode()).hexdigest()
    if not text or re.search("<[PSM]>", text) or h3 % 100 >= 50:
        return (doc_id, n, "plain", None, None, digest(text), digest(text)), text
    a, b = sorted((h1 % (n + 1), h2 % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if h4 % 100 < 80:
        form, output = "spm", f"<S>{suffix}<P>{prefix}<M>{middle}"
    else:
        form, output = "psm", f"<P>{prefix}<S>{suffix}<M>{middle}"
    return (doc_id, n, form, len(prefix), len(middle), digest(output), digest(text)), output


def cases():
    rng = random.Random(3)
    alphabet = ["a", "bc", " ", "  ", "\n", "\t", "\x0b", "\x0c", "\r", "é", "日本", "😀", "<", "S>", "P", ">", "\x1c", "\xa0", "\x00"]
    rows = [(i, "".join(rng.choices(alphabet, k=rng.randint(0, 90)))) for i in range(600)]
    rows += [(700 + i, "word  and\nmore " * rng.randint(200, 900) + "end" * (i % 2)) for i in range(40)]
    rows += [(None, None), (None, "a text without an id"), (1000, None), (1001, ""), (1002, " \n "), (1003, "x" * 100_000),
             (1004, "ab <P> cd"), (1005, "ab <M> cd"), (1008, "a< P>b<P >c<PS>"), (1006, "words " * 511 + "<S> " + "words " * 600),
             (1007, "long text, é日本 with words 12 ab-cd\n" * 30_000), (700, "again"), (700, "again")]
    return rows


def key(row):
    return [(v is not None, v) for v in row]


def test_digests_and_outputs_equal_plain_strings(spark):
    rows = cases()
    docs = spark.createDataFrame([(*r, "u", 1, "h", 2, "n") for r in rows], SCHEMA).repartition(3)
    expected = [plainly(*r) for r in rows]
    for units in (1, 3, fill_in_middle.FRAME_UNITS):
        outputs = fill_in_middle.transformed(fill_in_middle.framed(docs, units))
        assert sorted(map(tuple, fill_in_middle.digests(outputs).collect()), key=key) == sorted((e for e, _ in expected), key=key)
        found = sorted(((r["doc_id"], r["form"], r["text"]) for r in fill_in_middle.output_texts(outputs).collect()), key=key)
        assert found == sorted(((e[0], e[2], t) for e, t in expected), key=key)
    forms = {e[2] for e, _ in expected}
    assert forms == {"plain", "psm", "spm"}


def test_marks_of_frames_are_found_across_their_borders(spark):
    compress, decompress = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    frames = [compress(p) for p in (b"<", b"P>pre <", b"S", b">suf<", b"M>", b"mid")]
    output = hashlib.sha256(b"<P>pre <S>suf<M>mid").hexdigest()
    assert fill_in_middle.digests_of(frames, "psm", decompress) == (output, hashlib.sha256(b"pre midsuf").hexdigest())


def test_only_cut_frames_are_decompressed():
    compress, decompress = zstandard.ZstdCompressor().compress, zstandard.ZstdDecompressor().decompress
    import numpy as np

    text = np.frombuffer(b"word " * 10_000, np.uint8)
    store = fill_in_middle.Frames.of(text, 100, compress)
    assert store.units[-1] == 10_001 and len(store.data) == 101
    opened = []
    prefix, middle, frames = fill_in_middle.rearranged(
        store, "psm", 4_250, 7_000, compress, lambda frame: opened.append(1) or decompress(frame))
    assert len(opened) == 1  # the second cut is at a border
    assert prefix == 4 + 5 * 4_249 and middle == 5 * 2_750
    whole = zstandard.ZstdDecompressor().stream_reader(b"".join(frames), read_across_frames=True).read()
    raw = text.tobytes()
    a, b = prefix, prefix + middle
    assert whole == b"<P>" + raw[:a] + b"<S>" + raw[b:] + b"<M>" + raw[a:b]


def test_query_reads_the_whole_table(spark, tmp_path):
    rows = [(i, f"text {i} " * (i % 50)) for i in range(300)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op13_fill_in_middle"](spark, str(tmp_path))
    assert sorted(map(tuple, found.collect()), key=key) == sorted((plainly(*r)[0] for r in rows), key=key)
    empty = spark.createDataFrame([], "doc_id bigint, text string")
    outputs = fill_in_middle.transformed(fill_in_middle.framed(empty))
    assert fill_in_middle.digests(outputs).collect() == [] and fill_in_middle.output_texts(outputs).collect() == []
