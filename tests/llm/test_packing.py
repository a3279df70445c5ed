"""Packing: every token in one place, windows full, ids as the tokenizer gives them."""

import collections
import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from shelfwise.llm import packing, queries

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, tier int, sequence_id string, ids int, `offset` string, length string"


@pytest.fixture(scope="module")
def tokenizer():
    found = Tokenizer.from_file(PATH)
    found.encode_special_tokens = True
    return found


def plain_ids(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 1]


def test_ids_equal_the_tokenizer(tokenizer):
    rng = random.Random(11)
    parts = ["The", "don't", "I'LL", "'s", " ", "  ", "\n", "\t", "\x0b", "\x1c", "\x85", "\xa0", " ", "　", "é", "é",
             "́", "K", "İ", "ΣΑΣ", "ß", "日本", "12,5", "a.b", "...", "word.", "x!?", "<|endoftext|>", "😀", "가",
             "fi", "\x00", "_", "-", "co-op", "'", "naïve", "Ａ", "שלום", "יִ"]
    texts = ["".join(rng.choices(parts, k=rng.randint(0, 40))) for _ in range(1500)]
    texts += [" ".join(chr(c) + "x " + chr(c) for c in range(low, low + 64) if chr(c).isprintable()) for low in range(0x80, 0x300, 64)]
    texts += ["", None, "a" * 5_000, "." * 900, " " * 50, "The quick brown fox, the quick. THE QUICK!"]
    encoder = packing.WordIds(PATH)
    for low in range(0, len(texts), 100):
        some = texts[low : low + 100]
        assert [np.frombuffer(ids, "<u4").tolist() + [1] for ids in encoder.ids(some)] == [plain_ids(tokenizer, t) for t in some]
    assert max(map(len, encoder.known)) <= packing.REMEMBERED_BYTES


def check(pieces, documents):
    """``pieces`` have doc_id, start, length, doc_tokens, sequence_id, offset; ``documents`` are lists of ids by id."""
    by_doc, by_sequence = collections.defaultdict(list), collections.defaultdict(list)
    for p in pieces:
        by_doc[p["doc_id"]].append(p)
        by_sequence[p["sequence_id"]].append(p)
    assert set(by_doc) == set(documents)
    for doc_id, found in by_doc.items():
        expected = documents[doc_id]
        at = 0
        for p in sorted(found, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(expected)
            raw = np.array(expected[at : at + p["length"]], dtype="<u4").tobytes()
            assert p["ids_crc32"] == zlib.crc32(raw)
            at += p["length"]
        assert at == len(expected)
    padding = 0
    for found in by_sequence.values():
        at = 0
        for p in sorted(found, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at <= 2048 and len({(p["tier"], p["step_group"]) for p in found}) == 1
        assert found[0]["tier"] == at
        padding += 0 if at & (at - 1) == 0 else 2048 - at
    return padding, by_sequence


def test_rows_of_edge_cases(spark, tokenizer):
    rng = random.Random(2)
    rows = [(i, " ".join(rng.choices(["some", "Words", "here,", "unbelievable.", "日本"], k=rng.choice([0, 3, 50, 300, 900])))) for i in range(400)]
    rows += [(1000, None), (1001, ""), (1002, " \n"), (1003, "long text of words, " * 20_000), (None, "no id")]
    docs = spark.createDataFrame([(*r, 1, "s", 2, "o", "l") for r in rows], SCHEMA).repartition(3)
    found = packing.digests(packing.packed(docs, PATH)).collect()
    padding, by_sequence = check(found, {i: plain_ids(tokenizer, t) for i, t in rows})
    assert padding == 0
    small = [s for s, p in by_sequence.items() if p[0]["tier"] < 256]
    assert len(small) <= 8 * 3  # what is left of three partitions
    cuts = len(found) - len(rows)
    assert cuts <= len(by_sequence) + sum(len(plain_ids(tokenizer, t)) // 2048 for _, t in rows)


def test_repeated_rows_are_documents_of_their_own(spark, tokenizer):
    docs = spark.createDataFrame([(7, "the same row")] * 5 + [(None, None)] * 3, "doc_id bigint, text string")
    found = packing.packed(docs.coalesce(1), PATH).collect()
    assert sum(r["length"] for r in found if r["doc_id"] == 7) == 5 * len(plain_ids(tokenizer, "the same row"))
    assert sum(r["length"] for r in found if r["doc_id"] is None) == 3
    assert packing.packed(docs.limit(0), PATH).collect() == []


def test_sequences_hold_their_pieces_in_order(spark, tokenizer):
    rows = [(i, f"document {i} " * (5 * i)) for i in range(60)]
    pieces = packing.packed(spark.createDataFrame(rows, "doc_id bigint, text string").coalesce(2), PATH).cache()
    expected = collections.defaultdict(bytes)
    for p in sorted(pieces.collect(), key=lambda p: p["offset"]):
        expected[p["sequence_id"]] += bytes(p["ids"])
    found = packing.sequences(pieces).collect()
    assert {r["sequence_id"]: bytes(r["ids"]) for r in found} == expected
    assert all(sum(r["lengths"]) == r["tier"] == len(r["ids"]) // 4 for r in found)
    pieces.unpersist()


def test_gaps_take_whole_rests_first():
    windows, rest = packing.pack([(0, 0, 1500), (1, 0, 300), (2, 0, 248), (3, 0, 200)], packing.TIERS)
    assert windows == [(2048, [(0, 0, 1500), (1, 0, 300), (2, 0, 248)])]
    assert rest == [(3, 0, 200)]
    windows, rest = packing.pack([(0, 0, 5000), (1, 0, 1000)], packing.TIERS)
    assert windows == [(2048, [(0, 0, 2048)]), (2048, [(0, 2048, 2048)]), (1024, [(1, 0, 1000), (0, 4096, 24)])]
    assert rest == [(0, 4120, 880)]
    assert packing.pack([], packing.TIERS) == ([], [])


def test_any_lengths_fill_windows():
    rng = random.Random(4)
    for _ in range(200):
        documents = [(k, 0, rng.choice([1, 2, 17, 255, 256, 257, 1023, 1024, 1025, 2047, 2048, 2049, 5000, rng.randint(1, 4000)]))
                     for k in range(rng.randint(0, 40))]
        windows, rest = packing.pack(documents, packing.TIERS)
        assert sum(length for _, _, length in rest) < 2048
        windows += packing.halved(rest, packing.TIERS)
        seen = collections.defaultdict(list)
        for tier, window in windows:
            assert sum(length for _, _, length in window) == tier
            for number, start, length in window:
                seen[number].append((start, length))
        for number, _, end in documents:
            at = 0
            for start, length in sorted(seen[number]):
                assert start == at and length > 0
                at += length
            assert at == end


def test_steps_of_a_tier_cost_alike():
    rng = random.Random(6)
    windows = []
    for _ in range(1000):
        left, window = 2048, []
        while left:
            window.append((0, 0, rng.randint(1, left)))
            left -= window[-1][2]
        windows.append((2048, window))
    groups = packing.step_groups(windows, 1 << 17)
    tokens, costs = collections.Counter(), collections.Counter()
    for (tier, window), group in zip(windows, groups):
        tokens[group] += tier
        costs[group] += sum(length * length for _, _, length in window)
    assert len(tokens) == 16 and max(tokens.values()) - min(tokens.values()) <= 2048
    assert max(costs.values()) < 1.03 * min(costs.values())


def test_query_packs_the_whole_table(spark, tokenizer, tmp_path):
    rows = [(i, f"text {i}, " * (i % 700)) for i in range(500)]
    spark.createDataFrame(rows, "doc_id bigint, text string").write.parquet(str(tmp_path / "documents.parquet"))
    found = queries.QUERIES["op11_packing"](spark, str(tmp_path)).collect()
    padding, _ = check(found, {i: plain_ids(tokenizer, t) for i, t in rows})
    assert padding == 0
