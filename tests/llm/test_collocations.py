"""Collocations against plain counting."""

import collections
import random
import re

import numpy as np
import pytest

from shelfwise.llm import collocations

SCHEMA = "doc_id bigint, text string, lang string, n bigint, word string, key string, depth string, phrase string"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plainly(rows, least, top):
    counts, totals = collections.Counter(), collections.Counter()
    for _, text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            words = re.findall(r"[^\x20\x09]+", piece)
            totals[lang] += len(words)
            for m in range(1, 6):
                counts.update((lang, *words[i : i + m]) for i in range(len(words) - m + 1))
    candidates = {p: a for p, a in counts.items() if a >= least and len(p) > 2}
    dropped = set()
    for (lang, *words), f in candidates.items():
        for m in range(2, len(words)):
            for i in range(len(words) - m + 1):
                inner = (lang, *words[i : i + m])
                if 100 * f >= 100 * candidates[inner]:
                    dropped.add(inner)
    by_lang = collections.defaultdict(list)
    for p, a in candidates.items():
        if p in dropped:
            continue
        lang, words = p[0], p[1:]
        score, k, l, r = min(
            (1000 * a * totals[lang] // (counts[lang, *words[:k]] * counts[lang, *words[k:]]), k, counts[lang, *words[:k]], counts[lang, *words[k:]])
            for k in range(1, len(words)))
        by_lang[lang].append((-score, -a, " ".join(words).encode(), l, r))
    found = []
    for lang, some in by_lang.items():
        for rank, (score, a, phrase, l, r) in enumerate(sorted(some)[:top], 1):
            found.append((lang, rank, phrase.decode(), -a, l, r, totals[lang], -score))
    return sorted(found)


def frame(spark, rows, parts=3):
    return spark.createDataFrame([(*r, 1, "w", "k", "d", "p") for r in rows], SCHEMA).repartition(parts)


def texts(rng, n, vocabulary, longest=60):
    return [(i, "".join(w + rng.choice([" "] * 12 + ["  ", "\t", ", ", ". ", "\n", "\r\n", "!?", ":"])
                        for w in rng.choices(vocabulary, k=rng.randint(0, longest))), rng.choice(["en", "de", None, "und", ""]))
            for i in range(n)]


@pytest.mark.parametrize("seed", [1, 2])
def test_rows_equal_plain_counting(spark, seed):
    rng = random.Random(seed)
    vocabulary = ["the", "The", "of", "é", "É", "日本", "x\x1cy", "\xa0", "a", "b" * 70, "-", "\x00", "to"] + [f"w{i}" for i in range(30)]
    rows = texts(rng, 300, vocabulary)
    rows += [(None, None, None), (1, "", "en"), (2, " \n ", "fr"), (3, "the of " * 3_000, "en"), (4, "one fixed phrase here now", "en")]
    rows += [(4, "one fixed phrase here now", "en")] * 20
    found = sorted(map(tuple, collocations.collocations(frame(spark, rows), least=4, top=40).collect()))
    expected = plainly(rows, 4, 40)
    assert found == expected and len({r[0] for r in found}) >= 3


def test_hot_leading_words_are_divided(spark, monkeypatch):
    """With shares that make most leading words hot, suffixes are routed by up to five words, and counts stay the same."""
    rng = random.Random(7)
    rows = texts(rng, 200, ["a", "b", "c", "a", "a"], 80) + [(0, "a " * 5_000, "en")]
    expected = plainly(rows, 3, 100)
    depths = []
    original = collocations.merged_suffixes
    monkeypatch.setattr(collocations, "HOT_SHARE", 0.001)
    block = None
    assert sorted(map(tuple, collocations.collocations(frame(spark, rows, 5), least=3, top=100).collect())) == expected
    # The same routing on one block, seen directly.
    import pyarrow as pa

    batch = pa.RecordBatch.from_pydict({"lang": ["en"], "text": ["a b a b a b c"]})
    block = collocations.Block(batch, {})
    every = collocations.Bitmap(np.full(1 << 10, -1, np.int64).view(np.uint64), 16)
    hot = {d: np.unique(block.leading(np.arange(2), d)) for d in (2, 3, 4)}
    found = original(block, every, hot)
    depths = sorted(found.column("depth").to_pylist())
    assert depths == [2, 2, 5, 5, 5, 5] or depths[-1] == 5
    assert sum(found.column("n").to_pylist()) == 6


def test_quicksort_counts_every_prefix(monkeypatch):
    rng = np.random.default_rng(0)
    rows = rng.integers(1, 6, (4_000, 5)).astype(np.uint64)
    rows[rng.random(4_000) < 0.2, 3:] = 0
    weights = rng.integers(1, 4, 4_000)
    expected = collections.Counter()
    for row, n in zip(rows.tolist(), weights.tolist()):
        for m in range(2, 6):
            if 0 not in row[:m]:
                expected[tuple(row[:m])] += n
    for least, complete, small in ((1, 2, 16), (40, 2, 16), (40, 4, 1), (40, 4, 10_000), (40, 3, 200)):
        monkeypatch.setattr(collocations, "SMALL", small)
        found = {tuple(rows[p, :m].tolist()): n for p, m, n in collocations.frequent_prefixes(list(rows.T), weights, least, complete)}
        assert found == {p: n for p, n in expected.items() if n >= least or len(p) < complete}


def test_words_that_share_a_symbol_stay_apart(spark, monkeypatch):
    """Symbols of a few bits: many words share one, and the counts are still those of the words."""
    monkeypatch.setattr(collocations, "mixed", lambda h: (h ^ (h >> np.uint64(33))) & np.uint64(0x3F))
    rng = random.Random(3)
    rows = texts(rng, 40, [f"w{i}" for i in range(90)] + ["eightlet", "eightlets", "long" * 9 + "a", "long" * 9 + "b", "x" * 5_000], 200)
    import pyarrow as pa

    plain = collections.Counter()
    for _, text, lang in rows:
        plain.update((lang or "und", w) for p in re.split(r"[.,;:!?\x0A-\x0D]", text) for w in re.findall(r"[^\x20\x09]+", p)
                     if lang is not None)
    batch = pa.RecordBatch.from_pydict({"lang": [r[2] or "und" for r in rows if r[2] is not None],
                                        "text": [r[1] for r in rows if r[2] is not None]})
    block = collocations.Block(batch, {})
    counted = collections.Counter()
    for _, lang, word, n in zip(*collocations.counted_words(block)):
        counted[lang, word] += n
    assert counted == plain
    found = np.unique(block.symbols)
    # Own symbols for words that share one.
    twins = {}
    for symbol in found.tolist():
        some = {(lang, word) for lang, word in ((block.langs[block.text_of[k]], block.word(k)) for k in np.flatnonzero(block.symbols == np.uint64(symbol)).tolist())}
        if len(some) > 1:
            signed = int(np.array([symbol], np.uint64).view(np.int64)[0])
            twins[signed] = {w: 1_000_000 + 1000 * symbol + j for j, w in enumerate(sorted(some))}
    again = collocations.Block(batch, twins)
    seen = collections.defaultdict(set)
    for k in range(len(again.symbols)):
        seen[int(again.symbols[k])].add((again.langs[again.text_of[k]], again.word(k)))
    assert all(len(some) == 1 for some in seen.values()) and twins


def test_bitmap_holds_all_that_was_put_in(spark):
    rng = np.random.default_rng(1)
    keys = rng.integers(-(2**63), 2**63 - 1, 5_000)
    df = spark.createDataFrame([(int(k),) for k in keys], "key bigint")
    bitmap = collocations.bitmap_of(df, "key", len(keys))
    assert bitmap.holds(keys.view(np.uint64)).all()
    others = rng.integers(0, 2**63 - 1, 20_000).view(np.uint64)
    assert bitmap.holds(others).mean() < 0.15
    assert not collocations.bitmap_of(df.limit(0), "key", 0).holds(others).any()


def test_empty_tables(spark):
    assert collocations.collocations(frame(spark, []).limit(0)).collect() == []
    assert collocations.collocations(frame(spark, [(1, None, None), (2, "", "en"), (3, "a few words", "en")])).collect() == []
