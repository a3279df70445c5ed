"""Weighted sampling, linking and classes against brute-force versions."""

import collections
import itertools
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from shelfwise.llm import fingerprints, linking, near_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, id int, band int, class_id string, digest string"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, None, 0, 1, 2, "c", "d") for i, t in rows], SCHEMA)


def shingled(text):
    words = re.findall("[a-z0-9\x80-\U0010ffff]+", re.sub("[A-Z]", lambda m: m.group().lower(), text or ""))
    return collections.Counter(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4))) if words else collections.Counter()


def plain_classes(rows, least=0.8):
    """Least id of each id's class: equal texts, and weighted Jaccard similarity of all pairs with exact frequencies."""
    sets = [shingled(t) for _, t in rows]
    frequency = collections.Counter(s for own in sets for s in own)
    idf = {s: 1 + near_dedup.IDF_SHARE * math.log(len(rows) / n) / math.log(max(len(rows), 2)) for s, n in frequency.items()}
    root = {i: i for i, _ in rows if i is not None}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, (i, s)), (b, (j, t)) in itertools.combinations(enumerate(rows), 2):
        if None in (i, j, s, t):
            continue
        both = sum(min(sets[a][x], sets[b][x]) * idf[x] for x in sets[a])
        every = sum(max(sets[a][x], sets[b][x]) * idf[x] for x in set(sets[a]) | set(sets[b]))
        if s == t or (every and both / every >= least):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return {i: find(i) for i in root}


def edited(rng, words, share):
    return [f"n{rng.randint(0, 10**6)}" if rng.random() < share else w for w in words]


def corpus(seed):
    """Groups of copies with few edits, texts that share a passage, and others."""
    rng = random.Random(seed)
    word = lambda: f"w{rng.randint(0, 5_000)}"
    passage = [word() for _ in range(40)]
    rows, ids = [], iter(rng.sample(range(10_000), 400))
    for size in (1, 2, 3, 8, 40):
        base = [word() for _ in range(rng.randint(60, 300))]
        rows += [(next(ids), " ".join(edited(rng, base, rng.choice([0, 0.002, 0.005])))) for _ in range(size)]
    rows += [(next(ids), " ".join([word() for _ in range(80)] + passage)) for _ in range(40)]
    rows += [(next(ids), " ".join(word() for _ in range(rng.randint(1, 8)))) for _ in range(30)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_equal_brute_force(spark, seed):
    rows = corpus(seed)
    found = {r["doc_id"]: r["class_id"] for r in near_dedup.classified(frame(spark, rows)).collect()}
    assert found == plain_classes(rows)


LONG = "a long text of the same words again and again " * 8_000
ODD = [(1, None), (2, None), (3, ""), (4, ""), (5, "!?"), (6, "!?"), (7, "?!"), (8, "one two"), (9, "One, two!"), (10, "one three"),
       (None, "one two"), (None, "one two"), (11, LONG), (12, LONG), (12, LONG), (13, LONG + "and an end"), (14, "ein text über äpfel und birnen")]


def test_odd_rows(spark):
    out = near_dedup.classified(frame(spark, ODD))
    found = collections.defaultdict(set)
    for r in out.collect():
        found[r["doc_id"]].add((r["class_id"], r["kept"]))
    assert out.count() == len(ODD)
    assert {i: c for i, c in plain_classes(ODD).items()} == {i: next(iter(v))[0] for i, v in found.items() if i is not None}
    assert found[None] == {(None, True)}
    assert found[3] == {(3, True)} and found[4] == {(3, False)} and found[9] == {(8, False)}


def test_fingerprint_classes_equal_brute_force(spark):
    rows = corpus(3) + [(i + 50_000, t) for i, t in ODD if i is not None] + [(None, "one two")]
    sets = {i: set(shingled(t)) for i, t in rows if i is not None}
    root = {i: i for i in sets}
    text = {i: t for i, t in rows}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in itertools.combinations(sets, 2):
        near = sets[i] and sets[j] and len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])
        if near or (text[i] is not None and text[i] == text[j]):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    found = {r["id"]: r["class_id"] for r in fingerprints.near_classes(frame(spark, rows)).collect()}
    assert {i: found.get(i, i) for i in sets} == {i: find(i) for i in sets}


def test_one_of_each_keeps_columns(spark):
    df = frame(spark, ODD)
    kept = near_dedup.one_of_each(df)
    assert kept.schema.simpleString() == df.schema.simpleString()
    classes = plain_classes(ODD)
    expected = sorted(((str(i), str(t)) for i, t in ODD if i is None or classes[i] == i))
    assert sorted((str(r["doc_id"]), str(r["text"])) for r in kept.collect()) == expected


def test_nothing_in_nothing_out(spark):
    assert near_dedup.classified(frame(spark, [])).count() == 0
    assert near_dedup.one_of_each(frame(spark, [])).count() == 0


def test_samples_agree_with_the_probability_of_the_similarity():
    rng = np.random.default_rng(3)
    seen, true = [], []
    for _ in range(150):
        hashes = np.sort(rng.integers(1, 2**63, 200).astype(np.uint64))
        weight = rng.uniform(1, 2, 200) * rng.integers(1, 4, 200)
        left, right = (np.sort(rng.choice(200, 170, replace=False)) for _ in range(2))
        a, b = np.zeros(200), np.zeros(200)
        a[left] = weight[left]
        b[right] = weight[right] * rng.choice([1, 1, 2], 170)
        drawn = near_dedup.samples(np.concatenate([hashes[left], hashes[right]]), np.concatenate([a[left], b[right]]), np.array([0, 170]))
        seen.append((drawn[0] == drawn[1]).mean())
        true.append(np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(seen) - np.mean(true)) < 0.02


def test_sketch_counts_documents(spark):
    rows = [(i, f"the same five words here{' and' if i % 2 else ''}") for i in range(40)]
    weigh = near_dedup.weights(frame(spark, rows))
    assert weigh.documents == 40
    import pyarrow as pa

    shared, _ = near_dedup._distinct(pa.array(["the same five words here"]))[0]
    assert abs(weigh.idf(shared)[0] - 1) < 0.01


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_components(spark, seed):
    rng = random.Random(seed)
    links = [(rng.randint(0, 60), rng.randint(0, 60)) for _ in range(35)] + [(100 + k, 101 + k) for k in range(30)] + [(5, 5)]
    root = {x: x for pair in links for x in pair}
    for _ in links:
        for a, b in links:
            root[a] = root[b] = min(root[a], root[b])
    found = {r["id"]: r["root"] for r in linking.components(spark.createDataFrame(links, "a bigint, b bigint")).collect()}
    # Stars list the members only; a root stands for itself.
    assert {i: found.get(i, i) for i in root} == root


def test_links_are_found_beyond_the_pivots(spark):
    """In the band of all, the pivot is like one text only; the others form classes that neighbours find."""
    bands = {1: [7, 10], 2: [7, 20], 3: [7, 20], 4: [7, 21], 5: [7, 30], 6: [7, 30], 7: [7, 31], 8: [7, 10]}
    signed = spark.createDataFrame([(i, b, bytearray(64)) for i, b in bands.items()], "id bigint, bands array<bigint>, samples binary")
    texts = signed.select("id", F.col("id").cast("string").alias("text"))
    near = [(1, 8), (2, 3), (3, 4), (5, 6), (6, 7)]
    links = spark.createDataFrame(near, "x bigint, y bigint")
    verify = lambda sides: sides.join(links, (F.greatest("a", "b") == F.col("y")) & (F.least("a", "b") == F.col("x")), "left_semi")
    found = {r["id"]: r["root"] for r in linking.classes(signed, texts, verify).collect()}
    assert {i: found.get(i, i) for i in bands} == {1: 1, 2: 2, 3: 2, 4: 2, 5: 5, 6: 5, 7: 5, 8: 1}


def test_every_member_of_a_bucket_meets_every_other_class(spark):
    """Between two near texts stand 40 of one class, which are as near in the order of the bands."""
    rng = random.Random(8)
    common = [f"c{i}" for i in range(100)]
    pivot = [f"p{i}" for i in range(100)]
    crowd = [f"d{i}" for i in range(100)]
    alike = [f"e{i}" for i in range(100)]
    rows = [(0, pivot + common)] + [(i, crowd + common + [f"x{rng.random()}"]) for i in range(2, 42)]
    rows += [(1, alike + common), (99, alike + common + ["more"])]
    rows = [(i, " ".join(words)) for i, words in rows]
    bodies = spark.createDataFrame(rows, "id bigint, text string")
    signed = bodies.select("id", F.array(F.lit(7).cast("bigint")).alias("bands"), F.lit(bytearray(64)).alias("samples"))
    weigh = near_dedup.weights(frame(spark, rows))
    expected = plain_classes(rows)
    assert expected[99] == 1 and expected[41] == 2
    verify = near_dedup._verify(weigh, 0.8)
    for features in (near_dedup._features(weigh), None):
        found = {r["id"]: r["root"] for r in linking.classes(signed, bodies, verify, features, 0.8).collect()}
        assert {i: found.get(i, i) for i, _ in rows} == expected


@pytest.mark.parametrize("texts, size", [(4, 8 << 20), (256, 3_000), (1, 1)])
def test_small_cells_give_the_same_classes(spark, monkeypatch, texts, size):
    monkeypatch.setattr(linking, "CELL_TEXTS", texts)
    monkeypatch.setattr(linking, "CELL_BYTES", size)
    monkeypatch.setattr(linking, "COLUMNS", 7)
    rows = corpus(5)
    bodies = spark.createDataFrame(rows, "id bigint, text string")
    signed = bodies.select("id", F.array(F.lit(7).cast("bigint")).alias("bands"), F.lit(bytearray(64)).alias("samples"))
    weigh = near_dedup.weights(frame(spark, rows))
    none = lambda sides: sides.where("false")
    found = {r["id"]: r["root"] for r in linking.classes(signed, bodies, none, near_dedup._features(weigh), 0.8).collect()}
    assert {i: found.get(i, i) for i, _ in rows} == plain_classes(rows)


def test_bucket_members_meet_when_no_member_is_like_its_pivot(spark):
    """No pair is linked before the last step; it runs all the same."""
    rows = [(1, "a"), (2, "b"), (3, "b")]
    signed = spark.createDataFrame([(i, [7], bytearray(64)) for i, _ in rows], "id bigint, bands array<bigint>, samples binary")
    bodies = spark.createDataFrame(rows, "id bigint, text string")
    equal = lambda sides: sides.where("text_a = text_b")
    assert [tuple(r) for r in linking.classes(signed, bodies, equal).collect()] == [(3, 2)]


def test_an_id_with_several_texts_joins_the_classes_of_all(spark):
    rng = random.Random(11)
    first, second, third = (" ".join(f"w{rng.randint(0, 5_000)}" for _ in range(100)) for _ in range(3))
    rows = [(1, first), (5, first), (5, second), (9, second + " end"), (20, third), (21, first + " and"), (21, third)]
    found = {(r["doc_id"], r["class_id"]) for r in near_dedup.classified(frame(spark, rows)).collect()}
    assert found == {(i, 1) for i, _ in rows}


def test_a_pair_of_unlike_samples_is_not_lost(spark):
    signed = spark.createDataFrame([(1, [7], bytearray(64)), (2, [7], bytearray([1] * 64))], "id bigint, bands array<bigint>, samples binary")
    bodies = spark.createDataFrame([(1, "a"), (2, "a")], "id bigint, text string")
    equal = lambda sides: sides.where("text_a = text_b")
    assert [tuple(r) for r in linking.classes(signed, bodies, equal).collect()] == [(2, 1)]
