"""The pipeline's stages, each against brute force on its own input, and as a whole."""

import hashlib
import random

import pytest
import tiktoken
import public_tokenizers

import corpus_pipeline
from shelfwise.llm import bpe, decontaminate, line_dedup
from test_native import in_duckdb
from test_near_dedup import plain_classes

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint"
ITEMS = [(1, "which of these planets is the largest one in the solar system"), (2, None), (3, "name the author of the old book")]


def lines(rng, count):
    return [" ".join(f"w{rng.randint(0, 4_000)}" for _ in range(rng.randint(6, 14))) for _ in range(count)]


def corpus():
    """Clean texts, toxic ones, shared blocks of lines, near copies, benchmark items, and odd rows."""
    rng = random.Random(9)
    rows, labels = [], []
    shared = lines(rng, 12)
    for i in range(160):
        text = lines(rng, rng.randint(2, 12))
        toxic = i % 5 == 0
        if toxic:
            text[0] += " vile"
        elif i % 7 == 0:
            at = rng.randint(0, len(text))
            text[at:at] = shared
        elif i % 11 == 0:
            text.append("So: WHICH of these planets is the largest one, in the solar system?")
        rows.append((i, "\n".join(text)))
        labels.append((i, 1, int(toxic)))
        if i % 13 == 1:
            words = rows[-1][1].replace("\n", " ").split(" ")  # a copy in one line, so that line dedup leaves it
            words[len(words) // 2] = "edited"
            rows.append((1_000 + i, " ".join(words * 3)))
            rows.append((2_000 + i, " ".join(words * 3) + " end"))
    rows += [(3_000, None), (3_001, ""), (3_002, ""), (None, rows[1][1]), (None, None), (3_003, rows[2][1]), (3_003, rows[2][1])]
    rng.shuffle(rows)
    return rows, labels


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("corpus"))
    rows, labels = corpus()
    docs = spark.createDataFrame([(i, t, "en", "s", len(t or "")) for i, t in rows], SCHEMA)
    docs.repartition(3).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id bigint, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame(ITEMS, "item_id bigint, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def texts(df):
    return sorted(((r["doc_id"], r["text"]) for r in df.collect()), key=str)


def test_every_stage_against_its_own_input(spark, folder, tmp_path):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    names = [name for name, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "line_dedup", "near_dedup", "decontamination", "byte_bpe"]
    for name, stage in corpus_pipeline.STAGES:
        before = texts(docs)
        out = stage(spark, docs, folder)
        if name != "byte_bpe":
            assert out.schema.simpleString() == docs.schema.simpleString()
        out.write.parquet(f"{tmp_path}/{name}")
        out = spark.read.parquet(f"{tmp_path}/{name}")
        if name == "toxicity":
            assert texts(out) == [r for r in before if "vile" not in (r[1] or "").split()]
        elif name == "line_dedup":
            sql = f"""WITH {line_dedup.sql_chunks()}
SELECT any_value(doc_id), string_agg(chunk, chr(10) ORDER BY number) FILTER (WHERE NOT gone) FROM chunk_rows GROUP BY r"""
            _, expected = in_duckdb(before, sql)
            assert sorted([(i, t or "") for i, t in texts(out)], key=str) == sorted([(i, t or "") for i, t in expected], key=str)
            assert texts(out) != before and all(r["n_chars"] == len(r["text"] or "") for r in out.collect())
        elif name == "near_dedup":
            classes = plain_classes(before)
            assert texts(out) == [(i, t) for i, t in before if i is None or classes[i] == i]
            assert len(texts(out)) < len(before)
        elif name == "decontamination":
            items = [decontaminate.normal(t) for _, t in ITEMS if t]
            assert texts(out) == [(i, t) for i, t in before if not any(item in decontaminate.normal(t) for item in items)]
            assert len(texts(out)) < len(before)
        else:
            ranks = bpe.Vocabulary.read(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")).ranks
            plain = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
            expected = []
            for i, t in before:
                ids = plain.encode_ordinary(t or "")
                digest = hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
                expected.append((i, len(ids), digest, hashlib.sha256((t or "").encode()).hexdigest()))
            assert sorted((tuple(r) for r in out.collect()), key=str) == sorted(expected, key=str)
        docs = out


def test_run_is_its_stages_one_after_another(spark, folder):
    rows = corpus_pipeline.run(spark, folder).collect()
    assert len(rows) == len({(r["doc_id"], r["ids_sha256"]) for r in rows}) or any(r["doc_id"] is None for r in rows)
    again = corpus_pipeline.run(spark, folder).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))


def test_nothing_in_nothing_out(spark, folder, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, folder).count() == 0
