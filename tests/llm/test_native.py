"""Licence scan, line dedup and their SQL, on hand-made tables."""

import random

import duckdb
import pytest

from shelfwise.llm import licenses, line_dedup

SCHEMA = "doc_id bigint, text string, lang string, source string, n_chars bigint, chunks int, kept string, gone_id int"


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", len(t or ""), 1, "x", 2) for i, t in rows], SCHEMA)


def in_duckdb(rows, sql):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    if rows:
        con.executemany("INSERT INTO documents VALUES (?, ?)", [list(r) for r in rows])
    relation = con.sql(sql)
    return relation.columns, sorted(relation.fetchall(), key=str)


def same(spark, df, rows, sql):
    columns, expected = in_duckdb(rows, sql)
    assert df.columns == list(columns)
    assert sorted((tuple(r) for r in df.collect()), key=str) == expected


def passages(seed, count):
    rng = random.Random(seed)
    lines = [" ".join(rng.choice(["ab", "cd", "e", "", "Ü", "x1"]) for _ in range(rng.randint(0, 9))) for _ in range(30)]
    return [(rng.randint(1, count), "\n".join(rng.choice(lines) for _ in range(rng.randint(0, 25)))) for _ in range(count)]


EDGES = [(None, "a\nb\nc\nd\ne\nf"), (None, None), (1, None), (2, ""), (3, "a\nb\nc\nd\ne\nf"), (3, "a\nb\nc\nd\ne\nf"),
         (4, "a\nb\nc\nd\ne\nf"), (5, "\n\n\n\n\n\n"), (6, "x\n\n\n\n\n\n"), (7, "\x01a\n\x01b\n\x01\nq\nr\ns\n\x01b"),
         (8, "\x01a\n\x01b\n\x01\nq\nr\ns\n\x01b"), (9, "long line " * 50_000 + "\n" + "y\n" * 2_000), (10, "y\n" * 2_000)]


@pytest.mark.parametrize("rows", [[], EDGES, passages(1, 60), passages(2, 60)])
def test_line_dedup_equals_its_sql(spark, rows):
    same(spark, line_dedup.report(frame(spark, rows)), rows, line_dedup.sql())


def test_chunks_join_to_the_text(spark):
    rows = [(i, t) for i, t in EDGES + passages(3, 40) if t is not None]
    df = frame(spark, rows)
    for text, chunks in df.select("text", line_dedup.chunks_of(df["text"]).alias("c")).collect():
        assert "\n".join(chunks) == text


def test_a_chunk_is_found_wherever_it_moves(spark):
    shared = [f"shared line number {i}" for i in range(40)]
    rows = [(1, "\n".join(shared)), (2, "\n".join(["one more", "and another", *shared, "the end"]))]
    kept = {r["doc_id"]: r["text"] for r in line_dedup.deduplicated(frame(spark, rows)).collect()}
    assert kept[1] == rows[0][1]
    assert "one more" in kept[2] and "the end" in kept[2] and len(kept[2]) < len(rows[1][1]) / 2


def test_deduplicated_keeps_columns_and_counts(spark):
    df = frame(spark, EDGES)
    out = line_dedup.deduplicated(df)
    assert out.schema.simpleString() == df.schema.simpleString()
    rows = out.collect()
    assert len(rows) == len(EDGES)
    for r in rows:
        assert r["n_chars"] == len(r["text"] or "") and r["chunks"] == 1 and r["kept"] == "x" and r["gone_id"] == 2
    assert {r["text"] for r in rows if r["doc_id"] is None} == {"a\nb\nc\nd\ne\nf", None}


def test_no_python_in_the_native_plans(spark):
    df = frame(spark, EDGES)
    for out in (line_dedup.report(df), line_dedup.deduplicated(df), licenses.found(df)):
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


MIT = next(text for licence, text in licenses.TEMPLATES if licence == "MIT" and len(text) > 200)
NOTICES = [
    (1, "some words here\nReleased under the MIT License.\nmore words"), (2, "Licensed under CC BY-NC 4.0."),
    (3, "licensed UNDER the apache license; version 2.0!"), (4, "Released under the\nMIT License"), (5, None), (6, ""),
    (None, "Licensed under CC BY 4.0"), (None, "Licensed under CC BY 4.0"), (7, MIT), (8, MIT.replace(". ", ".\n").replace(", ", ",\n")),
    (9, "the the the the the the"), (10, "license"), (11, "Released under the MIT License\nReleased under the MIT License"),
    (12, "word " * 200_000 + "\nThis work is licensed under the GNU General Public License, version 3."),
]


@pytest.mark.parametrize("rows", [[], NOTICES])
def test_licence_scan_equals_its_sql(spark, rows):
    same(spark, licenses.found(frame(spark, rows)), rows, licenses.sql())


def test_licences_found(spark):
    found = {(r["doc_id"], r["licence"]): r for r in licenses.found(frame(spark, NOTICES)).collect()}
    assert found[1, "MIT"]["dice"] == 1.0 and found[3, "Apache-2.0"]["dice"] == 1.0
    assert found[4, "MIT"]["n_units"] == 1 and found[7, "MIT"]["dice"] == 1.0 and found[8, "MIT"]["dice"] == 1.0
    assert found[None, "CC-BY-4.0"]["n_units"] == 2 and found[11, "MIT"]["n_units"] == 2
    assert found[2, "CC-BY-NC-4.0"]["dice"] == 1.0 and found[12, "GPL-3.0"]["dice"] == 1.0
    assert {doc for doc, _ in found}.isdisjoint({5, 6, 9, 10})
