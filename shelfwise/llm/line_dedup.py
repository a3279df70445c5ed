"""Line dedup: content-defined chunks of lines, repeated ones removed, in DataFrame functions only.

Every line has a hash.  A rolling hash over the hashes of the two lines before a line decides whether a chunk begins there
(one place in ``DIVISOR`` on average), so the borders depend on the content alone and move along with it when lines are
added or removed elsewhere.  A chunk of two lines or more that stands in several places is kept at the first, by document
id and then by place in the document, and removed at all others.

Byte comparison: chunks are grouped by their digest and their text together, with partial aggregation, so that two places
count as equal only if their bytes are; the digest then stands for that text when the places are looked up.  Should two
texts ever share a digest, neither is removed.

A hot chunk is one row per task in the grouping, and its places are matched by a join that adaptive execution can split.
Texts are shuffled twice, once as chunks and once to take the removed ones out.

Null and empty texts have no chunk of two lines and stay.  A document of null id stays whole and removes nothing.  Rows of
equal id are judged alike and never against each other.  Further columns pass through unread.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import free_name

DIVISOR = 4
# Fixed values of the rolling hash.
BASE = 31
MODULUS = 1_000_003
# Chunks are told apart inside one string by this mark; the escape keeps it out of texts.
_ESCAPE, _ESCAPED, _MARK = "\x01", "\x01a", "\x01b"


def chunks_of(text: Column) -> Column:
    """The text's chunks in order; joined by a line feed they are the text."""
    lines = F.split(F.replace(text, F.lit(_ESCAPE), F.lit(_ESCAPED)), "\n")
    hashes = F.transform(
        F.split(text, "\n"), lambda line: F.conv(F.substring(F.md5(line.cast("binary")), 1, 8), 16, 10).cast("bigint") % MODULUS
    )
    none = F.lit(None).cast("bigint")
    begins = F.zip_with(
        F.concat(F.array(none), hashes), F.concat(F.array(none, none), hashes),
        lambda before, earlier: (F.coalesce(earlier, F.lit(0)) * BASE + before) % MODULUS % DIVISOR == 0,
    )
    marked = F.zip_with(lines, begins, lambda line, begin: F.when(begin, F.concat(F.lit(_MARK), line)).otherwise(line))
    parts = F.split(F.array_join(marked, "\n"), "\n" + _MARK)
    return F.transform(parts, lambda part: F.replace(part, F.lit(_ESCAPED), F.lit(_ESCAPE)))


def _version(text: Column) -> Column:
    """Tells the texts of rows with equal ids apart."""
    return F.xxhash64(text)


def _places(docs: DataFrame) -> DataFrame:
    """Chunks of two lines or more: document, number, text, digest, and the place as one number in order."""
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))
    rows = rows.where("doc_id IS NOT NULL AND text IS NOT NULL").where(F.instr("text", "\n") > 0)
    rows = rows.select(
        "doc_id", _version(F.col("text")).alias("version"), F.posexplode(chunks_of(F.col("text"))).alias("number", "chunk")
    ).where(F.instr("chunk", "\n") > 0)
    place = F.col("doc_id").cast("decimal(20,0)") * F.lit(2**31).cast("decimal(11,0)") + F.col("number")
    return rows.select("doc_id", "version", "number", "chunk", F.sha2("chunk", 256).alias("digest"), place.cast("decimal(38,0)").alias("place"))


def removed(docs: DataFrame) -> DataFrame:
    """Numbers of the chunks to take out of each document, as (``doc_id``, ``version`` of its text, ``numbers``)."""
    places = _places(docs)
    repeated = (
        places.groupBy("digest", "chunk").agg(F.min("place").alias("first"), F.max("place").alias("last"))
        .groupBy("digest").agg(F.min("first").alias("first"), F.max("last").alias("last"), F.count("*").alias("texts"))
        .where("first < last AND texts = 1")
    )
    later = places.select("doc_id", "version", "number", "digest", "place").join(repeated.select("digest", "first"), "digest")
    return later.where("place > first").groupBy("doc_id", "version").agg(F.collect_set("number").alias("numbers"))


def _cut(docs: DataFrame, chunks: str, kept: str) -> DataFrame:
    """``docs`` with two more columns: all chunks and the numbers of those that stay, null where all do."""
    gone_id, version, numbers = (free_name(docs, n) for n in ("gone_id", "gone_version", "gone_numbers"))
    gone = removed(docs).select(F.col("doc_id").alias(gone_id), F.col("version").alias(version), F.col("numbers").alias(numbers))
    # Rows without an id need no partner and would all meet in one task.
    own = (F.col("doc_id").cast("bigint") == F.col(gone_id)) & (_version(F.col("text").cast("string")) == F.col(version))
    known = docs.where("doc_id IS NOT NULL").join(gone, own, "left").drop(gone_id, version)
    unknown = docs.where("doc_id IS NULL").withColumn(numbers, F.lit(None).cast("array<int>"))
    rows = known.unionByName(unknown)
    # explode(array(..)) gives a column of its own, which later functions read instead of computing it again.
    some = F.col(numbers).isNotNull()
    rows = rows.withColumn(chunks, F.explode(F.array(F.when(some, chunks_of(F.col("text").cast("string"))))))
    every = F.sequence(F.lit(0), F.size(chunks) - 1)
    return rows.withColumn(kept, F.when(some, F.array_except(every, numbers))).drop(numbers)


def _kept_text(chunks: str, kept: str) -> Column:
    left = F.array_join(F.transform(kept, lambda number: F.get(F.col(chunks), number)), "\n")
    return F.when(F.col(kept).isNull(), F.col("text").cast("string")).otherwise(left)


def deduplicated(docs: DataFrame) -> DataFrame:
    """The documents with repeated chunks taken out of ``text``; ``n_chars``, if there, follows."""
    chunks, kept = free_name(docs, "chunks"), free_name(docs, "kept")
    rows = _cut(docs, chunks, kept).withColumn("text", _kept_text(chunks, kept))
    if "n_chars" in docs.columns:
        changed = F.when(F.col(kept).isNull(), F.col("n_chars")).otherwise(F.length("text"))
        rows = rows.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return rows.select(docs.columns)


def _line_count(text: Column) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1


def report(docs: DataFrame) -> DataFrame:
    """Per document the number of lines, of removed lines, and the digest of the text that is left (null text: empty)."""
    rows = _cut(docs.select("doc_id", "text"), "chunks", "kept")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = rows.select(
        F.col("doc_id").cast("bigint").alias("doc_id"), _line_count(text).cast("bigint").alias("n_lines"),
        F.coalesce(_kept_text("chunks", "kept"), F.lit("")).alias("left"), F.size("kept").alias("chunks_left"),
    )
    lines_left = F.when(F.col("chunks_left") == 0, F.lit(0)).otherwise(_line_count(F.col("left")))
    return rows.select(
        "doc_id", "n_lines", (F.col("n_lines") - lines_left).cast("bigint").alias("n_removed"),
        F.sha2("left", 256).alias("kept_sha256"),
    )


def sql_chunks(documents: str = "documents") -> str:
    """CTEs in DuckDB's SQL: ``chunk_rows`` (r, doc_id, number, chunk, n, gone) for every row of the table."""
    return f"""
source AS (SELECT row_number() OVER () AS r, * FROM {documents}),
line_rows AS (
  SELECT r, doc_id, unnest(parts) AS line, generate_subscripts(parts, 1) AS i
  FROM (SELECT r, doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM source)),
hashed AS (SELECT *, CAST('0x' || substr(md5(line), 1, 8) AS BIGINT) % {MODULUS} AS h FROM line_rows),
begun AS (
  SELECT *, CASE WHEN i > 1 AND (coalesce(lag(h, 2) OVER w, 0) * {BASE} + lag(h, 1) OVER w) % {MODULUS} % {DIVISOR} = 0
            THEN 1 ELSE 0 END AS begins
  FROM hashed WINDOW w AS (PARTITION BY r ORDER BY i)),
numbered AS (SELECT *, sum(begins) OVER (PARTITION BY r ORDER BY i) AS number FROM begun),
chunked AS (
  SELECT r, any_value(doc_id) AS doc_id, number, string_agg(line, chr(10) ORDER BY i) AS chunk, count(*) AS n
  FROM numbered GROUP BY r, number),
placed AS (SELECT *, CAST(doc_id AS HUGEINT) * 2147483648 + CAST(number AS HUGEINT) AS place FROM chunked),
chunk_rows AS (
  SELECT r, doc_id, number, chunk, n,
         n > 1 AND doc_id IS NOT NULL AND place > min(place) OVER (PARTITION BY chunk) AS gone
  FROM placed)"""


def sql() -> str:
    return f"""
WITH {sql_chunks()}
SELECT any_value(doc_id) AS doc_id, CAST(sum(n) AS BIGINT) AS n_lines,
       CAST(coalesce(sum(n) FILTER (WHERE gone), 0) AS BIGINT) AS n_removed,
       sha256(coalesce(string_agg(chunk, chr(10) ORDER BY number) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM chunk_rows GROUP BY r"""
