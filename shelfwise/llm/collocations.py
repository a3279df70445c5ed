"""Phrase collocations by multikey three-way quicksort of suffix pointers.

Texts are lower-cased (A-Z), split into pieces at marks and line ends, and pieces into words.  A word is a 64-bit symbol,
made of the word and its language, so one sort serves all languages.  Every word starts a suffix of at most five symbols
that ends with its piece.

1. One scan counts words and neighbouring pairs, each block of text on its own before the shuffle.  Words that share a symbol
   by chance get symbols of their own, so symbols stand for words exactly.
2. A second scan cuts each suffix before its first infrequent pair, found in a bitmap of bounded size that never misses a
   frequent pair, merges equal suffixes of a block, and routes them by their leading words: by two, or by three to five
   where the leading words are so frequent that they would fill a task.
3. Each task sorts pointers to its suffixes by multikey quicksort: three ways by the symbol at one depth, equal parts one
   deeper, down to five.  The size of an equal part is the count of a phrase.  Parts below the least count are abandoned,
   unless other tasks hold more of the same leading words; such partial counts are added up at the end.
4. Phrases are cut at every place and joined with the counts of both parts; a phrase that always stands inside a longer one
   goes; the best of each language are taken in parts before they meet.

All counts are exact, and all arithmetic is on whole numbers of up to 38 digits.  Nulls are empty texts, a null language is
``und``; ids are not read, so repeated rows count as often as they stand there.  Ties of the score go by count and then by
phrase.  Further columns of the input are not read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from shelfwise.llm.frames import chunks, in_arrow, partitions, stored, table
from shelfwise.llm.words import U64, mixed, scan_words, text_buffers

#: Words of the longest phrase.
LONGEST = 5
LEAST = 100
TOP = 2_000
UNKNOWN = "und"
#: Bytes of text whose words and pairs are counted together, and whose suffixes are merged together.
COUNTED_BYTES, MERGED_BYTES = 1 << 22, 1 << 21
#: Powers of two: bits of the bitmap of frequent pairs, at most 32 MB; beyond it more infrequent pairs pass and are counted.
BITMAP = (16, 28)
BITS_A_PAIR = 16
#: Leading words are frequent that hold more than this part of a task's share of all words.
HOT_SHARE = 1 / 8
#: Parts of at most this many suffixes are sorted at once instead of three ways.
SMALL = 1 << 14

_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[[ord(c) for c in ".,;:!?\n\x0b\x0c\r"]] = 10  # where pieces end
_FACTORS = np.random.default_rng(5).integers(1, 2**64, LONGEST, dtype=U64) | U64(1)

_COUNTS = pa.schema([("depth", pa.int32()), ("key", pa.int64()), ("word", pa.string()), ("n", pa.int64())])
_SYMBOLS = [f"w{k}" for k in range(1, LONGEST + 1)]
_SUFFIXES = pa.schema([*((name, pa.int64()) for name in _SYMBOLS), ("depth", pa.int32()), ("n", pa.int64())])
_PHRASES = pa.schema([*((name, pa.int64()) for name in _SYMBOLS), ("n", pa.int64())])


def _ddl(schema: pa.Schema) -> str:
    kinds = {pa.int32(): "int", pa.int64(): "bigint", pa.string(): "string"}
    return ", ".join(f"{f.name} {kinds[f.type]}" for f in schema)


def _digest(*parts: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(b"\0".join(parts), digest_size=8).digest(), "little")


class Block:
    """The words of some texts: symbols, and whether the next word stands in the same piece."""

    def __init__(self, batch: pa.RecordBatch, twins: dict[int, dict[tuple[str, bytes], int]]):
        data, offsets = text_buffers(batch.column("text"))
        self.data = _FOLD[data]
        hashes, self.first, self.end, starts = scan_words(self.data, offsets, folded=False)
        self.langs = batch.column("lang").to_pylist()
        salts = {lang: U64(_digest(lang.encode())) for lang in set(self.langs)}
        self.text_of = np.repeat(np.arange(len(self.langs)), np.diff(starts))
        self.salts = np.array([salts[lang] for lang in self.langs], dtype=U64)
        symbols = mixed(hashes ^ self.salts[self.text_of])
        symbols[symbols == 0] = 1  # 0 ends a suffix
        if twins:
            for at in np.flatnonzero(np.isin(symbols, np.array(list(twins), dtype=np.int64).view(U64))).tolist():
                own = twins[int(symbols[at : at + 1].view(np.int64)[0])]
                symbols[at] = np.array([own[self.langs[self.text_of[at]], self.word(at)]], np.int64).view(U64)[0]
        self.symbols = symbols
        borders = np.cumsum(self.data == 10, dtype=np.int32)
        self.follows = np.zeros(len(symbols), dtype=bool)
        self.follows[:-1] = (borders[self.first[1:]] == borders[self.end[:-1] - 1]) & (self.text_of[1:] == self.text_of[:-1])

    def word(self, at: int) -> bytes:
        return self.data[self.first[at] : self.end[at]].tobytes()

    def leading(self, at: np.ndarray, depth: int) -> np.ndarray:
        """Hash of the first symbols of the suffixes at some places, all within their piece."""
        total = self.symbols[at] * _FACTORS[0]
        for k in range(1, depth):
            total += self.symbols[at + k] * _FACTORS[k]
        return mixed(total)


def _blocks(batches: Iterator[pa.RecordBatch], most_bytes: int, twins: dict) -> Iterator[Block]:
    for whole in batches:
        for batch in chunks(whole, most_bytes):
            yield Block(batch, twins)


def _source(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang"),
                       F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))


def _signed(values: np.ndarray) -> np.ndarray:
    return values.view(np.int64)


def counted(docs: DataFrame, tasks: int) -> DataFrame:
    """Counts by ``depth``: words (1) with language and text, hashes of pairs (2), of three and of four leading words.

    The last two only where they hold a good part of a block, enough to find those that hold a good part of all.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, COUNTED_BYTES, {}):
            if not len(block.symbols):
                continue
            symbols, langs, words, n = counted_words(block)
            yield table(_COUNTS, np.ones(len(n), np.int32), symbols, [f"{lang}\0{word}" for lang, word in zip(langs, words)], n)
            places = np.flatnonzero(block.follows)
            least = max(2, int(len(block.symbols) * HOT_SHARE / tasks))
            for depth in range(2, LONGEST):
                keys = block.leading(places, depth)
                found, n = np.unique(keys, return_counts=True)
                hot = n >= least
                if depth > 2:
                    found, n = found[hot], n[hot]
                yield table(_COUNTS, np.full(len(n), depth, np.int32), _signed(found), pa.nulls(len(n), pa.string()), n)
                places = places[np.isin(keys, found[n >= least])]
                places = places[block.follows[places + depth - 1]]
                if not len(places):
                    break

    counts = in_arrow(_source(docs), run, _ddl(_COUNTS))
    return counts.groupBy("depth", "key", "word").agg(F.sum("n").alias("n"))


def counted_words(block: Block) -> tuple[list[int], list[str], list[str], list[int]]:
    """Symbols, languages, words and counts of a block; words that share a symbol are told apart by comparing them."""
    order = np.argsort(block.symbols)
    symbols = block.symbols[order]
    begin = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    counts = np.diff(np.append(begin, len(order)))
    several = np.unique(np.searchsorted(begin, unlike_neighbours(block, order, symbols), side="right") - 1)
    alone = np.setdiff1d(np.arange(len(begin)), several, assume_unique=True)
    firsts, raw = order[begin[alone]], block.data.tobytes()
    langs = [block.langs[k] for k in block.text_of[firsts].tolist()]
    words = [raw[low:high].decode() for low, high in zip(block.first[firsts].tolist(), block.end[firsts].tolist())]
    found = (_signed(symbols[begin[alone]]).tolist(), langs, words, counts[alone].tolist())
    for group in several.tolist():
        told: dict[tuple[str, bytes], int] = {}
        for k in order[begin[group] : begin[group] + counts[group]].tolist():
            own = (block.langs[block.text_of[k]], block.word(k))
            told[own] = told.get(own, 0) + 1
        for (lang, word), n in told.items():
            for column, value in zip(found, (int(_signed(symbols[begin[group :][:1]])[0]), lang, word.decode(), n)):
                column.append(value)
    return found


def unlike_neighbours(block: Block, order: np.ndarray, symbols: np.ndarray) -> np.ndarray:
    """Places in ``order`` whose word is not that of the place before, though the symbols are the same.

    Lengths and languages are compared first, then the bytes, eight at a time.
    """
    here = np.flatnonzero(symbols[1:] == symbols[:-1]) + 1
    mine, other = order[here], order[here - 1]
    length = (block.end - block.first).astype(np.int64)
    in_order, lang_in_order = length[order], block.salts[block.text_of[order]]
    unlike = (in_order[here] != in_order[here - 1]) | (lang_in_order[here] != lang_in_order[here - 1])
    found, left = [here[unlike]], ~unlike
    here, mine, other = here[left], mine[left], other[left]
    eights = np.ndarray((len(block.data),), "<u8", np.append(block.data, np.zeros(8, np.uint8)), strides=(1,))
    low_bytes = np.array([(1 << (8 * k)) - 1 for k in range(9)], dtype=U64)
    at = 0
    while len(here):
        inside = low_bytes[np.minimum(length[mine] - at, 8)]
        unlike = ((eights[block.first[mine] + at] ^ eights[block.first[other] + at]) & inside) != 0
        found.append(here[unlike])
        at += 8
        left = ~unlike & (length[mine] > at)
        here, mine, other = here[left], mine[left], other[left]
    return np.concatenate(found)


class Bitmap:
    """A set of hashed keys of bounded size: it may hold more than was put in, never less."""

    def __init__(self, slots: np.ndarray, bits: int):
        self.slots, self.mask = slots, U64((1 << bits) - 1)

    def __contains__(self, key: int) -> bool:
        return bool(self.holds(np.array([key], dtype=U64))[0])

    def holds(self, keys: np.ndarray) -> np.ndarray:
        at = keys & self.mask
        return (self.slots[(at >> U64(6)).astype(np.int64)] >> (at & U64(63))) & U64(1) != 0


def bitmap_of(keys: DataFrame, column: str, count: int) -> Bitmap:
    """The bitmap of a column of hashes, put together by Spark; the driver gets its words, at most 2**22."""
    bits = min(max(int(count * BITS_A_PAIR).bit_length(), BITMAP[0]), BITMAP[1])
    at = F.col(column).bitwiseAND(F.lit((1 << bits) - 1))
    words = (
        keys.select(F.shiftright(at, 6).alias("slot"),
                    F.expr(f"shiftleft(1L, cast({column} & 63L as int))").alias("bit"))
        .groupBy("slot").agg(F.bit_or("bit").alias("word")).toArrow()
    )
    slots = np.zeros(1 << (bits - 6), dtype=np.int64)
    slots[words.column("slot").to_numpy()] = words.column("word").to_numpy()
    return Bitmap(slots.view(U64), bits)


def _twins(words: DataFrame) -> dict[int, dict[tuple[str, bytes], int]]:
    """Own symbols for words that share one by chance; a few in a thousand million words."""
    shared = words.groupBy("key").agg(F.count("*").alias("words")).where("words > 1").select("key")
    found: dict[int, dict[tuple[str, bytes], int]] = {}
    for row in words.join(shared, "key", "left_semi").select("key", "lang", "word").toLocalIterator():
        own = _digest(row["lang"].encode(), row["word"].encode(), b"own symbol") or 1
        found.setdefault(row["key"], {})[row["lang"], row["word"].encode()] = int(np.array([own], U64).view(np.int64)[0])
    return found


def merged_suffixes(block: Block, pairs: Bitmap, hot: dict[int, np.ndarray]) -> pa.RecordBatch:
    """Suffixes of frequent pairs, equal ones once with their number, and by how many leading words they are routed."""
    keys = block.leading(np.flatnonzero(block.follows), 2)
    joins = np.zeros(len(block.symbols) + LONGEST, dtype=bool)
    places = np.flatnonzero(block.follows)
    joins[places] = pairs.holds(keys)
    at = np.flatnonzero(joins)
    columns, going = [block.symbols[at]], np.ones(len(at), dtype=bool)
    padded = np.append(block.symbols, np.zeros(LONGEST, U64))
    for k in range(1, LONGEST):
        going = going & joins[at + k - 1]
        columns.append(np.where(going, padded[at + k], U64(0)))
    total = columns[0] * _FACTORS[0]
    for k in range(1, LONGEST):
        total += columns[k] * _FACTORS[k]
    order = np.argsort(mixed(total), kind="stable")
    columns = [c[order] for c in columns]
    new = np.ones(len(at), dtype=bool)
    if len(at):
        new[1:] = np.logical_or.reduce([c[1:] != c[:-1] for c in columns])
    begin = np.flatnonzero(new)
    n = np.diff(np.append(begin, len(at)))
    columns = [c[begin] for c in columns]
    depth = np.full(len(begin), 2, dtype=np.int32)
    leading = columns[0] * _FACTORS[0]
    for k in range(1, LONGEST - 1):
        leading = leading + columns[k] * _FACTORS[k]
        deeper = (depth == k + 1) & np.isin(mixed(leading), hot[k + 1])
        depth[deeper] = k + 2
    return table(_SUFFIXES, *map(_signed, columns), depth, n)


def frequent_prefixes(columns: list[np.ndarray], weights: np.ndarray, least: int, complete: int) -> Iterator[tuple[int, int, int]]:
    """Multikey three-way quicksort of pointers to suffixes: ``(a suffix, words, count)`` of every frequent phrase.

    All suffixes that share ``complete`` leading words are here, so from that depth on parts below ``least`` are abandoned;
    phrases of fewer words are given with whatever they count here.
    """
    # Parts hold their pointers, and the symbols at their depth and the weights in the same order.
    stack = [(np.arange(len(weights)), columns[0], weights, 0)] if len(weights) else []
    while stack:
        pointers, symbols, sizes, depth = stack.pop()
        final, deeper_final = max(2, depth + 1) >= complete, max(2, depth + 2) >= complete  # phrases have two words at least
        if final and sizes.sum() < least:
            continue
        if len(symbols) > SMALL:
            pivot = sorted((symbols[0], symbols[len(symbols) // 2], symbols[-1]))[1]
            equal = symbols == pivot
            if not equal.all():
                for part in (symbols < pivot, symbols > pivot):
                    if part.any():
                        stack.append((pointers[part], symbols[part], sizes[part], depth))
            alike = [(pivot, pointers[equal], sizes[equal])]
        else:
            alike = _equal_parts(pointers, symbols, sizes, least if final else 0)
        for symbol, pointers, sizes in alike:
            count = int(sizes.sum())
            if symbol == 0 or final and count < least:
                continue
            if depth:
                yield int(pointers[0]), depth + 1, count
            if depth + 1 < len(columns) and (count >= least or not deeper_final):
                stack.append((pointers, columns[depth + 1][pointers], sizes, depth + 1))


def _equal_parts(pointers: np.ndarray, symbols: np.ndarray, sizes: np.ndarray, least: int) -> Iterator[tuple]:
    """The parts of equal symbols that weigh ``least`` of a part that is small enough to be sorted at once."""
    order = np.argsort(symbols)
    symbols, pointers, sizes = symbols[order], pointers[order], sizes[order]
    begin = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1]))
    end = np.append(begin[1:], len(symbols))
    enough = np.add.reduceat(sizes, begin) >= least
    for low, high in zip(begin[enough].tolist(), end[enough].tolist()):
        yield symbols[low], pointers[low:high], sizes[low:high]


def phrases(suffixes: DataFrame, tasks: int, least: int) -> DataFrame:
    """``words`` (symbols) and count ``n`` of all phrases of two words or more that stand ``least`` times."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [[batch.column(k).to_numpy() for k in range(LONGEST + 2)] for batch in batches]
        if not parts:
            return
        *symbols, depths, weights = [np.concatenate(c) for c in zip(*parts)]
        for depth in np.unique(depths).tolist():
            chosen = np.flatnonzero(depths == depth)
            columns = [c[chosen].view(U64) for c in symbols]
            rows = np.array(list(frequent_prefixes(columns, weights[chosen], least, depth)), dtype=np.int64).reshape(-1, 3)
            found = [np.where(rows[:, 1] > k, _signed(c[rows[:, 0]]), 0) for k, c in enumerate(columns)]
            yield table(_PHRASES, *found, rows[:, 2])

    route = [F.col("w1"), F.col("w2"), *[F.when(F.col("depth") > k, F.col(f"w{k + 1}")) for k in range(2, LONGEST)]]
    sorted_parts = in_arrow(suffixes.repartition(tasks, *route), run, _ddl(_PHRASES))
    return (
        sorted_parts.groupBy(*_SYMBOLS).agg(F.sum("n").alias("n")).where(F.col("n") >= least)
        .select(F.array_remove(F.array(*_SYMBOLS), F.lit(0).cast("bigint")).alias("words"), "n")
    )


def collocations(docs: DataFrame, least: int = LEAST, top: int = TOP) -> DataFrame:
    """The ``top`` phrases of each language: ``lang, rank, phrase, a, l, r, n, score``."""
    tasks = partitions(docs.sparkSession)
    counts = counted(docs, tasks)
    kept = stored(counts.where((F.col("depth") != 2) | (F.col("n") >= least)))
    told = F.split("word", "\0", 2)
    words = kept.where("depth = 1").select("key", told[0].alias("lang"), told[1].alias("word"), "n")
    pairs = kept.where("depth = 2")
    twins = _twins(words)
    bitmap = bitmap_of(pairs, "key", pairs.count())
    total = words.agg(F.sum("n")).first()[0] or 0
    heavy = kept.where(F.col("depth") > 1).where(F.col("n") > max(1.0, total * HOT_SHARE / tasks)).select("depth", "key").toArrow()
    depths, keys = heavy.column("depth").to_numpy(), heavy.column("key").to_numpy()
    hot = {depth: keys[depths == depth].view(U64) for depth in range(2, LONGEST)}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for block in _blocks(batches, MERGED_BYTES, twins):
            yield merged_suffixes(block, bitmap, hot)

    suffixes = in_arrow(_source(docs), run, _ddl(_SUFFIXES))
    found = stored(phrases(suffixes, tasks, least))
    own = [(key, lang, word.decode(), symbol) for key, some in twins.items() for (lang, word), symbol in some.items()]
    if own:
        renamed = docs.sparkSession.createDataFrame(own, "key bigint, lang string, word string, own bigint")
        words = words.join(renamed, ["key", "lang", "word"], "left").withColumn("key", F.coalesce("own", "key"))
    return best(found, words, least, top)


def best(found: DataFrame, words: DataFrame, least: int, top: int) -> DataFrame:
    """Scores of the phrases by the counts of their parts, and the ``top`` of each language."""
    spark = found.sparkSession
    sums = words.groupBy("lang").agg(F.sum("n").alias("all_words"))
    frequent = words.where(F.col("n") >= least).select(F.col("key").alias("symbol"), "lang", "word", F.col("n").alias("count"))
    part_counts = found.unionByName(frequent.select(F.array("symbol").alias("words"), F.col("count").alias("n")))

    # A phrase inside a longer one that stands as often also stands inside one that is longer by a word.
    size = F.size("words")
    inside = (
        found.where(size > 2)
        .select(F.explode(F.array(F.slice("words", F.lit(1), size - 1), F.slice("words", F.lit(2), size - 1))).alias("words"), "n")
        .groupBy("words").agg(F.max("n").alias("longer"))
    )
    own = found.join(inside, "words", "left").where(F.col("longer").isNull() | (F.col("longer") < F.col("n"))).drop("longer")

    cuts = (
        own.withColumnRenamed("n", "a").withColumn("k", F.explode(F.sequence(F.lit(1), F.size("words") - 1)))
        .select("words", "a", "k", F.slice("words", F.lit(1), F.col("k")).alias("left_part"),
                F.slice("words", F.col("k") + 1, F.size("words") - F.col("k")).alias("right_part"))
    )
    cuts = (
        cuts.join(part_counts.select(F.col("words").alias("left_part"), F.col("n").alias("l")), "left_part")
        .join(part_counts.select(F.col("words").alias("right_part"), F.col("n").alias("r")), "right_part")
    )
    # The least score is that of the largest product, and equal products give equal scores; ties go by k after flooring.
    spelt = (
        own.select("words", F.posexplode("words").alias("place", "symbol")).join(frequent, "symbol")
        .groupBy("words").agg(F.sort_array(F.collect_list(F.struct("place", "word"))).alias("spelling"), F.min("lang").alias("lang"))
        .select("words", "lang", F.array_join("spelling.word", " ").alias("phrase"))
    )
    digits = lambda c: F.col(c).cast("decimal(17,0)")
    scored = (
        cuts.join(spelt, "words").join(sums, "lang")
        .withColumn("gain", (digits("a") * digits("all_words") * F.lit(1000).cast("decimal(4,0)")).cast("decimal(38,0)"))
        .withColumn("product", (digits("l") * digits("r")).cast("decimal(38,0)"))
        .withColumn("score", F.expr("gain div product"))
        .groupBy("lang", "phrase").agg(F.min(F.struct("score", "k", "l", "r", "a", F.col("all_words").alias("n"))).alias("least"))
        .select("lang", "phrase", "least.a", "least.l", "least.r", "least.n", "least.score")
    )
    order = [F.col("score").desc(), F.col("a").desc(), F.col("phrase").asc()]
    part = F.pmod(F.xxhash64("phrase"), F.lit(partitions(spark)))
    firsts = (
        scored.withColumn("part", part)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang", "part").orderBy(*order))).where(F.col("rank") <= top)
        .withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("bigint"))
    )
    return firsts.where(F.col("rank") <= top).select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def sql() -> str:
    """The same rows by counting every run of one to five words."""
    return f"""
WITH pieces AS (
    SELECT coalesce(lang, '{UNKNOWN}') AS lang,
           unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                     '[.,;:!?\\x0A-\\x0D]')) AS piece
    FROM documents
), worded AS (
    SELECT lang, words FROM (SELECT lang, regexp_extract_all(piece, '[^\\x20\\x09]+') AS words FROM pieces) WHERE len(words) > 0
), places AS (
    SELECT lang, words, unnest(range(1, len(words) + 1)) AS i FROM worded
), runs AS (
    SELECT lang, words, i, unnest(range(1, least({LONGEST}, len(words) - i + 1) + 1)) AS m FROM places
), counts AS (
    SELECT lang, words[i : i + m - 1] AS phrase, count(*) AS f FROM runs GROUP BY ALL
), totals AS (
    SELECT lang, sum(f)::BIGINT AS n FROM counts WHERE len(phrase) = 1 GROUP BY lang
), frequent AS (
    SELECT lang, phrase, f FROM counts WHERE f >= {LEAST}
), longer AS (
    SELECT lang, phrase[1 : len(phrase) - 1] AS phrase, f FROM frequent WHERE len(phrase) > 2
    UNION ALL
    SELECT lang, phrase[2 : len(phrase)] AS phrase, f FROM frequent WHERE len(phrase) > 2
), inside AS (
    SELECT lang, phrase, max(f) AS f FROM longer GROUP BY ALL
), own AS (
    SELECT c.lang, c.phrase, c.f AS a FROM frequent c LEFT JOIN inside i ON i.lang = c.lang AND i.phrase = c.phrase
    WHERE len(c.phrase) > 1 AND (i.f IS NULL OR 100 * i.f < 100 * c.f)
), cuts AS (
    SELECT lang, phrase, a, unnest(range(1, len(phrase))) AS k FROM own
), scored AS (
    SELECT c.lang, c.phrase, c.a, c.k, x.f AS l, y.f AS r, t.n,
           (1000::HUGEINT * c.a * t.n) // (x.f::HUGEINT * y.f) AS score
    FROM cuts c
    JOIN frequent x ON x.lang = c.lang AND x.phrase = c.phrase[1 : c.k]
    JOIN frequent y ON y.lang = c.lang AND y.phrase = c.phrase[c.k + 1 : len(c.phrase)]
    JOIN totals t ON t.lang = c.lang
), lowest AS (
    SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) AS place FROM scored
), ranked AS (
    SELECT lang, array_to_string(phrase, ' ') AS phrase, a, l, r, n, score::BIGINT AS score,
           row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, array_to_string(phrase, ' ')) AS rank
    FROM lowest WHERE place = 1
)
SELECT lang, rank, phrase, a, l, r, n, score FROM ranked WHERE rank <= {TOP}
"""
