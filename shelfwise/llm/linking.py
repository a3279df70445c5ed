"""From banded samples to classes of near-duplicates: candidates, verification in rounds, connected components.

Everything here works on ids, samples and the texts of candidates; nothing reaches the driver but row counts.  Pairs that
are already in one class meet no more:

1. every member of a bucket of equal band keys meets the least of the pivots of its buckets (a bucket's pivot is its least
   id);
2. in buckets that still hold several classes, every member meets the bucket's own pivot;
3. in buckets that then still hold several classes, every member meets every member of another class.

Steps 1 and 2 only join large classes cheaply.  They compare a pair's samples first and its texts only when ``AGREE`` of the
samples agree, which a pair at the threshold of 0.8 does with a probability of 0.98 for 64 samples; pairs that are left here
meet in step 3.  Step 3 compares texts without looking at samples and leaves no pair out.  It deals the members of a bucket
to cells of bounded size, a class that fills more than one cell to cells of its own, and compares cells two by two, all
pairs of two cells in one matrix product; so no pairs are listed as rows, only the links that join classes.  The cost is that
a text is sent once to every other cell of its buckets.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from shelfwise.llm.frames import in_arrow, ship, stored, table, texts

AGREE = 0.7
#: A cell of step 3 has about so many texts and bytes at most, one text at least.
CELL_TEXTS = 256
CELL_BYTES = 8 << 20
#: Elements of texts that are held against each other at a time.
COLUMNS = 4096

#: Takes (a, b, text_a, text_b) and gives the (a, b) whose texts are near.
Verify = Callable[[DataFrame], DataFrame]
#: Gives of each text its distinct elements in order (uint64) and their weights, which depend on the element alone.  Texts
#: are near if the weight of the common elements is at least ``least`` of the weight of all elements of the two.
Features = Callable[[pa.Array], list[tuple[np.ndarray, np.ndarray]]]
_PAIRS = pa.schema([("a", pa.int64()), ("b", pa.int64())])


def components(links: DataFrame) -> DataFrame:
    """Least id of the connected component of every id in ``links`` (``a``, ``b``), as (``id``, ``root``); roots are left
    out.

    Alternates large-star and small-star steps: neighbours are moved to the least neighbour until every component is a
    star.  The number of steps grows with the logarithm of the longest path.
    """
    edges = stored(links.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).where("a <> b").distinct())
    before = None
    while True:
        both = edges.unionAll(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        lowest = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(lowest, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
        edges = stored(small.unionAll(lowest.select("a", F.col("m").alias("b"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("a").alias("id"), F.col("b").alias("root"))
        before = now


def _with_roots(rows: DataFrame, roots: DataFrame) -> DataFrame:
    return rows.join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))


def _agreeing(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return (left == right).mean(axis=1) >= AGREE


def _samples(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint8).reshape(len(column), -1)


def _likely(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            near = pa.array(_agreeing(_samples(batch.column("samples_a")), _samples(batch.column("samples_b"))))
            yield table(_PAIRS, batch.column("a").filter(near), batch.column("b").filter(near))


def _shared_weight(rows: list, columns: list) -> np.ndarray:
    """Weight of the elements that a text of ``rows`` and one of ``columns`` have in common, for all pairs."""
    sides = []
    for side in (rows, columns):
        owner = np.repeat(np.arange(len(side)), [len(e) for e, _ in side])
        sides.append((owner, np.concatenate([e for e, _ in side]), np.concatenate([w for _, w in side])))
    common = np.intersect1d(sides[0][1], sides[1][1])
    placed = []
    for owner, elements, weight in sides:
        known = np.flatnonzero(np.isin(elements, common))
        at = np.searchsorted(common, elements[known])
        order = np.argsort(at, kind="stable")
        placed.append((owner[known][order], at[order], weight[known][order]))
    total = np.zeros((len(rows), len(columns)), dtype=np.float32)
    for low in range(0, len(common), COLUMNS):
        width = min(COLUMNS, len(common) - low)
        matrices = []
        for side, (owner, at, weight) in zip((rows, columns), placed):
            first, last = np.searchsorted(at, [low, low + width])
            matrix = np.zeros((len(side), width), dtype=np.float32)
            matrix[owner[first:last], at[first:last] - low] = weight[first:last] if side is rows else 1
            matrices.append(matrix)
            if columns is rows:
                matrices.append((matrix > 0).astype(np.float32))
                break
        total += matrices[0] @ matrices[1].T
    return total


def _is_near(left: tuple[np.ndarray, np.ndarray], right: tuple[np.ndarray, np.ndarray], least: float) -> bool:
    both = left[1][np.isin(left[0], right[0], assume_unique=True)].sum()
    return bool(both >= least * (left[1].sum() + right[1].sum() - both) > 0)


def _between_cells(features: Features, least: float):
    """Links that join the classes of the members of two cells, or of one."""

    def run(rows: pa.Table) -> pa.Table:
        batch = rows.combine_chunks().to_batches()[0]
        ids, root, right = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("id", "root", "right"))
        texts_of = features(batch.column("text"))
        low, high = np.flatnonzero(~right), np.flatnonzero(right)
        one = not len(high)
        side = [texts_of[i] for i in low]
        both = _shared_weight(side, side if one else [texts_of[i] for i in high])
        high = low if one else high
        weight = np.array([w.sum() for _, w in texts_of])
        # The product is of single precision; what comes near the threshold is computed again below.
        every = weight[low][:, None] + weight[high][None, :] - both
        likely = (both > 0) & (both >= (least - 1e-3) * every) & (root[low][:, None] != root[high][None, :])
        parent = {int(r): int(r) for r in root}

        def find(x: int) -> int:
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        found = []
        for i, j in zip(*np.nonzero(np.triu(likely) if one else likely)):
            i, j = low[i], high[j]
            x, y = find(int(root[i])), find(int(root[j]))
            if x != y and _is_near(texts_of[i], texts_of[j], least):
                parent[max(x, y)] = min(x, y)
                found.append((max(ids[i], ids[j]), min(ids[i], ids[j])))
        return pa.table([pa.array([a for a, _ in found], pa.int64()), pa.array([b for _, b in found], pa.int64())], schema=_PAIRS)

    return run


def known_texts(docs: DataFrame) -> DataFrame:
    """The documents that can be in a class: (``id``, ``digest``, ``text``), neither id nor text null."""
    rows = texts(docs).where("doc_id IS NOT NULL AND text IS NOT NULL")
    return rows.select(F.col("doc_id").alias("id"), F.sha2("text", 256).alias("digest"), "text")


def classes_with_copies(known: DataFrame, signed: DataFrame, verify: Verify, features: Features, least: float) -> DataFrame:
    """Of every id that shares a class with another id the least id of the class, as (``id``, ``class_id``).

    ``signed`` are (``id``, ``digest``, ``bands``, ``samples``) of the ``known`` texts.  One document of each text goes on
    to the search; its copies follow it.
    """
    signed = stored(signed)
    once = signed.groupBy("digest").agg(F.min("id").alias("copy_of"), F.max("id").alias("last")).where("copy_of < last")
    copied = stored(signed.select("id", "digest").join(once.select("digest", "copy_of"), "digest")
                    .where("id <> copy_of").select("id", "digest", "copy_of").distinct())
    distinct = signed.join(copied, ["id", "digest"], "left_anti").select("id", "bands", "samples")
    # An id with several texts joins the classes of all of them.
    several = signed.groupBy("id").agg(F.min("digest").alias("low"), F.max("digest").alias("high")).where("low <> high")
    tied = copied.join(several.select("id"), "id", "left_semi").select(F.col("id").alias("a"), F.col("copy_of").alias("b"))
    near = classes(distinct, known.select("id", "text"), verify, features, least, tied).withColumnRenamed("root", "class_id")
    through = copied.join(near.select(F.col("id").alias("copy_of"), "class_id"), "copy_of", "left").select(
        "id", F.coalesce("class_id", "copy_of").alias("class_id")
    )
    return near.unionAll(through)


def classes(
    signed: DataFrame, bodies: DataFrame, verify: Verify, features: Features | None = None, least: float = 0.0,
    tied: DataFrame | None = None,
) -> DataFrame:
    """Classes of near texts as (``id``, ``root``), for those ids that are near a smaller one.

    ``signed`` are (``id``, ``bands``, ``samples``): texts with an equal band may be near, and ``samples`` holds a byte of
    each sample.  ``bodies`` are (``id``, ``text``).  ``features`` and ``least`` say the same as ``verify`` for step 3; without
    them its pairs are listed.  ``tied`` are links (``a``, ``b``) known before.
    """
    members = signed.select("id", F.explode("bands").alias("band")).distinct()
    crowded = members.groupBy("band").agg(F.count("*").alias("n"), F.min("id").alias("pivot")).where("n > 1")
    members = stored(members.join(crowded.select("band", "pivot"), "band"))
    first = members.where("pivot <> id").groupBy("id").agg(F.min("pivot").alias("b")).select(F.col("id").alias("a"), "b")
    involved = members.select("id").distinct()
    # Samples and texts of candidates only; the texts are shuffled once and then read from the shared folder.  The hint
    # keeps the plan, and with it the disk a document takes, the same whether the ids could be broadcast or not.
    signed = stored(signed.join(involved, "id", "left_semi"))
    bodies = stored(
        bodies.join(involved.hint("merge"), "id", "left_semi").select("id", "text", F.octet_length("text").alias("size"))
    )
    links = _near(_agree(first, signed), bodies, verify)
    links = links if tied is None else links.unionAll(tied)
    roots = components(links)

    placed = _with_roots(members, roots)
    pivots = roots.select(F.col("id").alias("pivot"), F.col("root").alias("home"))
    apart = placed.join(pivots, "pivot", "left").where(F.col("root") != F.coalesce("home", "pivot"))
    found = _near(_agree(apart.select(F.col("id").alias("a"), F.col("pivot").alias("b")).distinct(), signed), bodies, verify)
    links = links.unionAll(found)
    placed = _several(_with_roots(members.select("id", "band"), components(links)))
    if features is None:
        found = _near(_across(placed), bodies, verify)
    else:
        found = _in_cells(placed, bodies, features, least)
    return components(links.unionAll(found))


def _several(placed: DataFrame) -> DataFrame:
    """The members of the buckets that hold several classes."""
    several = placed.groupBy("band").agg(F.min("root").alias("low"), F.max("root").alias("high")).where("low <> high")
    return stored(placed.join(several.select("band"), "band"))


def _across(placed: DataFrame) -> DataFrame:
    """All pairs of a bucket's members of different classes."""
    other = placed.select("band", F.col("id").alias("b"), F.col("root").alias("other"))
    return placed.join(other, "band").where("id > b AND root <> other").select(F.col("id").alias("a"), "b").distinct()


def _in_cells(placed: DataFrame, bodies: DataFrame, features: Features, least: float) -> DataFrame:
    """Links between all members of different classes in a bucket, enough of them to join the classes."""
    rows = stored(placed.join(bodies.select("id", "size").hint("merge"), "id"))
    cells = F.ceil(F.greatest(F.sum("n") / CELL_TEXTS, F.sum("bytes") / CELL_BYTES)).cast("bigint")
    own = rows.groupBy("band", "root").agg(F.count("*").alias("n"), F.sum("size").alias("bytes"))
    # The home of a class that fills more than one cell is its root; the others share cells.
    own = stored(own.withColumn("home", F.expr(f"IF(n > {CELL_TEXTS} OR bytes > {CELL_BYTES}, cast(root AS string), '')")))
    counted = own.groupBy("band", "home").agg(F.greatest(cells, F.lit(1)).alias("cells"))
    homes = own.select("band", "root", "home").join(counted, ["band", "home"])
    cell = F.concat_ws("/", "home", F.pmod(F.xxhash64("id"), "cells").cast("string"))
    rows = stored(rows.join(homes, ["band", "root"]).select("id", "root", "band", "home", cell.alias("cell")))
    left = rows.select("band", F.col("cell").alias("a"), F.col("home").alias("home_a")).distinct()
    right = rows.select("band", F.col("cell").alias("b"), F.col("home").alias("home_b")).distinct()
    # Cells of one class need not meet, nor a cell of one class itself.
    pairs = stored(left.join(right, "band").where("a <= b AND (home_a = '' OR home_a <> home_b)").select("band", "a", "b"))
    tasks = pairs.select("band", F.col("a").alias("cell"), "a", "b", F.lit(False).alias("right")).unionAll(
        pairs.where("a < b").select("band", F.col("b").alias("cell"), "a", "b", F.lit(True).alias("right"))
    )
    dealt = rows.join(tasks, ["band", "cell"]).select("id", "root", "band", "a", "b", "right")
    sent = dealt.hint("merge").join(bodies.select("id", "text"), "id")
    ship(placed.sparkSession)
    found = sent.select("band", "a", "b", "id", "root", "right", "text").groupBy("band", "a", "b")
    return stored(found.applyInArrow(_between_cells(features, least), "a bigint, b bigint"))


def _agree(pairs: DataFrame, signed: DataFrame) -> DataFrame:
    sides = pairs.join(signed.select(F.col("id").alias("a"), F.col("samples").alias("samples_a")), "a")
    sides = sides.join(signed.select(F.col("id").alias("b"), F.col("samples").alias("samples_b")), "b")
    return in_arrow(sides.select("a", "b", "samples_a", "samples_b"), _likely, "a bigint, b bigint")


def _near(pairs: DataFrame, bodies: DataFrame, verify: Verify) -> DataFrame:
    pairs = stored(pairs)
    sides = pairs.join(bodies.select(F.col("id").alias("a"), F.col("text").alias("text_a")), "a")
    sides = sides.join(bodies.select(F.col("id").alias("b"), F.col("text").alias("text_b")), "b")
    return stored(verify(sides.select("a", "b", "text_a", "text_b")).select("a", "b"))
