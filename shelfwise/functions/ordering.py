"""Ranks over a whole table or within groups of any size, without a single-task window, and values of the row before.

A window with no PARTITION BY moves every row into one task.  Here the rows are range partitioned and
sorted instead, each block of the order is numbered on its own, and only one row per block (its size) is
combined to find where the block starts.  The range-partitioned rows are checkpointed first:
block numbers are then stored values which a lost executor cannot change.

Every ``order`` must be a total order, so it ends with a unique id.  Equal leading values are thereby
spread over as many blocks as they need.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage
from .exact import ratio

# monotonically_increasing_id() keeps the partition number above bit 33 and the row number below it.
_ROW_BITS = 33
_ROW, _BLOCK = "_row", "_block"


def _blocks(df: DataFrame, order: list[Column]) -> DataFrame:
    ordered = (
        df.repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .withColumn(_ROW, F.monotonically_increasing_id())
    )
    return cut_lineage(ordered).withColumn(_BLOCK, F.shiftright(_ROW, _ROW_BITS))


def _ends(blocks: DataFrame, keys: list[str]) -> DataFrame:
    """Per block the number of rows before it, the number of all rows, and the ``keys`` of its last row.

    One row per block, at most one block per shuffle partition.
    """
    ends = blocks.groupBy(_BLOCK).agg(
        F.count(F.lit(1)).alias("_size"), *[F.max_by(key, _ROW).alias(key) for key in keys]
    )
    before = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
    return ends.select(
        _BLOCK,
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"),
        F.sum("_size").over(Window.partitionBy()).alias("rows"),
        *keys,
    )


def _numbered(blocks: DataFrame, ends: DataFrame) -> DataFrame:
    local = F.col(_ROW).bitwiseAND(F.lit((1 << _ROW_BITS) - 1))
    starts = F.broadcast(ends.select(_BLOCK, "_start", "rows"))
    return blocks.join(starts, _BLOCK).withColumn("position", F.col("_start") + local + 1).drop("_start")


def rank_rows(
    df: DataFrame, by: str, tie_break: str, *, within: str | None = None, descending: bool = False,
    rank: str = "rank",
) -> DataFrame:
    """Add RANK (ties share the lowest place) by ``by``, over all rows or ``within`` a column's groups.

    Also adds ``position`` and ``rows`` of the whole order.  A rank is the distance between the first position
    of the row's tie and that of its group.
    """
    key = [within, by] if within else [by]
    value = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
    blocks = _blocks(df, [*[F.col(c) for c in key[:-1]], value, F.col(tie_break)])
    ends = cut_lineage(_ends(blocks, key))
    numbered = _numbered(blocks, ends)
    if within is None:
        return _with_first_position(numbered, numbered, ends, key, rank).drop(_ROW, _BLOCK)
    ranked = _with_first_position(numbered, numbered, ends, [within], "_group")
    ranked = _with_first_position(ranked, numbered, ends, key, "_tie")
    return ranked.withColumn(rank, F.col("_tie") - F.col("_group") + 1).drop("_group", "_tie", _ROW, _BLOCK)


def _with_first_position(
    df: DataFrame, numbered: DataFrame, ends: DataFrame, key: list[str], name: str
) -> DataFrame:
    """Add the first position of the row's ``key``, whose rows stand together in the order of ``numbered``.

    Within a block a window finds it.  Only the last key of a block can go on in the next one, so for at most
    one key per block the first position is looked up over all blocks.  A key of any size is thus spread over
    its blocks.
    """
    last = F.broadcast(ends.select(*key).distinct())
    firsts = join_null_safe(numbered.select(*key, "position"), last, key).groupBy(*key).agg(
        F.min("position").alias("_first")
    )
    here = F.min("position").over(Window.partitionBy(_BLOCK, *key))
    return (
        join_null_safe(df.withColumn("_here", here), F.broadcast(firsts), key, "left")
        .withColumn(name, F.coalesce("_first", "_here"))
        .drop("_first", "_here")
    )


def join_null_safe(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    renamed = right.withColumnsRenamed({key: f"_k_{key}" for key in keys})
    condition = reduce(Column.__and__, [F.col(key).eqNullSafe(F.col(f"_k_{key}")) for key in keys])
    return left.join(renamed, condition, how).drop(*[f"_k_{key}" for key in keys])


def _div(part: Column, whole: Column | int) -> Column:
    return F.call_function("div", part, F.lit(whole) if isinstance(whole, int) else whole)


def tile(position: Column, rows: Column, tiles: int) -> Column:
    """NTILE from a row's position: the first ``rows % tiles`` tiles hold one row more."""
    size, extra = _div(rows, tiles), rows % tiles
    long_part = extra * (size + 1)
    in_long = _div(position + size, size + 1)
    # With fewer rows than tiles every row lies in the long part, so the guard is never used as a size.
    short = F.greatest(size, F.lit(1))
    in_short = extra + _div(position - long_part + short - 1, short)
    return F.when(position <= long_part, in_long).otherwise(in_short).cast("bigint")


def tile_end(tile_number: int, rows: Column, tiles: int) -> Column:
    """Position of the last row of a tile, NULL when there are too few rows to reach it."""
    end = _div(rows, tiles) * tile_number + F.least(rows % tiles, F.lit(tile_number))
    return F.when(rows >= tile_number, end)


def percent_rank(rank: Column, rows: Column, digits: int = 3) -> Column:
    return F.coalesce(ratio(rank - 1, rows - 1, digits), F.lit(0.0))


def previous_value(df: DataFrame, key: str, block: Column, order: list[str], name: str) -> DataFrame:
    """LAG of the leading ``order`` column per ``key``; ``order`` must be unique within a key.

    ``block`` must not decrease in ``order`` and bounds the rows of one window, such as the day of a time.  Inside a
    block an ordinary window finds the row before.  The first row of a block takes the greatest value of the key's
    block before it, found by a window over one aggregated row per key and block.
    """
    rows = df.withColumn(_BLOCK, block)
    last = rows.groupBy(key, _BLOCK).agg(F.max(order[0]).alias("_last"))
    carried = last.select(key, _BLOCK, F.lag("_last").over(Window.partitionBy(key).orderBy(_BLOCK)).alias("_carry"))
    before = F.lag(order[0]).over(Window.partitionBy(key, _BLOCK).orderBy(*order))
    return (
        join_null_safe(rows.withColumn(name, before), carried, [key, _BLOCK], "left")
        .withColumn(name, F.coalesce(name, "_carry"))
        .drop(_BLOCK, "_carry")
    )
