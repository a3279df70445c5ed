"""Positions, ranks and running sums in several orders of one table, which is stored once.

The caller reduces its rows to an id and the keys to be ordered by; names and the like are joined on at the end.  These slim
rows are written once, and while they are written Spark merges a quantile sketch of every key and of the id.  For every order
the sketch gives splitters that cut the rows into blocks of about one size.  A value that holds several of a sketch's
quantiles gets blocks of its own, cut by id, so a tie of any size is spread over as many blocks as it needs; so is the tie of
missing keys, which come last.

Splitters only decide how evenly rows are spread.  Places are exact: blocks are counted, the counts before a block give its
start, and a window within the block does the rest.  A row of an order costs one shuffle of slim rows, and everything after
the write is lazy.
"""

from __future__ import annotations

import json
from dataclasses import dataclass
from math import isqrt

from pyspark.sql import Column, DataFrame, Observation, Window
from pyspark.sql import functions as F

from ..session import stored_table

#: Blocks per order: as many as shuffle partitions, up to this number.
MOST_BLOCKS = 4_096
_BLOCK, _GROUP, _KEY = "_block", "_group", "_key"


def _sketch(column: Column, blocks: int) -> Column:
    shares = [k / blocks for k in range(1, blocks)]
    found = F.percentile_approx(column, shares, 10 * blocks)
    return F.to_json(F.transform(found, lambda value: value.cast("string")))


def _strictly_before(value: Column, splitters: Column, count: int, descending: bool) -> Column:
    """How many of the ordered splitters come before a value, looked up in two steps."""
    width = isqrt(count) + 1

    def found(some: Column) -> Column:
        return F.size(F.filter(some, lambda s: s > value if descending else s < value))

    steps = F.transform(F.sequence(F.lit(width), F.lit(max(count // width * width, width)), F.lit(width)), lambda k: F.get(splitters, k - 1))
    start = found(steps) * width if count >= width else F.lit(0)
    return start + found(F.slice(splitters, start + 1, F.lit(width)))


@dataclass(frozen=True)
class _Splitters:
    """A sketch's quantiles in one direction: distinct values, and how many quantiles each of them is."""

    values: list[str]
    counts: list[int]

    @classmethod
    def of(cls, quantiles: list[str], descending: bool) -> "_Splitters":
        ordered = list(reversed(quantiles)) if descending else quantiles
        distinct = list(dict.fromkeys(ordered))
        return cls(distinct, [ordered.count(v) for v in distinct] if len(distinct) < len(ordered) else [1] * len(distinct))


class Places:
    """A stored table of an ``id`` and keys, in as many orders as are asked for.  The id is unique and a whole number."""

    def __init__(self, keys: DataFrame, tie_break: str, by: list[str]):
        spark = keys.sparkSession
        self.id, self.blocks = tie_break, max(2, min(int(spark.conf.get("spark.sql.shuffle.partitions")), MOST_BLOCKS))
        seen = Observation()
        sketches = [_sketch(F.col(c), self.blocks).alias(f"q{k}") for k, c in enumerate([tie_break, *by])]
        self.table = stored_table(keys.observe(seen, *sketches))
        found = seen.get
        self.quantiles = {c: json.loads(found[f"q{k}"] or "[]") for k, c in enumerate([tie_break, *by])}

    def _blocked(self, by: str, descending: bool) -> DataFrame:
        """The rows with their block, and the group of blocks that are one tie's (others are groups of their own)."""
        key, kinds = F.col(by), dict(self.table.dtypes)
        splitters, ids = _Splitters.of(self.quantiles[by], descending), _Splitters.of(self.quantiles[self.id], False)

        def literal(values: list, kind: str) -> Column:
            return F.array(*map(F.lit, values)).cast(f"array<{kind}>")

        count = len(splitters.values)
        before = F.when(key.isNull(), F.lit(count))
        shares = F.when(key.isNull(), F.lit(self.blocks))  # blocks of the row's tie, NULL where it needs none of its own
        if count:
            values, counts = literal(splitters.values, kinds[by]), literal(splitters.counts, "int")
            before = before.otherwise(_strictly_before(key, values, count, descending))
            here = _strictly_before(key, values, count, descending)
            shares = shares.when((F.get(values, here) == key) & (F.get(counts, here) > 1), F.get(counts, here))
        place = F.lit(0)
        if ids.values:
            place = _strictly_before(F.col(self.id), literal(ids.values, kinds[self.id]), len(ids.values), False)
        part = F.coalesce(F.floor(place * shares / F.lit(len(ids.values) + 1)), F.lit(0))
        group = before * 2 + F.when(shares.isNotNull(), 1).otherwise(0)
        return self.table.withColumn(_GROUP, group.cast("bigint")).withColumn(
            _BLOCK, (F.col(_GROUP) * (self.blocks + 1) + part).cast("bigint")
        )

    def ordered(self, by: str, descending: bool = False, total: str | None = None) -> DataFrame:
        """The stored rows with ``position`` (ties by id), ``rank`` (ties share the first) and ``rows`` of the order.

        With ``total``, also the sum of that column over all rows up to the last of the row's tie as ``running``, and over
        the whole table as ``all``; missing values add nothing.
        """
        rows = self._blocked(by, descending)
        sums = [F.sum(total).alias("_sum")] if total else []
        sizes = rows.groupBy(_GROUP, _BLOCK).agg(F.count(F.lit(1)).alias("_size"), *sums)  # four rows per block at most
        before = Window.orderBy(_BLOCK).rowsBetween(Window.unboundedPreceding, -1)
        whole, group = Window.partitionBy(), Window.partitionBy(_GROUP)
        starts = sizes.select(
            _GROUP, _BLOCK, F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_start"), F.sum("_size").over(whole).alias("rows"),
            *([F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_sum_before"), F.sum("_sum").over(whole).alias("all"),
               F.coalesce(F.sum("_sum").over(group), F.lit(0)).alias("_group_sum")] if total else []),
        )
        starts = starts.withColumn("_group_start", F.min("_start").over(group))
        if total:
            starts = starts.withColumn("_group_sum_before", F.min_by("_sum_before", _BLOCK).over(group))
        value = F.col(by).desc_nulls_last() if descending else F.col(by).asc_nulls_last()
        inside = Window.partitionBy(_BLOCK)
        one_tie = F.col(_GROUP) % 2 == 1
        numbered = rows.withColumns({
            "_here": F.row_number().over(inside.orderBy(value, F.col(self.id))), "_rank": F.rank().over(inside.orderBy(value)),
            **({"_sum": F.coalesce(F.sum(total).over(inside.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)), F.lit(0))}
               if total else {}),
        }).join(F.broadcast(starts.drop(_GROUP)), _BLOCK)
        placed = numbered.withColumns({
            "position": F.col("_start") + F.col("_here"),
            "rank": F.when(one_tie, F.col("_group_start") + 1).otherwise(F.col("_start") + F.col("_rank")),
            **({"running": F.when(one_tie, F.col("_group_sum_before") + F.col("_group_sum"))
                .otherwise(F.col("_sum_before") + F.col("_sum"))} if total else {}),
        })
        return placed.select(*self.table.columns, "position", "rank", "rows", *(["running", "all"] if total else []))
