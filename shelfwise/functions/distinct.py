"""Exact counts of distinct ids.

Two ways, both without an Expand of the facts, and both with a shuffle by id, so that a group that holds most rows is spread
over all tasks, while equal rows of one id meet within each task before:

- ``ids_and_sums``, for one grouping: rows are reduced to one per group and id, then counted.
- ``memberships``, for several groupings of the same ids: every id is reduced to the set of finest groups it stands in, and
  equal sets are counted.  Sets are few, and their counts can be added up to any coarser grouping: an id of a set counts once
  in each coarser group that the set reaches, however many of its members fall together there.

An id that is known to be unique stands in one row, so its rows are counted instead and the id is not read.  Missing ids are
not counted.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ids_and_sums(
    rows: DataFrame, key: str, groups: dict[str, Column], sums: dict[str, Column], unique: bool = False
) -> DataFrame:
    """Per group the number of distinct ``ids`` and of all ``rows``, and sums over all rows."""
    chosen = rows.select(*[c.alias(name) for name, c in {**groups, **sums}.items()], *([] if unique else [F.col(key).alias("_id")]))
    added = [F.sum(name).alias(name) for name in sums]
    if unique:
        count = F.count(F.lit(1))
        return chosen.groupBy(*groups).agg(count.alias("ids"), count.alias("rows"), *added)
    per_id = chosen.groupBy(*groups, "_id").agg(F.count(F.lit(1)).alias("rows"), *added)
    return per_id.groupBy(*groups).agg(F.count("_id").alias("ids"), F.sum("rows").alias("rows"), *added)


def memberships(rows: DataFrame, key: str, groups: dict[str, Column], unique: bool = False) -> DataFrame:
    """``(groups, ids)``: sets of groups, and how many ids stand in just those."""
    group = F.struct(*[c.alias(name) for name, c in groups.items()]).alias("group")
    present = rows.filter(F.col(key).isNotNull())
    if unique:
        counted = present.select(group).groupBy("group").agg(F.count(F.lit(1)).alias("ids"))
        return counted.select(F.array("group").alias("groups"), "ids")
    per_id = present.select(F.col(key).alias("_id"), group).groupBy("_id").agg(F.sort_array(F.collect_set("group")).alias("groups"))
    return per_id.groupBy("groups").agg(F.count(F.lit(1)).alias("ids"))


def members(sets: DataFrame) -> DataFrame:
    """Every set once for each of its groups, whose columns can then be looked up, filtered or made coarser."""
    return sets.select("groups", "ids", F.inline("groups"))


def count_by(reached: DataFrame, by: list[str], name: str = "ids") -> DataFrame:
    """Distinct ids per group ``by``, from the members of sets with any columns added to them."""
    return reached.groupBy("groups", *by).agg(F.max("ids").alias("ids")).groupBy(*by).agg(F.sum("ids").alias(name))


def count_by_levels(reached: DataFrame, levels: list[str], name: str = "ids") -> DataFrame:
    """Distinct ids for all of ``levels`` (coarsest first), for each shorter list of them, and in all; absent levels are NULL.

    ``level`` is the number of levels that a row is for.  The sets are expanded here, not the facts.
    """
    steps = [levels[:k] for k in range(len(levels), -1, -1)]
    wanted = [[F.col("groups"), *map(F.col, step)] for step in steps]
    per_set = reached.groupingSets(wanted, "groups", *levels).agg(
        F.max("ids").alias("ids"), (F.lit(len(levels)) - F.bit_count(F.grouping_id())).alias("level")
    )
    return per_set.groupBy("level", *levels).agg(F.sum("ids").alias(name))
