"""Stock questions.

The series of one store and product has one row per snapshot date (the table's unique key), so a window over
a series is bounded by the calendar and never by the size of a store.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.exact import money, ratio
from ..functions.ordering import percent_rank, rank_rows, tile
from ..functions.places import Places
from ..session import cut_lineage
from ..sources.tables import Tables
from .common import latest_stock, product_names, store_names


def series() -> WindowSpec:
    return Window.partitionBy("store_id", "product_id").orderBy("stock_date")


def _sorted(df: DataFrame, sort: bool, *keys: str) -> DataFrame:
    """Sorting a row per snapshot or day is a full shuffle that changes no row, so it is left to the caller."""
    return df.orderBy(*keys) if sort else df


def stockout_risk(t: Tables) -> DataFrame:
    """Stores and products whose newest closing stock is at or below the reorder level."""
    return (
        latest_stock(t)
        .filter(F.col("closing_stock") <= F.col("reorder_level"))
        .join(store_names(t), "store_id")
        .join(product_names(t), "product_id")
        .select(
            "store_id", "store_name", "product_id", "product_name", "closing_stock", "reorder_level", "stock_date"
        )
        .orderBy("closing_stock", "store_id", "product_id")
    )


def _wasted_by_product(t: Tables) -> DataFrame:
    return t["inventory"].groupBy("product_id").agg(F.sum("units_wasted").alias("wasted"))


def wastage_top(t: Tables, limit: int = 20) -> DataFrame:
    """Products with the costliest wastage."""
    products = t["products"].select("product_id", "product_name", "shelf_life_days", "unit_cost")
    return (
        _wasted_by_product(t)
        .filter(F.col("wasted") > 0)
        .join(products, "product_id")
        .withColumn("cost", F.col("wasted") * F.col("unit_cost"))
        .orderBy(F.desc_nulls_last("cost"), "product_id")
        .limit(limit)
        .select(
            "product_id", "product_name", F.col("shelf_life_days").cast("bigint").alias("shelf_life_days"),
            F.col("wasted").alias("total_units_wasted"), money(F.col("cost")).alias("wastage_cost"),
        )
    )


def wastage_rank(t: Tables) -> DataFrame:
    """Products ranked by wasted units within their category."""
    wasted = _wasted_by_product(t).join(
        t["products"].select("product_id", "product_name", "category_id"), "product_id"
    )
    ranked = rank_rows(
        wasted, by="wasted", tie_break="product_id", within="category_id", descending=True,
        rank="wastage_rank_in_category",
    )
    return (
        ranked.join(t["categories"].select("category_id", "category_name"), "category_id")
        .select("category_name", "product_name", F.col("wasted").alias("total_wasted"), "wastage_rank_in_category")
        .orderBy("category_name", "wastage_rank_in_category", "product_name")
    )


def stock_movement(t: Tables, sort: bool = False) -> DataFrame:
    """Each snapshot with the closing stock before and after it."""
    before = F.lag("closing_stock").over(series())
    out = t["inventory"].select(
        "store_id", "product_id", "stock_date", "closing_stock", before.alias("prev_closing_stock"),
        F.lead("closing_stock").over(series()).alias("next_closing_stock"),
        (F.col("closing_stock") - before).alias("stock_change"),
    )
    return _sorted(out, sort, "store_id", "product_id", "stock_date")


def rolling_avg(t: Tables, sort: bool = False) -> DataFrame:
    """Average units sold over a snapshot and up to three before it."""
    last_four = series().rowsBetween(-3, Window.currentRow)
    out = t["inventory"].select(
        "store_id", "product_id", "stock_date", "units_sold",
        F.sum("units_sold").over(last_four).alias("total"), F.count("units_sold").over(last_four).alias("n"),
    )
    # Four snapshots' sales stay far inside a long even times 200.
    mean = ratio(F.col("total"), F.col("n"), kind="bigint").alias("rolling_4period_avg_sold")
    out = out.select("store_id", "product_id", "stock_date", "units_sold", mean)
    return _sorted(out, sort, "store_id", "product_id", "stock_date")


def running_received(t: Tables, sort: bool = False) -> DataFrame:
    """Units each store received per date and in total so far; the window holds one row per date."""
    daily = t["inventory"].groupBy("store_id", "stock_date").agg(
        F.sum("units_received").alias("units_received_that_day")
    )
    so_far = Window.partitionBy("store_id").orderBy("stock_date")
    out = daily.withColumn("running_total_received", F.sum("units_received_that_day").over(so_far))
    return _sorted(out, sort, "store_id", "stock_date")


def demand_tiers(t: Tables) -> DataFrame:
    """Products by units sold: percentile and quartile, 4 being the highest; ties go by product id."""
    names = product_names(t)
    sold = t["inventory"].groupBy("product_id").agg(F.sum("units_sold").alias("total_sold"))
    places = Places(sold.join(names.select("product_id"), "product_id", "left_semi"), "product_id", ["total_sold"])
    return places.ordered("total_sold").join(names, "product_id").select(
        "product_id", "product_name", "total_sold", percent_rank(F.col("rank"), F.col("rows")).alias("sales_percentile"),
        tile(F.col("position"), F.col("rows"), 4).alias("demand_quartile"),
    ).orderBy(F.desc("total_sold"), "product_id")


def category_tree(t: Tables) -> DataFrame:
    """Every category with its depth and path from the root.

    One join per level until a level is empty; each category has one parent, so it appears once.  Unlike a
    recursive query this has no limit on levels or rows.  Categories whose ids repeat may form a ring that a root leads
    into; there are more levels than categories then, and this raises.
    """
    categories = cut_lineage(t["categories"].select("category_id", "category_name", "parent_category_id"))
    level = categories.filter(F.col("parent_category_id").isNull()).select(
        "category_id", "category_name", F.lit(0).cast("bigint").alias("depth"), F.col("category_name").alias("category_path")
    )
    levels: list[DataFrame] = []
    count = categories.count()
    while not level.isEmpty():
        if len(levels) == count:
            raise ValueError("categories form a ring")
        levels.append(level)
        parents = level.select(
            F.col("category_id").alias("parent_category_id"), F.col("depth").alias("parent_depth"),
            F.col("category_path").alias("parent_path"),
        )
        level = cut_lineage(
            categories.join(parents, "parent_category_id").select(
                "category_id", "category_name", (F.col("parent_depth") + 1).alias("depth"),
                F.concat("parent_path", F.lit(" > "), "category_name").alias("category_path"),
            )
        )
    if not levels:
        return level
    return reduce(DataFrame.unionByName, levels).orderBy("category_path", "category_id")
