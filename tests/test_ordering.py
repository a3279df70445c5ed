"""Distributed numbering and ranks against ordinary windows."""

import random

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions.ordering import (
    percent_rank, previous_value, rank_rows, tile, tile_end,
)


def values(spark, n, kinds, seed):
    """``n`` rows; a third of them share one value and one group."""
    rng = random.Random(seed)
    data = [
        (i, 0 if rng.random() < 0.34 else rng.randint(0, kinds), 0 if rng.random() < 0.34 else rng.randint(1, 6))
        for i in range(n)
    ]
    return spark.createDataFrame(data, "id bigint, v bigint, g bigint")


@pytest.mark.parametrize("n, kinds, seed", [(0, 1, 0), (1, 1, 1), (7, 3, 2), (500, 20, 3), (500, 10**9, 4), (300, 1, 5)])
def test_number_and_rank_match_windows(spark, n, kinds, seed):
    df = values(spark, n, kinds, seed)
    order = Window.orderBy(F.desc("v"), "id")
    expected = df.select(
        "id", F.row_number().over(order), F.rank().over(Window.orderBy(F.desc("v"))), F.count("*").over(Window.partitionBy())
    )
    got = rank_rows(df, by="v", tie_break="id", descending=True)
    assert rows(got.select("id", "position", "rank", "rows")) == rows(expected)


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_rank_within_groups(spark, seed):
    df = values(spark, 400, 12, seed)
    expected = df.select("id", F.rank().over(Window.partitionBy("g").orderBy(F.desc("v"))))
    got = rank_rows(df, by="v", tie_break="id", within="g", descending=True)
    assert rows(got.select("id", "rank")) == rows(expected)


def test_rank_of_missing_values(spark):
    df = spark.createDataFrame([(1, None, None), (2, 5, None), (3, None, 1), (4, 5, 1)], "id int, v int, g int")
    got = rank_rows(df, by="v", tie_break="id", within="g", descending=True)
    assert rows(got.select("id", "rank")) == [(1, 2), (2, 1), (3, 2), (4, 1)]


def test_one_value_spreads_over_blocks(spark):
    """A tie group as large as the table is not collected into one task."""
    df = spark.range(2000).withColumn("v", F.lit(1))
    spread = df.repartitionByRange(F.col("v"), F.col("id")).groupBy(F.spark_partition_id()).count().collect()
    assert len(spread) == 4
    got = rank_rows(df, by="v", tie_break="id")
    assert got.agg(F.min("rank"), F.max("rank"), F.max("position")).first() == (1, 1, 2000)


@pytest.mark.parametrize("tiles", [4, 100])
def test_tiles_match_ntile(spark, tiles):
    for n in [1, 2, 3, 4, 5, 7, 99, 100, 101, 250]:
        df = spark.range(1, n + 1)
        place = F.col("id")
        expected = [r[0] for r in df.select(F.ntile(tiles).over(Window.orderBy("id")).alias("t")).collect()]
        assert [r[0] for r in df.select(tile(place, F.lit(n), tiles)).orderBy("id").collect()] == expected
        for k in [1, tiles // 2, tiles - tiles // 10]:
            last = max((i + 1 for i, t in enumerate(expected) if t == k), default=None)
            assert df.select(tile_end(k, F.lit(n), tiles)).first()[0] == last


def test_percent_rank_of_a_single_row(spark):
    df = spark.createDataFrame([(1, 1), (1, 3), (3, 4)], "r bigint, n bigint")
    assert [r[0] for r in df.select(percent_rank(F.col("r"), F.col("n"))).collect()] == [0.0, 0.0, 0.667]


@pytest.mark.parametrize("width", [1, 7, 50, 10**6])
def test_previous_value_is_the_same_however_wide_the_blocks(spark, width):
    df = values(spark, 500, 1000, 7)
    df = df.withColumn("v", F.when(F.col("id") % 9 != 0, F.col("v"))).withColumn("g", F.when(F.col("g") != 1, F.col("g")))
    expected = df.select("id", F.lag("v").over(Window.partitionBy("g").orderBy("v", "id")))
    got = previous_value(df, "g", F.floor(F.col("v") / width), ["v", "id"], "before")
    assert rows(got.select("id", "before")) == rows(expected)


def test_numbers_survive_a_second_read(spark):
    """Positions are stored values: reading twice gives the same ones."""
    numbered = rank_rows(spark.range(1000).withColumn("v", F.col("id") % 7), by="v", tie_break="id")
    assert rows(numbered) == rows(numbered)
