"""Places in several orders of a table stored once, against ordinary windows."""

import datetime as dt
import random
from decimal import Decimal

import pytest
from conftest import rows
from pyspark.sql import Window
from pyspark.sql import functions as F

from shelfwise.functions.places import Places, _Splitters

SCHEMA = "id bigint, many bigint, tied int, money decimal(22,2), moment timestamp_ntz, share double"


def table(spark, n, seed, missing=0.1):
    rng = random.Random(seed)

    def some(value):
        return None if rng.random() < missing else value

    return spark.createDataFrame([
        (i, some(rng.randint(-10**9, 10**9)), some(0 if rng.random() < 0.4 else rng.randint(1, 5)),
         some(Decimal(rng.randint(0, 500)) / 100), some(dt.datetime(2024, 1, 1) + dt.timedelta(microseconds=rng.randint(0, 10**13))),
         some(rng.randint(0, 30) * 100.0 / 7)) for i in rng.sample(range(10 * n + 1), n)
    ], SCHEMA)


@pytest.mark.parametrize("n, blocks", [(0, 4), (1, 4), (9, 4), (700, 4), (700, 2), (2_000, 60)])
def test_places_match_windows(spark, n, blocks):
    old = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", blocks)
    try:
        df = table(spark, n, n + blocks)
        by = ["many", "tied", "money", "moment", "share"]
        places = Places(df, "id", by)
        assert rows(places.table) == rows(df)
        for k, column in enumerate(by):
            value = F.col(column).desc_nulls_last() if k % 2 else F.col(column).asc_nulls_last()
            total = Window.orderBy(value).rangeBetween(Window.unboundedPreceding, 0)
            expected = df.select(
                "id", F.row_number().over(Window.orderBy(value, "id")), F.rank().over(Window.orderBy(value)),
                F.count("*").over(Window.partitionBy()), F.sum("tied").over(total), F.sum("tied").over(Window.partitionBy()))
            got = places.ordered(column, descending=bool(k % 2), total="tied").select("id", "position", "rank", "rows", "running", "all")
            assert [r[:4] for r in rows(got)] == [r[:4] for r in rows(expected)]
            assert [(r[4] or 0, r[5]) for r in rows(got)] == [(r[4] or 0, r[5]) for r in rows(expected)]
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", old)


def test_a_tie_is_spread_over_blocks(spark):
    """One value or no value in most rows: no block holds more than a good part of them, however the key is tied."""
    df = spark.range(4_000).select("id", F.when(F.col("id") % 10 > 0, 7).otherwise(F.col("id")).alias("v"), F.lit(None).cast("int").alias("none"))
    places = Places(df, "id", ["v", "none"])
    for by in ("v", "none"):
        sizes = [r["count"] for r in places._blocked(by, False).groupBy("_block").count().collect()]
        assert sum(sizes) == 4_000 and max(sizes) <= 2_000, sizes
    assert places.ordered("none").agg(F.min("rank"), F.max("rank"), F.max("position")).first() == (1, 1, 4_000)


def test_splitters_know_ties():
    assert _Splitters.of(["1", "2", "2", "3"], False) == _Splitters(["1", "2", "3"], [1, 2, 1])
    assert _Splitters.of(["1", "2", "2", "3"], True) == _Splitters(["3", "2", "1"], [1, 2, 1])
    assert _Splitters.of([], True) == _Splitters([], [])


def test_the_table_is_stored_once_and_read_lazily(spark):
    df = table(spark, 300, 5).repartition(3)
    spark.sparkContext.setJobGroup("places", "built")
    try:
        places = Places(df.groupBy("id").agg(*[F.max(c).alias(c) for c in ["many", "tied", "money"]]), "id", ["many", "tied", "money"])
        for by in ["many", "tied", "money"]:
            places.ordered(by)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("places")) <= 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_rfm_is_built_in_three_jobs(spark):
    from test_operators import order, tables

    from shelfwise.operators import customer

    t = tables(spark, customers=[dict(customer_id=c, full_name=f"N{c}") for c in range(9)],
               orders=[order(k, customer_id=k % 11, when=f"2024-01-{1 + k % 28:02d} 10:00:00") for k in range(60)])
    spark.sparkContext.setJobGroup("rfm", "built")
    try:
        found = customer.rfm(t)
        assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("rfm")) <= 3
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert found.count() == 9
