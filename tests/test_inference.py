"""Types of files that no schema describes."""

import pytest
from conftest import rows

from shelfwise.operators import cleaning
from shelfwise.sources.files import read_csv_inferred
from shelfwise.sources.inference import infer_types, typed


def columns(spark, **values):
    longest = max(map(len, values.values()))
    data = [tuple(v[i] if i < len(v) else None for v in values.values()) for i in range(longest)]
    return spark.createDataFrame(data, ", ".join(f"{c} string" for c in values))


def test_the_least_type_that_all_values_fit(spark):
    df = columns(
        spark, flag=["True", "false", "NA"], mixed_flag=["True", "1"], whole=["1", " -2 ", "+3", "", "007"],
        number=["1", "2.5", "1e3", ".5", "-inf"], huge=["1", "99999999999999999999"], too_huge=["9" * 39, "x"], far=["9" * 39],
        suffix=["1d", "2"], word=["1", "a"], nothing=["NaN", None, "null"], day=["2024-01-31", "2024-02-29"], noday=["2024-02-30"],
        moment=["2024-01-31", "2024-01-31 10:00:00", "2024-01-31T10:00:00.25"])
    plain = {f.name: f.dataType.simpleString() for f in infer_types(df)}
    assert plain == dict(
        flag="boolean", mixed_flag="string", whole="bigint", number="double", huge="decimal(38,0)", too_huge="string", far="double",
        suffix="string", word="string", nothing="string", day="string", noday="string", moment="string")
    times = {f.name: f.dataType.simpleString() for f in infer_types(df, ["day", "noday", "moment", "whole"], times=True)}
    assert times == dict(day="date", noday="string", moment="timestamp_ntz", whole="bigint")
    values = typed(df, infer_types(df)).select("flag", "whole", "number").collect()
    assert [tuple(r) for r in values] == [
        (True, 1, 1.0), (False, -2, 2.5), (None, 3, 1000.0), (None, None, 0.5), (None, 7, float("-inf"))]


def test_one_value_among_many_parts_decides(spark, tmp_path):
    data = [(str(i), str(i), "1") for i in range(5_000)]
    data[4_321] = ("x", "0.5", "1")
    df = spark.createDataFrame(data, "a string, b string, `c d` string").repartition(7)
    df.write.csv(str(tmp_path / "t.csv"), header=True)
    found = read_csv_inferred(spark, str(tmp_path / "t.csv"))
    assert dict(found.dtypes) == {"a": "string", "b": "double", "c d": "bigint"}
    assert found.filter("a = 'x'").first()["b"] == 0.5


def test_all_columns_take_one_pass(spark):
    df = columns(spark, a=["1"], b=["x"])
    seen = spark.sparkContext.accumulator(0)
    counted = df.rdd.map(lambda r: (seen.add(1), r)[1]).toDF(df.schema)
    infer_types(counted)
    assert seen.value == 1
    assert infer_types(df.limit(0)).simpleString() == "struct<a:string,b:string>" and not infer_types(df, [])


@pytest.mark.parametrize("name", ["surprise", "cities"])
def test_the_cleaner_types_what_it_does_not_know(spark, tmp_path, name):
    text = columns(spark, city_id=["1", "2", "2"], city_name=[" A ", "B", "B"], score=["1.5", "NA", "NA"], seen=["true", "False", "False"])
    text.coalesce(1).write.csv(f"{tmp_path}/in/{name}.csv", header=True, ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False)
    report = cleaning.clean_csv_folder(spark, f"{tmp_path}/in", f"{tmp_path}/out")
    assert rows(report) == [(name, 3, 1, 0, 0, 2)]
    found = spark.read.parquet(f"{tmp_path}/out/{name}")
    assert dict(found.dtypes)["score"] == "double" and dict(found.dtypes)["seen"] == "boolean" and dict(found.dtypes)["city_id"] == "bigint"
    assert [r[0] for r in rows(found.select("city_name"))] == ([" A ", "B"] if name == "surprise" else ["A", "B"])
