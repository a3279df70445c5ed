"""Types of text columns that no schema describes, from one full pass over all columns.

Types form a lattice: flags, whole numbers below numbers, days below moments, and text above all.  A column's type is the least
one that all of its values fit, so every column needs only how many values it has and how many fit each type: sums that
combine within each task, one small row for the whole table, and no sample that the next file proves wrong.

Markers of missing values fit every type, and a column without a value stays text.  Whole numbers that do not fit 64 bits make
a decimal column of up to 38 digits, beyond that text.  Days and moments are recognised in ISO layout only, and only on
request: many texts look like dates by chance.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Text that stands for a missing value in CSV files.
MISSING_MARKERS = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND", "1.#QNAN", "<NA>", "N/A", "NA",
    "NULL", "NaN", "None", "n/a", "nan", "null",
]

_FLAG = r"^\s*([Tt]rue|TRUE|[Ff]alse|FALSE)\s*$"
_WHOLE = r"^\s*[+-]?[0-9]+\s*$"
_NUMBER = r"^\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*$"
_INFINITE = r"^\s*[+-]?([Ii]nf|[Ii]nfinity|INF|INFINITY)\s*$"
_DAY = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}\s*$"
_MOMENT = r"^\s*[0-9]{4}-[0-9]{2}-[0-9]{2}([ T][0-9]{2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?\s*$"

HUGE = T.DecimalType(38, 0)


def present(text: Column) -> Column:
    """The text, or NULL where it stands for a missing value."""
    return F.when(~text.isin(MISSING_MARKERS), text)


def as_type(text: Column, kind: T.DataType) -> Column:
    """A present text as a type that it fits, NULL if it does not."""
    if isinstance(kind, T.StringType):
        return text
    if isinstance(kind, T.BooleanType):
        return F.when(text.rlike(_FLAG), F.lower(F.trim(text)) == "true")
    if isinstance(kind, (T.LongType, T.DecimalType)):
        return F.when(text.rlike(_WHOLE), F.trim(text).try_cast(kind))
    if isinstance(kind, T.DoubleType):
        infinite = F.when(F.trim(text).startswith("-"), float("-inf")).otherwise(float("inf"))
        return F.when(text.rlike(_INFINITE), infinite).when(text.rlike(_NUMBER), F.trim(text).try_cast(kind))
    return F.when(text.rlike(_DAY if isinstance(kind, T.DateType) else _MOMENT), F.trim(text).try_cast(kind))


#: From the least type up; those of one branch one after the other.
_PLAIN: list[T.DataType] = [T.BooleanType(), T.LongType(), HUGE, T.DoubleType()]
_TIMES: list[T.DataType] = [T.DateType(), T.TimestampNTZType()]


def infer_types(text: DataFrame, columns: list[str] | None = None, times: bool = False) -> T.StructType:
    """The least type of each of the text columns: one pass, one row to the driver."""
    names = text.columns if columns is None else columns
    kinds = [*_PLAIN, *(_TIMES if times else [])]
    if not names:
        return T.StructType([])
    counts = []
    for place, name in enumerate(names):
        value = present(F.col(name))
        counts.append(F.count(value).alias(f"n{place}"))
        counts += [F.count(as_type(value, kind)).alias(f"n{place}_{k}") for k, kind in enumerate(kinds)]
    row = text.agg(*counts).first()

    def least(place: int) -> T.DataType:
        values = row[f"n{place}"]
        fitting = (kind for k, kind in enumerate(kinds) if row[f"n{place}_{k}"] == values)
        found = next(fitting, T.StringType()) if values else T.StringType()
        return found

    return T.StructType([T.StructField(name, least(place), True) for place, name in enumerate(names)])


def typed(text: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns as their types, and markers of missing values as NULL; columns that the schema lacks stay as they are."""
    kinds = {f.name: f.dataType for f in schema}
    return text.select(*[as_type(present(F.col(c)), kinds[c]).alias(c) if c in kinds else F.col(c) for c in text.columns])
