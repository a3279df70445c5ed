"""Small Spark helpers shared by the operators."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import shelfwise
from shelfwise.session import shared_folder

_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Send this package's code to the executors, once per application, as ``--py-files`` would."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    top = os.path.dirname(os.path.abspath(shelfwise.__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="shelfwise-code-"), "shelfwise.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as archive:
        for folder, _, names in os.walk(top):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    archive.write(full, os.path.relpath(full, os.path.dirname(top)))
    context.addPyFile(path)
    _shipped.add(context.applicationId)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``mapInArrow`` with this package's code on the executors."""
    ship(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


def stored(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet into the cluster's shared folder and read it back.

    Used where a result is needed several times: it is computed once, readers survive lost executors, and the planner
    knows its true size.
    """
    path = f"{shared_folder(df.sparkSession)}/{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def texts(docs: DataFrame) -> DataFrame:
    """Only what the operators read, so that further columns of any name never matter."""
    return docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.col("text").cast("string").alias("text"))


def free_name(df: DataFrame, name: str) -> str:
    """A column name that ``df`` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def table(schema: pa.Schema, *columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, type=f.type) for c, f in zip(columns, schema)], schema=schema)


def chunks(batch: pa.RecordBatch, most_bytes: int) -> Iterator[pa.RecordBatch]:
    """Zero-copy pieces of a batch whose texts take about ``most_bytes``, one row at least."""
    from shelfwise.llm.words import slices, text_buffers

    _, offsets = text_buffers(batch.column("text"))
    for low, high in slices(offsets, most_bytes):
        yield batch.slice(low, high - low)
