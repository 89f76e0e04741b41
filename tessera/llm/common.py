"""Shared helpers of the training-data operators.

Input contract of all operators: the id and text columns are named by
parameters; every other column is dropped before any internal name is added,
so extra or clashing columns cannot interfere. A null text is the empty text.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage, ship_by_value

#: Rows per Arrow batch handed to Python workers; with Spark's own byte limit
#: (``spark.sql.execution.arrow.maxBytesPerBatch``) it bounds a worker's memory.
ARROW_ROWS = 1000


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_of(col: str) -> Column:
    """The text as a string, null as empty."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def id_text(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The two columns an operator reads, under fixed names."""
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), text_of(text_col).alias("text"))


def map_batches(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | None],
                schema: str) -> DataFrame:
    """``mapInArrow`` with one output batch per input batch (None: nothing)."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                if out is not None and out.num_rows:
                    yield out
    return map_partitions(df, run, schema)


def map_partitions(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` over a partition's batches, with small batches."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return df.mapInArrow(fn, schema)


def share(spark: SparkSession, value):
    """Broadcast of ``value`` as bytes that hold its class too, so workers need not import this package."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def held(shared):
    """The value of a ``share``, in a worker."""
    return pickle.loads(shared.value)


def free_name(columns: list[str], name: str) -> str:
    """``name``, lengthened until it is none of the columns."""
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def hex64(col: Column) -> Column:
    """A long as 16 lowercase hex digits."""
    return F.lower(F.lpad(F.hex(col), 16, "0"))


__all__ = ["ARROW_ROWS", "cut_lineage", "free_name", "held", "hex64", "id_text", "map_batches", "map_partitions",
           "share", "ship_by_value", "table", "text_of"]

ship_by_value(__name__)
