"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# Functions for executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

#: text handled at once inside a task
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with the value computed once, however often the body names it, inside lambdas too."""
    return F.transform(F.array(value), body)[0]


def index(last: Column) -> Column:
    """0 … last, empty where last is negative."""
    return F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.array().cast("array<int>"))


def whole_text(column: str) -> Column:
    """The text, empty in place of null."""
    return F.coalesce(F.col(column), F.lit(""))


def slices(batches: Iterator[pa.RecordBatch], column: str = "text") -> Iterator[pa.RecordBatch]:
    """The batches cut into pieces of about SLICE_BYTES of the given text column; one row is never cut."""
    for batch in batches:
        values = batch.column(column)
        sizes = np.nan_to_num(np.asarray(pa.compute.binary_length(values).to_numpy(zero_copy_only=False), dtype="float64"))
        piece = (np.cumsum(sizes) // SLICE_BYTES).astype(np.int64)
        starts = np.flatnonzero(np.diff(piece, prepend=-1)) if len(piece) else []
        for start, end in zip(starts, [*starts[1:], len(piece)]):
            yield batch.slice(start, end - start)
