"""Helpers of the training-data operators."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

#: Bytes of text or ids that a Python worker looks at together.
SLICE_BYTES = 8_000_000
SLICE_ROWS = 8192


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def slices(batches: Iterator[pa.RecordBatch], col: int, most: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut batches so that column ``col`` holds about ``most`` bytes; one row is never cut."""
    for batch in batches:
        n = batch.num_rows
        if n == 0:
            continue
        step = max(1, min(SLICE_ROWS, n * most // max(1, batch.column(col).nbytes)))
        for at in range(0, n, step):
            yield batch.slice(at, step)


def arrow_rows(first: pa.Array, rest: list[pa.Array], names: list[str]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([first, *rest], names)


def crc_mod(id_col: str, n: int) -> Column:
    """crc32 of the id as text, modulo n; -1 for a null id."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % n, F.lit(-1))


def with_number(rows: DataFrame, text_col: str, name: str, fn: Callable[[pa.Array], np.ndarray]) -> DataFrame:
    """All rows and columns, and a double made from the texts in bounded slices."""
    at = rows.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, at):
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(fn(batch.column(at)), pa.float64())], [*batch.schema.names, name])

    schema = StructType([*rows.schema.fields, StructField(name, DoubleType())])
    return rows.mapInArrow(run, schema)
