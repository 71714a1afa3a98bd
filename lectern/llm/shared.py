"""What the operators share: table access, stored intermediate tables, session settings for Python tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.session import ship_package, work_folder

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Rows of one Arrow batch: documents are long, so a batch of the default size could fill a task's memory.
ROWS_PER_BATCH = "1000"


def prepare(spark: SparkSession) -> None:
    """Give the executors the package and keep Arrow batches of long texts small."""
    ship_package(spark)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", ROWS_PER_BATCH)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def store(df: DataFrame, name: str) -> DataFrame:
    """Write `df` below the shared checkpoint folder and read it back: later jobs start from the files."""
    path = work_folder(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def ascii_lower(column: Column) -> Column:
    """A-Z to lower case, every other character as it is."""
    return F.translate(column, UPPER, LOWER)


def bucket_of(column: Column, n: int) -> Column:
    """crc32 of the value as text, modulo n: the folds of the contracts."""
    return F.pmod(F.crc32(column.cast("string").cast("binary")), F.lit(n))


def pieces(batches: Iterator[pa.RecordBatch], column: str, most: int = 1 << 22) -> Iterator[pa.RecordBatch]:
    """The rows of `batches` in slices of at most `most` bytes in `column`; a longer text is a slice of its own."""
    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False)
        ends = np.cumsum(sizes)
        start = 0
        while start < batch.num_rows:
            before = ends[start - 1] if start else 0
            stop = max(start + 1, int(np.searchsorted(ends, before + most, side="right")))
            yield batch.slice(start, stop - start)
            start = stop
