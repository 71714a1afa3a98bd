"""Ordered scans that stay parallel when one key holds most of the rows.

Each scan runs inside blocks of an order column first; one summary row per block carries the state
across blocks. The window over a whole key then only sees summaries.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _block_windows(keys: Sequence[str], order: Sequence[str]):
    inner = Window.partitionBy(*keys, "_block").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    return inner, before


def fill_forward(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, columns: Sequence[str]
) -> DataFrame:
    """Replace nulls of `columns` by the last value before them in `order`.

    `block` must not decrease along `order`.
    """
    inner, before = _block_windows(keys, order)
    rows = df.withColumn("_block", block)
    filled = rows.withColumns({c: F.last(c, ignorenulls=True).over(inner) for c in columns})
    position = F.struct(*order)
    carried = rows.groupBy(*keys, "_block").agg(
        *[F.max_by(c, F.when(F.col(c).isNotNull(), position)).alias(f"_{c}") for c in columns]
    )
    carried = carried.withColumns({f"_{c}": F.last(f"_{c}", ignorenulls=True).over(before) for c in columns})
    out = filled.join(carried, [*keys, "_block"])
    return out.withColumns({c: F.coalesce(c, f"_{c}") for c in columns}).drop("_block", *[f"_{c}" for c in columns])


def running_sum(
    df: DataFrame, keys: Sequence[str], order: Sequence[str], block: Column, value: Column, name: str
) -> DataFrame:
    """Sum of `value` up to and including each row (1-based row numbers for a value of 1)."""
    inner, before = _block_windows(keys, order)
    rows = df.withColumn("_block", block).withColumn("_value", value)
    totals = rows.groupBy(*keys, "_block").agg(F.sum("_value").alias("_total"))
    totals = totals.withColumn("_before", F.coalesce(F.sum("_total").over(before), F.lit(0))).drop("_total")
    inside = rows.withColumn(name, F.sum("_value").over(inner.rowsBetween(Window.unboundedPreceding, 0)))
    out = inside.join(totals, [*keys, "_block"])
    return out.withColumn(name, F.col(name) + F.col("_before")).drop("_block", "_value", "_before")
