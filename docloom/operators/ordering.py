"""Places of rows in a total order, without one task that sees them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.files import Scratch

_ROW_BITS = 33  # monotonically_increasing_id: task above, row within the task below


def ranked(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """Adds each row's place, from 1, in ``order``.

    Rows are range-partitioned, sorted and written with their place in their
    task; only the tasks' row counts are then summed in order.
    """
    scratch = Scratch(df.sparkSession, "ranked")
    rows = scratch.save(df.orderBy(*order).withColumn("_at", F.monotonically_increasing_id()))
    counts = rows.groupBy(F.shiftright("_at", _ROW_BITS).alias("_task")).agg(F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.orderBy("_task").rowsBetween(Window.unboundedPreceding, -1))
    counts = counts.select("_task", F.coalesce(before, F.lit(0)).alias("_before"))
    out = rows.join(counts, F.shiftright("_at", _ROW_BITS) == F.col("_task"))
    place = F.col("_before") + F.col("_at").bitwiseAND(F.lit((1 << _ROW_BITS) - 1)) + 1
    return out.withColumn(name, place).drop("_at", "_task", "_before")
