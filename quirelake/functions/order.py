"""Places and running totals in a total order, by ranges: no task holds a group or the table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import written


def ahead(df: DataFrame, order: list[Column], by: tuple[str, ...] = (), weight: str | None = None, name: str = "ahead") -> DataFrame:
    """df with `name`: how many rows (or how much of `weight`, a column of whole numbers) come before each in `order`, within each value of `by` if given.

    Rows are dealt out by ranges of by and order, sorted there, and written; each range then adds what the ranges before it hold, a row for each range and
    value of `by` in it. So one group with all rows lies in many tasks. Rows that are equal in the whole order lie in one: sum those before, as weights.
    Null values of `by` are a group."""
    keys = [F.col(c) for c in by]
    rows = df.repartitionByRange(*keys, *order) if keys or order else df
    rows = written(rows.sortWithinPartitions(*keys, *order).withColumn("__at", F.monotonically_increasing_id()), "ranges")
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    sums = rows.groupBy(*by, "__part").agg(F.sum(weight or F.lit(1)).alias("__n"), F.min("__at").alias("__first"))
    earlier = Window.partitionBy(*by).orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.withColumn("__ahead", F.coalesce(F.sum("__n").over(earlier), F.lit(0))).drop("__n")
    sums = sums.withColumnsRenamed({c: f"__{c}" for c in by} | {"__part": "__of"})
    same = F.col("__part") == F.col("__of")
    for c in by:
        same = same & F.col(c).eqNullSafe(F.col(f"__{c}"))
    if weight:
        own = F.coalesce(F.sum(weight).over(Window.partitionBy(*by, "__part").orderBy("__at").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        rows = rows.withColumn("__own", own)
    out = rows.join(sums, same)
    return out.select(*df.columns, (F.col("__ahead") + (F.col("__own") if weight else F.col("__at") - F.col("__first"))).cast("long").alias(name))
