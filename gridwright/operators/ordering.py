"""Global orders and running sums without a window over all rows in one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridwright.operators.graph import settled


def _sorted(df: DataFrame, by: list[Column | str]) -> DataFrame:
    """``df`` in the order of ``by``, dealt by ranges and written, with its part (_part) and place in it (_at)."""
    number = F.monotonically_increasing_id()
    return settled(df.orderBy(*by).withColumn("_n", number)).withColumn("_part", F.shiftright("_n", 33)).withColumn("_at", F.col("_n").bitwiseAND(F.lit((1 << 33) - 1)))


def ordinal(df: DataFrame, by: list[Column | str], name: str) -> DataFrame:
    """``df`` with its place, from 1, in the order of ``by``, which should tell rows apart.

    Rows are sorted by ranges; a range's rows are numbered behind those of the ranges before, whose
    counts (one row a range) are the only thing that meets in one place.
    """
    parts = _sorted(df, by)
    ahead = F.coalesce(F.sum("_rows").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = parts.groupBy("_part").agg(F.count("*").alias("_rows")).withColumn("_ahead", ahead).drop("_rows")
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_ahead") + F.col("_at") + 1).drop("_n", "_part", "_at", "_ahead")


def running(df: DataFrame, by: list[Column | str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` up to and with each row in the order of ``by``; as in ``ordinal``, range by range."""
    parts = _sorted(df, by)
    ahead = F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    before = parts.groupBy("_part").agg(F.sum(value).alias("_sum")).withColumn("_ahead", ahead).drop("_sum")
    inside = F.sum(value).over(Window.partitionBy("_part").orderBy("_at").rowsBetween(Window.unboundedPreceding, 0))
    return parts.join(F.broadcast(before), "_part").withColumn(name, F.col("_ahead") + inside).drop("_n", "_part", "_at", "_ahead")
