"""The chained reaction to state changes: one open incident a site, opened and closed by verdicts."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def incidents(changes: DataFrame) -> DataFrame:
    """(site, opened_at, severity, closed_at) of (site, t, state) changes: an incident lasts from the first
    unhealthy change to the next healthy one; its severity is the worst on the way; null while open."""
    order = Window.partitionBy("site").orderBy("t")
    bad = F.col("state") != "healthy"
    begins = bad & F.coalesce(F.lag("state").over(order) == "healthy", F.lit(True))
    numbered = changes.withColumn("begins", begins).withColumn("n", F.sum(F.col("begins").cast("int")).over(order)).where("n > 0")
    return numbered.groupBy("site", "n").agg(
        F.min("t").alias("opened_at"), F.when(F.bool_or(F.col("state") == "down"), "down").otherwise("degraded").alias("severity"), F.min(F.when(F.col("state") == "healthy", F.col("t"))).alias("closed_at")
    ).drop("n")
