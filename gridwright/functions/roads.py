"""Column expressions of roads."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from gridwright.schema import DEFAULT_SPEED_KMH, POSTED_KMH, SPEED_KMH


def speed_kmh(posted: Column, highway: Column) -> Column:
    """The posted speed, if there is a plausible one in km/h or any in mph, else that of the road's class."""
    text = F.trim(F.replace(F.lower(posted), F.lit("km/h"), F.lit("")))
    miles = F.trim(F.replace(text, F.lit("mph"), F.lit(""))).try_cast("double") * 1.609
    plain = text.try_cast("double")
    known = F.when(F.contains(text, F.lit("mph")), miles).when(plain.between(*POSTED_KMH), plain)
    by_class = F.create_map(*[F.lit(x) for kv in SPEED_KMH.items() for x in kv])
    return F.coalesce(known, by_class[highway], F.lit(DEFAULT_SPEED_KMH))
