"""Learned models: risk, heights, anomaly reconstruction, hashed attributes, greedy placement."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import pandas as pd
from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridwright.schema import HIGH_SHARE, MEDIUM_SHARE, RISK_FEATURES


def risk_model(fleet: DataFrame, features: tuple[str, ...] = RISK_FEATURES) -> GBTClassificationModel:
    """Boosted trees over the contract's features of ``fleet`` (site, features, failed), every fourth site by hash held out."""
    data = VectorAssembler(inputCols=list(features), outputCol="v").transform(fleet.withColumn("label", F.col("failed").cast("double")))
    return GBTClassifier(featuresCol="v", labelCol="label", maxIter=10, maxDepth=3, seed=7).fit(data.where(~held_out()))


def held_out() -> Column:
    return F.pmod(F.xxhash64("site"), F.lit(4)) == 0


def risk_scores(fleet: DataFrame, model: GBTClassificationModel, features: tuple[str, ...] = RISK_FEATURES) -> DataFrame:
    """(site, p, held_out): the chance of failure in seven days."""
    data = VectorAssembler(inputCols=list(features), outputCol="v").transform(fleet)
    return model.transform(data).select("site", vector_to_array("probability")[1].alias("p"), held_out().alias("held_out"))


def banded(scores: DataFrame, p: str = "p", high: float = HIGH_SHARE, medium: float = MEDIUM_SHARE) -> DataFrame:
    """``scores`` with band: by the fleet's own quantiles of ``p``."""
    cuts = scores.agg(F.percentile(p, F.lit(high)).alias("_high"), F.percentile(p, F.lit(medium)).alias("_medium"))
    band = F.when(F.col(p) >= F.col("_high"), "high").when(F.col(p) >= F.col("_medium"), "medium").otherwise("low")
    return scores.crossJoin(F.broadcast(cuts)).withColumn("band", band).drop("_high", "_medium")


def daily_hazard() -> Column:
    """The chance of failure in a day: a small base rate times the stressors of a site's attributes and weather."""
    c = F.col
    stressors = [
        F.pow(F.lit(2.0), (c("peak_temperature_c") - 40) / 10),  # heat doubles it every 10 degrees
        F.pow(c("recent_thermal_cycles") / 100, F.lit(0.6)) * 0.6 + 1,
        F.pow(c("asset_age_years") / 12, F.lit(1.9)) + 1,
        c("days_since_maintenance") / (c("days_since_maintenance") + 240) * 0.9 + 1,
        c("vswr_trend_30d") * 3.4 + 1,
        c("lightning_density_per_km2") * 0.05 * (c("antenna_height_m") / 100) * (c("elevation_m") / 200 + 1) + 1,
        c("rainfall_intensity_mm_hr") * 0.010 * (c("humidity_pct") / 100) * (c("asset_age_years") / 12) + 1,
        c("terrain_slope_deg") * 0.020 + 1,
        c("encroachment_risk") * 0.35 + 1,
    ]
    out = F.lit(2.0e-4)
    for x in stressors:
        out = out * x
    return out


def imputed_heights(features: DataFrame) -> DataFrame:
    """(bid, imputed): a forest on log heights, clipped to plausible ones."""
    cols = ["log_area", "log_perimeter", "compactness", "neighbours", "mean_height", "idw_height"]
    data = VectorAssembler(inputCols=cols, outputCol="v").transform(features.withColumn("label", F.log1p("height")))
    model = RandomForestRegressor(featuresCol="v", labelCol="label", numTrees=20, maxDepth=6, seed=7).fit(data.where("bid % 3 <> 0"))
    return model.transform(data).select("bid", F.round(F.least(F.lit(460.0), F.greatest(F.lit(3.0), F.expm1("prediction"))), 3).alias("imputed"))


def stable_unit(text: str, salt: str) -> float:
    """A value in [0, 1) from a text, the same everywhere."""
    return int.from_bytes(hashlib.blake2b(f"{salt}:{text}".encode(), digest_size=4).digest(), "big") / 2**32


def hashed_profile(names: DataFrame) -> DataFrame:
    """(site, asset_age_years, days_since_maintenance, load_factor) from BLAKE2b of the attribute and the name; not a Spark function."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            yield pd.DataFrame(
                {
                    "site": f["site"],
                    "asset_age_years": [round(1 + 14 * stable_unit(n, "age"), 2) for n in f["name"]],
                    "days_since_maintenance": [round(10 + 355 * stable_unit(n, "maint"), 1) for n in f["name"]],
                    "load_factor": [round(0.35 + 0.6 * stable_unit(n, "load"), 3) for n in f["name"]],
                }
            )

    return names.mapInPandas(run, "site long, asset_age_years double, days_since_maintenance double, load_factor double")


def placed(buildings: DataFrame, a_district: int = 3, separation: float = 400.0, district_m: float = 2000.0) -> DataFrame:
    """(district, turn, bid, score): greedy choice by height * ln(1 + area), separation relaxed by 0.8 when none fits."""

    def choose(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["score", "bid"], ascending=[False, True], kind="stable")
        rows = list(frame.itertuples(index=False))
        taken: list = []
        apart = separation
        while len(taken) < min(a_district, len(rows)):
            fit = next((r for r in rows if r not in taken and all(math.hypot(r.cx - o.cx, r.cy - o.cy) >= apart for o in taken)), None)
            if fit is None:
                apart *= 0.8
            else:
                taken.append(fit)
        return pd.DataFrame({"district": [r.district for r in taken], "turn": range(1, len(taken) + 1), "bid": [r.bid for r in taken], "score": [round(r.score, 6) for r in taken]})

    scored = buildings.select("bid", "cx", "cy", (F.col("height") * F.log1p(F.col("half") ** 2 * 4)).alias("score"), F.concat_ws(":", F.floor(F.col("cx") / district_m), F.floor(F.col("cy") / district_m)).alias("district"))
    return scored.groupBy("district").applyInPandas(choose, "district string, turn long, bid long, score double")
