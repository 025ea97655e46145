"""Structured Streaming twins: the gated detector, digests, and frame snapshots."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from gridwright.operators.detector import Detector
from gridwright.schema import METRICS


def detect(samples: DataFrame, confirm: Callable[[list[float]], bool] | None = None) -> DataFrame:
    """Verdicts of a stream (site, t, six metrics, repaired?); a site's detector is its state, ``confirm`` its second opinion.

    A batch is put in order of t first. A row whose ``repaired`` is true makes the detector relearn
    before it sees the sample. Restarting from a checkpoint goes on as if never stopped.
    """
    if "repaired" not in samples.columns:
        samples = samples.withColumn("repaired", F.lit(False))

    def run(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        detector = pickle.loads(state.get[0]) if state.exists else Detector()
        frame = pd.concat(list(frames)).sort_values("t", kind="stable")
        said = []
        for x, repaired in zip(frame[list(METRICS)].to_numpy(float), frame["repaired"], strict=True):
            if repaired:
                detector.relearn()
            said.append(detector.observe(x.tolist(), confirm))
        state.update((pickle.dumps(detector),))
        out = pd.DataFrame(said, columns=["state", "changed", "max_z", "distance"])
        yield pd.concat([frame[["site", "t"]].reset_index(drop=True), out], axis=1)

    return samples.groupBy("site").applyInPandasWithState(
        run, "site long, t double, state string, changed boolean, max_z double, distance double", "detector binary", "append", GroupStateTimeout.NoTimeout
    )


def digests(samples: DataFrame, seconds: int = 10, late: str = "1 minute") -> DataFrame:
    """The last sample of each window and how many there were; windows close behind the watermark."""
    stamped = samples.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return stamped.groupBy("site", F.window("ts", f"{seconds} seconds").alias("w")).agg(F.max("t").alias("last_t"), F.max_by("throughput_mbps", "t").alias("throughput_mbps"), F.count("*").alias("samples")).select(
        "site", F.unix_timestamp("w.start").cast("double").alias("window_s"), "last_t", "throughput_mbps", "samples"
    )


def alarm_counts(alarms: DataFrame, retention: str = "30 minutes", late: str = "10 minutes") -> DataFrame:
    """Alarms and sites in sliding retention windows."""
    stamped = alarms.withColumn("ts", F.timestamp_seconds("t")).withWatermark("ts", late)
    return stamped.groupBy(F.window("ts", retention, "10 minutes").alias("w")).agg(F.count("*").alias("alarms"), F.approx_count_distinct("site").alias("sites")).select(F.col("w.start").alias("start"), "alarms", "sites")


def once_each(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """A replayed log without repeats of an id within the watermark."""
    return events.withColumn("at", F.timestamp_seconds("t")).withWatermark("at", late).dropDuplicatesWithinWatermark(["event_id"])


def snapshots(verdicts: DataFrame, sink: Callable[[DataFrame, int], None], checkpoint: str):  # noqa: ANN201
    """Each micro-batch's latest verdict by site as a JSON frame, given to ``sink``; runs over what is there, then stops."""

    def frame(batch: DataFrame, number: int) -> None:
        latest = batch.groupBy("site").agg(F.max_by(F.struct("t", "state", "changed"), "t").alias("v"))
        sink(latest.select("site", F.to_json("v").alias("frame")), number)

    return verdicts.writeStream.foreachBatch(frame).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
