"""Streams give what the batch gives, also over a restart."""

from pyspark.sql import functions as F

from gridwright.operators.detector import detect as batch_detect
from gridwright.sources import scene
from gridwright.streaming import detect_stream

SF = "/root/testdata/sf0.001"


def test_detector_stream_equals_batch_over_a_restart(spark, tmp_path):
    samples = scene.metrics6(spark, SF).where("site < 3").cache()
    edges = samples.agg(F.percentile("t", F.lit(0.5))).first()[0]
    source, out, checkpoint = (str(tmp_path / n) for n in ("in", "out", "ck"))
    for part in (samples.where(F.col("t") <= edges), samples.where(F.col("t") > edges)):
        part.coalesce(1).write.mode("append").parquet(source)
        stream = detect_stream.detect(spark.readStream.schema(samples.schema).parquet(source))
        stream.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
    rows = lambda df: sorted((r.site, r.t, r.state, r.changed, round(r.max_z, 9)) for r in df.collect())
    assert rows(spark.read.parquet(out)) == rows(batch_detect(samples))


def test_digest_stream_equals_batch_for_closed_windows(spark, tmp_path):
    samples = scene.metrics6(spark, SF)
    samples.coalesce(1).write.parquet(str(tmp_path / "in"))
    stream = detect_stream.digests(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in")))
    stream.writeStream.format("memory").queryName("digests").outputMode("complete").trigger(availableNow=True).start().awaitTermination()
    want = samples.groupBy("site", (F.floor(F.col("t") / 10) * 10.0).alias("window_s")).agg(F.count("*").alias("samples"))
    assert sorted(map(tuple, spark.table("digests").select("site", "window_s", "samples").collect())) == sorted(map(tuple, want.collect()))


def test_snapshots_reach_the_sink(spark, tmp_path):
    samples = scene.metrics6(spark, SF).where("site < 2")
    samples.coalesce(1).write.parquet(str(tmp_path / "in"))
    frames = []
    verdicts = detect_stream.detect(spark.readStream.schema(samples.schema).parquet(str(tmp_path / "in")))
    detect_stream.snapshots(verdicts, lambda df, n: frames.append((n, df.count())), str(tmp_path / "ck")).awaitTermination()
    assert frames and frames[0][1] == 2
