"""Live metrics: of a batch and a stream, without a second read."""

from __future__ import annotations

import shutil

import pytest
from pyspark.sql import functions as F

from tessera.operators import metrics
from tessera.streaming import live


def test_a_batch_is_observed_as_it_is_written(spark, tmp_path):
    source, out, path = (str(tmp_path / x) for x in ("in", "out", "metrics"))
    spark.range(100).write.parquet(source)
    rows, finish = live.observed(spark.read.parquet(source), "load", 3, path, n=F.count(F.lit(1)), top=F.max("id"), none=F.max(F.when(F.col("id") > 500, 1)))
    rows.where("id < 50").write.parquet(out)
    shutil.rmtree(source)  # so nothing can read it again
    assert finish() == {"n": 100, "top": 99, "none": None}
    assert {tuple(r) for r in metrics.recorded(spark, path).collect()} == {(3, "load/n", 100.0), (3, "load/top", 99.0)}


def test_a_stream_is_observed_batch_by_batch(spark, tmp_path):
    source, path = str(tmp_path / "in"), str(tmp_path / "metrics")
    spark.range(100).repartition(4).write.parquet(source)
    stream = spark.readStream.schema("id long").option("maxFilesPerTrigger", 1).parquet(source).observe("s", F.count(F.lit(1)).alias("n"), F.max("id").alias("top"))
    with live.Recorder(spark, "s", path) as recorder:
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        shutil.rmtree(source)
        recorder.wait(str(q.runId))
    got = metrics.recorded(spark, path)
    assert got.where("key = 's/n'").count() == 4
    assert {tuple(r) for r in live.of_steps(got, ["s/n"], ["s/top"]).collect()} == {("s/n", 100.0), ("s/top", 99.0)}


def test_what_fails_to_be_recorded_is_told(spark, tmp_path):
    (tmp_path / "file").write_text("in the way")
    stream = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 5).load().observe("f", F.count(F.lit(1)).alias("n"))
    with live.Recorder(spark, "f", str(tmp_path / "file" / "metrics")) as recorder:
        q = stream.writeStream.format("noop").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
        q.awaitTermination()
        with pytest.raises(Exception, match="file"):
            recorder.wait(str(q.runId))
    with pytest.raises(TimeoutError):
        recorder.wait("no such run", 0.1)
