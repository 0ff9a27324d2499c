"""Metrics of a query while it runs, batch or stream, without reading its input again.

They are observed on the rows that pass and appended to a run's metrics table
``(step, key, value)``, the one of ``operators.metrics.record``; what watches
a run reads that table.
"""

from __future__ import annotations

import threading
from collections.abc import Callable, Mapping

from pyspark.sql import Column, DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.listener import StreamingQueryListener

from tessera.operators import metrics


def _append(spark: SparkSession, name: str, step: int, values: Mapping[str, object], path: str) -> None:
    """Values that are null, as those of no rows, aren't recorded."""
    rows = [(step, f"{name}/{k}", float(v)) for k, v in values.items() if v is not None]
    if rows:
        metrics.record(spark.createDataFrame(rows, "step long, key string, value double").coalesce(1), path)


def observed(rows: DataFrame, name: str, step: int, path: str, **values: Column) -> tuple[DataFrame, Callable[[], dict]]:
    """Rows to be written or counted, and a function that records the aggregates ``values`` of those that passed.

    It waits for the first action over the rows and gives what it records;
    actions after the first are not observed.
    """
    seen = Observation(name)
    out = rows.observe(seen, *[v.alias(k) for k, v in values.items()])

    def finish() -> dict:
        got = seen.get
        _append(rows.sparkSession, name, step, got, path)
        return got

    return out, finish


class Recorder(StreamingQueryListener):
    """Appends what streams observe under ``name``, batch by batch, while they run.

    A stream's rows are observed by ``rows.observe(name, ...)``. A step is a
    batch of the stream. A batch that is run again after a failure is recorded
    again: ``operators.metrics.recorded`` takes repeated records as one.
    A failure to record doesn't stop the stream; it is raised by :meth:`wait`.
    """

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path
        self.ended: dict[str, str | None] = {}
        self.failed: Exception | None = None
        self.changed = threading.Condition()

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        row: Row | None = event.progress.observedMetrics.get(self.name)
        if row is not None:
            try:
                _append(self.spark, self.name, event.progress.batchId, row.asDict(), self.path)
            except Exception as e:  # the listener's thread has nobody to tell
                self.failed = e

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        with self.changed:
            self.ended[str(event.runId)] = event.exception
            self.changed.notify_all()

    def wait(self, run: str, seconds: float = 60) -> None:
        """Returns when all that the ended stream of this run id observed is recorded."""
        with self.changed:
            if not self.changed.wait_for(lambda: run in self.ended, seconds):
                raise TimeoutError(f"no end of {run} was heard of in {seconds} seconds")
        if self.failed:
            raise self.failed

    def __enter__(self) -> Recorder:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)


def of_steps(recorded: DataFrame, totals: list[str], largest: list[str]) -> DataFrame:
    """``(key, value)`` over all steps: sums of the ``totals``, maxima of the ``largest``."""
    value = F.when(F.col("key").isin(totals), F.sum("value")).otherwise(F.max("value"))
    return recorded.where(F.col("key").isin(totals + largest)).groupBy("key").agg(value.alias("value"))
