"""Streams of rollouts: failures as they come, and a first-in-first-out buffer that is drained in slices."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def solve_counts(rollouts: DataFrame, time: str, late: str, window: str, solved: float = 4.0) -> DataFrame:
    """``(start, stop, uid, best, n)`` in windows of event time; what is later than ``late`` is left out."""
    w = F.window(time, window)
    out = rollouts.withWatermark(time, late).groupBy(w, "uid").agg(F.max("reward").alias("best"), F.count(F.lit(1)).alias("n"))
    return out.select(F.col("window.start").alias("start"), F.col("window.end").alias("stop"), "uid", (F.col("best") < solved).alias("solve_none"), "n")


def slices(rows: DataFrame, key: str, value: str, size: int) -> DataFrame:
    """``(key, slice, vals)``: each key's values in full slices of ``size``, in order of arrival.

    What doesn't fill a slice waits in the state; a key's state holds fewer
    values than a slice has, and how many slices were made.
    """
    kind = dict(rows.dtypes)[key]

    def run(k: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held, made = state.get if state.exists else ([], 0)
        held = list(held)
        for pdf in batches:
            held += pdf[value].tolist()
        out = []
        while len(held) >= size:
            out.append((k[0], made, held[:size]))
            held, made = held[size:], made + 1
        state.update((held, made))
        if out:
            yield pd.DataFrame(out, columns=[key, "slice", "vals"])

    return rows.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, slice long, vals array<double>", "held array<double>, made long", "append", GroupStateTimeout.NoTimeout)
