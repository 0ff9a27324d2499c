"""Dynamic sampling over a stream of rollouts.

A prompt's rollouts wait until all have come or their time is up; groups whose
rewards differ, and groups of one, are handed on. Handed-on prompts wait until
there are enough for a step; what is over stays for the next one.

Both keep state with timers, in the store that ``spark.sql.streaming.
stateStore.providerClass`` names; :func:`store` sets the one they need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tessera.sources.shared import reachable

ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def store(spark: SparkSession) -> None:
    """Lets the session's streams keep state that has timers and lists."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)


class Groups(StatefulProcessor):
    """Rollouts of one prompt: gathered by sample, closed when there are ``size`` or ``wait`` ms after the first."""

    def __init__(self, size: int, wait: int):
        self.size, self.wait = size, wait

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.rewards = handle.getMapState("rewards", "sample long", "reward double")
        self.closed = handle.getValueState("closed", "closed boolean")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.rewards.iterator()}
        new, done, first = {}, self.closed.exists(), None
        for pdf in rows:
            first = min(pdf["ts"].min(), first or pdf["ts"].min())
            for sample, reward in zip(pdf["sample"].tolist(), pdf["reward"].tolist()):
                # Of a sample's repeated rows the largest reward counts, whatever order they come in.
                if sample not in held or reward > held[sample]:
                    held[sample] = new[sample] = reward
        if first is not None and not done and not any(True for _ in self.handle.listTimers()):
            self.handle.registerTimer(int(first.timestamp() * 1000) + self.wait)
        if done:
            return
        for sample, reward in new.items():
            self.rewards.updateValue((sample,), (reward,))
        if len(held) >= self.size:
            self.closed.update((True,))  # what comes after the last rollout is a repetition
            self.rewards.clear()
            yield from self.judged(key, held, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        held = {k[0]: v[0] for k, v in self.rewards.iterator()}
        done = self.closed.exists()
        self.rewards.clear()
        self.closed.clear()
        if not done:
            yield from self.judged(key, held, timerValues)

    def judged(self, key, held: dict, timerValues) -> Iterator[pd.DataFrame]:
        """The group as a row, if there is something to learn from it."""
        rewards = [held[s] for s in sorted(held)]
        if len(rewards) == 1 or len(set(rewards)) > 1:
            at = pd.Timestamp(max(timerValues.getCurrentWatermarkInMs(), 0) + 1, unit="ms")  # rows at the watermark are late already
            yield pd.DataFrame({"uid": [key[0]], "closed": [at], "samples": [sorted(held)], "rewards": [rewards]})

    def close(self) -> None:
        pass


class Steps(StatefulProcessor):
    """Prompts of one lane, handed on in full shares of a step."""

    def __init__(self, share: int):
        self.share = share

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.waiting = handle.getListState("waiting", "uid long, samples array<long>, rewards array<double>")
        self.made = handle.getValueState("made", "made long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = list(self.waiting.get()) if self.waiting.exists() else []
        step = self.made.get()[0] if self.made.exists() else 0
        for pdf in rows:
            held += list(pdf[["uid", "samples", "rewards"]].itertuples(index=False, name=None))
            while len(held) >= self.share:
                head, held = held[: self.share], held[self.share :]
                yield pd.DataFrame([(step, key[0], u, list(np.asarray(s)), list(np.asarray(x))) for u, s, x in head], columns=["step", "lane", "uid", "samples", "rewards"])
                step += 1
        self.made.update((step,))
        self.waiting.clear()
        if held:
            self.waiting.put([(u, [int(i) for i in s], [float(i) for i in x]) for u, s, x in held])

    def close(self) -> None:
        pass


def groups(rollouts: DataFrame, size: int, wait: str, late: str) -> DataFrame:
    """``(uid, closed, samples, rewards)`` of prompts worth learning from, of a stream ``(uid long, sample long, reward double, ts)``.

    A group closes when ``size`` different samples have come, or at ``wait``
    (an interval) after its first row's time, when the watermark, ``late``
    behind the newest row, passes that. Of a sample that is repeated the
    largest reward that came before counts. Rows behind the watermark are left
    out, as are rows without uid, sample, reward or time. A prompt that comes
    again after its time is a new group.
    """
    spark = reachable(rollouts.sparkSession)
    ms = int(pd.Timedelta(wait).total_seconds() * 1000)
    rows = rollouts.where(F.expr("uid IS NOT NULL AND sample IS NOT NULL AND reward IS NOT NULL AND ts IS NOT NULL AND NOT isnan(reward)"))
    rows = rows.select(F.col("uid").cast("long"), F.col("sample").cast("long"), F.col("reward").cast("double"), "ts").withWatermark("ts", late)
    store(spark)
    return rows.groupBy("uid").transformWithStateInPandas(Groups(size, ms), "uid long, closed timestamp, samples array<long>, rewards array<double>", "append", "eventTime", eventTimeColumnName="closed")


def steps(groups: DataFrame, prompts: int, lanes: int = 1) -> DataFrame:
    """``(step, lane, uid, samples, rewards)``: groups handed on when a step is full of ``prompts``; the others wait.

    ``lanes`` share the prompts by hash of uid, and each fills its part of a
    step by itself, so that no task holds all: ``prompts`` must be a multiple
    of ``lanes``. A lane's state holds fewer groups than its share of a step.
    """
    if prompts < 1 or lanes < 1 or prompts % lanes:
        raise ValueError("a step's prompts must be a multiple of the lanes")
    store(groups.sparkSession)
    laned = groups.select(F.pmod(F.xxhash64("uid"), F.lit(lanes)).cast("int").alias("lane"), "uid", "samples", "rewards", "closed")
    kind = "step long, lane int, uid long, samples array<long>, rewards array<double>"
    return laned.groupBy("lane").transformWithStateInPandas(Steps(prompts // lanes), kind, "append", "none")
