"""Dynamic sampling over a stream equals that of the batch."""

from __future__ import annotations

import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.operators import rollouts as R
from tessera.streaming import sampling

SIZE = 4


def history(seed=5):
    """(file, uid, sample, reward, second): complete groups, short ones, repeated rows, then a row that moves the watermark on."""
    rng = random.Random(seed)
    rows = []
    for uid in range(60):
        n = SIZE if uid % 3 else rng.randint(1, SIZE - 1)
        for s in range(n):
            rows.append((uid % 2, uid, s, float(rng.randint(0, 1)), rng.randint(0, 20)))
    rows += rows[::5]  # come twice
    rng.shuffle(rows)
    return rows


@pytest.fixture(scope="module")
def finished(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("sampling")
    rows = history()
    late = [(2, 1000, 0, 0.5, 500)], [(3, 7, 99, 9.0, 1), (3, None, 0, 1.0, 600), (3, 1001, 0, 0.5, 900)], [(4, 1002, 0, 0.5, 2000)]
    source = str(folder / "in")
    kept = spark.createDataFrame([r for r in rows], "file int, uid long, sample long, reward double, s int")
    for k, part in enumerate([kept.where("file = 0"), kept.where("file = 1"), *(spark.createDataFrame(x, kept.schema) for x in late)]):
        part.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("file", "s").coalesce(1).write.mode("append").parquet(source)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stream = spark.readStream.schema("uid long, sample long, reward double, ts timestamp").option("maxFilesPerTrigger", 1).parquet(source)
    out = sampling.steps(sampling.groups(stream, SIZE, "1 minute", "10 seconds"), 6, 2)
    q = out.writeStream.format("parquet").option("path", str(folder / "out")).option("checkpointLocation", str(folder / "c")).trigger(availableNow=True).start()
    q.awaitTermination()
    if before is None:
        spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    batch = R.dynamic_sampling(kept.dropDuplicates(["uid", "sample"]).select("uid", "sample", "reward"))
    want = {r.uid: r.x for r in batch.groupBy("uid").agg(F.transform(F.array_sort(F.collect_list(F.struct("sample", "reward"))), lambda x: x["reward"]).alias("x")).collect()}
    return spark.read.parquet(str(folder / "out")).collect(), want


def test_groups_equal_the_batch(finished):
    got, want = finished
    assert len({r.uid for r in got}) == len(got)  # no prompt twice
    for r in got:
        if r.uid < 1000:
            assert r.rewards == want[r.uid] and r.samples == list(range(len(r.rewards)))
    # Every prompt worth learning from has left, but for those that wait for a full step.
    waiting = set(want) - {r.uid for r in got}
    assert len(waiting) < 6 and {r.uid for r in got} <= set(want) | {1000, 1001}


def test_steps_are_full(finished):
    got, _ = finished
    shares = Counter((r.lane, r.step) for r in got)
    assert set(shares.values()) == {3} and {lane for lane, _ in shares} == {0, 1}
    for lane in (0, 1):
        assert sorted(s for x, s in shares if x == lane) == list(range(sum(x == lane for x, _ in shares)))


def test_lanes_share_a_step(spark):
    with pytest.raises(ValueError):
        sampling.steps(spark.range(1), 5, 2)
