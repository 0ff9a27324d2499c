"""What tasks and the driver hold doesn't grow with the tables."""

from __future__ import annotations

import numpy as np

from tessera.operators import index as I
from tessera.plans import rollout_queries as Q

FOLDER = "/root/testdata/sf0.001"


def test_rollouts_of_a_large_table_are_dealt_into_more_partitions(spark, monkeypatch):
    few = sorted(tuple(x) for x in Q.rollouts(spark, FOLDER).collect())
    monkeypatch.setattr(Q, "LINES", 100)
    many = Q.rollouts(spark, FOLDER)
    assert many.rdd.getNumPartitions() > 50
    assert sorted(tuple(x) for x in many.collect()) == few


def test_blocks_of_an_index_are_not_sent_through_the_driver(spark, tmp_path):
    rows = spark.createDataFrame([(i, np.random.default_rng(i).normal(size=4).tolist()) for i in range(300)], "id long, embedding array<double>")
    index = I.build(rows, "id", str(tmp_path / "index"))
    plan = I.search(index, rows.where("id % 10 = 0"), "id", 3, same=True)._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan


def test_few_vectors_at_once_meet_all_centres(spark, monkeypatch):
    monkeypatch.setattr(I, "AT_ONCE", 7)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(5, 4))
    m = rng.normal(size=(50, 4))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    got = sorted((r["id"], r["cell"]) for r in I.celled(rows, "id", centres, 2).collect())
    assert got == sorted((i, int(c)) for i, x in enumerate(m) for c in np.argsort(-(centres @ x))[:2])
