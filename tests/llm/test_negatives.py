from __future__ import annotations

import math

import numpy as np
import pytest

from tessera.llm import negatives

SCHEMA = "vec_id long, embedding array<float>, label int"


def slow(rows):
    """All pairs, one after another."""
    base = {(i, y, tuple(math.floor(256 * float(np.float32(x))) for x in v)) for i, v, y in rows if i is not None and y is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)}
    out = []
    for a, label, va in base:
        if a % 50:
            continue
        scored = [(-sum(p * q for p, q in zip(va, vb, strict=False)), b, y) for b, y, vb in base]
        for s, p, _ in sorted(x for x in scored if x[2] == label and x[1] != a)[:5]:
            fits = sorted(x for x in scored if x[2] != label and 50 * -s <= 100 * -x[0] <= 95 * -s)[:3]
            out += [(a, p, k + 1, n, -s, -t) for k, (t, n, _) in enumerate(fits)]
    return sorted(out)


def rows(n, seed, close=True):
    rng = np.random.default_rng(seed)
    middles = rng.normal(size=(6, 12))
    v = (middles[rng.integers(0, 6, n)] + 0.4 * rng.normal(size=(n, 12))) if close else np.round(rng.normal(size=(n, 3)))
    return [(i, [float(x) for x in v[i].astype(np.float32)], int(rng.integers(0, 4)) if rng.random() > 0.4 else 1) for i in range(n)]


@pytest.mark.parametrize("close", [True, False])
def test_by_brute_force(spark, monkeypatch, close):
    monkeypatch.setattr(negatives, "SHARD", 150)
    monkeypatch.setattr(negatives, "BLOCK", 4)
    monkeypatch.setattr(negatives, "TOGETHER", 2)
    given = rows(700, 3, close)
    odd = [(None, [1.0] * 12, 1), (1000, None, 1), (1050, [1.0, None], 2), (1100, [float("nan")] * 12, 1), (1150, [float("inf")] * 12, 2), (1200, [1.0] * 12, None), (1250, [], 1), (1300, [2.0, 1.0], 1), given[50], given[50], (100, given[3][1], given[3][2])]
    df = spark.createDataFrame(given + odd, SCHEMA).selectExpr("*", "1 AS rank", "2 AS shard", "'x' AS block")
    got = sorted(tuple(r) for r in negatives.hard_negatives(df).collect())
    assert got == slow(given + odd) and len(got) > 50


def test_trees_bound_distances_and_skip_leaves(monkeypatch):
    monkeypatch.setattr(negatives, "LEAF", 8)
    rng = np.random.default_rng(1)
    v = np.floor(256 * np.repeat(rng.normal(size=(20, 6)), 30, axis=0) + rng.normal(size=(600, 6)))
    most = float((v * v).sum(1).max())
    tree = negatives.grow(np.arange(600), rng.integers(0, 3, 600), v, most)
    assert sorted(tree.ids.tolist()) == list(range(600)) and max(b - a for a, b in tree.leaves) <= 8
    q = v[::37]
    square = (q * q).sum(1)
    low, high = tree.leaf_bounds(q, square, most)
    away = np.sqrt(square[:, None] + most - 2 * q @ tree.vectors.T)
    for i, (a, b) in enumerate(tree.leaves):
        assert (low[:, i] <= away[:, a:b].min(1) + 1e-6).all() and (high[:, i] >= away[:, a:b].max(1) - 1e-6).all()
    # Most leaves are farther than the fifth row, so they are never visited.
    asked = negatives.Asked(np.full(len(q), -1), np.zeros(len(q), np.int64), q, np.full(len(q), -np.inf), np.full(len(q), np.inf), True)
    ids, score = negatives.first_rows(tree, asked, most, 5)
    exact = np.where(tree.labels == 0, q @ tree.vectors.T, -np.inf)
    assert np.array_equal(score, -np.sort(-exact, 1)[:, :5])
    fifth = np.sqrt(square + most - 2 * score[:, 4])
    assert (low <= fifth[:, None]).mean() < 0.5


def test_empty_tables_and_ties(spark):
    assert negatives.hard_negatives(spark.createDataFrame([], SCHEMA)).count() == 0
    assert negatives.hard_negatives(spark.createDataFrame([(1, [1.0], 1)], SCHEMA)).count() == 0
    same = [(i, [1.0, 0.0], 1) for i in range(0, 300, 7)] + [(i, [0.75, 0.0], 2) for i in range(1, 300, 7)]
    assert sorted(tuple(r) for r in negatives.hard_negatives(spark.createDataFrame(same, SCHEMA)).collect()) == slow(same)


def test_blocks_and_shards_are_not_sent_through_the_driver(spark):
    """Each is repeated for every one of the other side: by far more than the files that Spark judges them by."""
    blocks = spark.createDataFrame([(0, b"", b"", b"", b"", b"", b"", b"")], "block int, ids binary, labels binary, vectors binary, at binary, query binary, least binary, most binary")
    shards = spark.createDataFrame([(0, b"", b"", b"")], "shard int, ids binary, labels binary, vectors binary")
    plan = negatives.search(shards, blocks, 500, 70, 1.0, 5, True)._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan
