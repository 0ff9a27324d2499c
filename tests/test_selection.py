"""Farthest-first selection against the greedy one, step by step."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tessera.operators import selection, vectors
from tests.test_codes import clustered

SCHEMA = "vec_id long, embedding array<double>"


def frame(spark, x, first=0):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(first, first + len(x)), "embedding": [r.tolist() for r in x]}), SCHEMA)


def greedy(x, existing, k):
    u, o = (m / np.maximum(np.linalg.norm(m, axis=1, keepdims=True), 1e-300) for m in (x, existing))
    d, out = 1 - (u @ o.T).max(1), []
    for _ in range(min(k, len(x))):
        d = np.where((d > -1e-6) & (d < 0), 0.0, d)
        at = int(np.lexsort((np.arange(len(x)), -np.round(d, 12)))[0])
        if d[at] < 0:
            break
        out.append((at, d[at]))
        d = np.minimum(d, 1 - u @ u[at])
        d[[i for i, _ in out]] = -np.inf
    return out


@pytest.mark.parametrize("kind", ["groups", "random"])
def test_is_the_greedy_selection_with_few_jobs(spark, kind):
    x = clustered(4_000, 1, 16) if kind == "groups" else np.random.default_rng(2).normal(size=(2_000, 48))
    existing = x[-100:] + 0.05
    got = selection.complementary(frame(spark, x), frame(spark, existing, 10_000), "vec_id", 200)
    want = greedy(x, existing, 200)
    picks = sorted(got.picks.collect(), key=lambda r: r.selection_rank)
    assert [r.vec_id for r in picks] == [i for i, _ in want]
    assert np.allclose([r.distance for r in picks], [d for _, d in want], atol=1e-9)
    assert got.jobs < 200 / 8, got.jobs
    d = np.array([d for _, d in want])
    r = selection.report(got.picks).head()
    assert np.allclose([r["selected"], r["min"], r["p50"], r["p95"], r["max"]], [200, d.min(), *np.quantile(d, [0.5, 0.95]), d.max()])


def test_small_pools_and_blocks_that_stay_closed(spark):
    x = clustered(3_000, 3, 8)
    df, existing = frame(spark, x), frame(spark, x[:5] + 0.01, 10_000)
    start = vectors.distance_to(df, existing, "vec_id")
    got = selection.farthest_first(df, start, "vec_id", 60, pool=8, cells=64)
    assert [r.vec_id for r in sorted(got.picks.collect(), key=lambda r: r.selection_rank)] == [i for i, _ in greedy(x, x[:5] + 0.01, 60)]
    blocks = selection.blocks(df, start, "vec_id", 64).count()
    assert got.opened < 0.9 * blocks * (got.jobs // 2), (got.opened, blocks, got.jobs)


def test_ties_copies_and_ends(spark):
    x = np.array([[1.0, 0], [0, 1], [0, 1], [1, 0], [-1, 0], [-1, 0], [0, 0]])
    df = frame(spark, x)
    none = spark.createDataFrame([], SCHEMA)
    start = df.selectExpr("vec_id", "CAST(2 AS DOUBLE) AS distance")
    got = selection.farthest_first(df, start, "vec_id", 20, pool=2)
    picks = [r.vec_id for r in sorted(got.picks.collect(), key=lambda r: r.selection_rank)]
    assert picks[:2] == [0, 4] and sorted(picks) == list(range(7))
    again = selection.farthest_first(df.unionByName(df), start, "vec_id", 3, pool=1)
    assert again.picks.count() == 3
    assert selection.farthest_first(none, none.selectExpr("vec_id", "1D AS distance"), "vec_id", 3).picks.count() == 0
    odd = spark.createDataFrame([(1, None), (None, [1.0]), (2, [1.0])], SCHEMA)
    assert [r.vec_id for r in selection.farthest_first(odd, odd.selectExpr("vec_id", "1D AS distance"), "vec_id", 3).picks.collect()] == [2]
