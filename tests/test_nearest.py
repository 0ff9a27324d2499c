"""Exact neighbours: products in single precision only say where to look."""

from __future__ import annotations

import numpy as np
import pytest

from tessera.operators import vectors as V
from tessera.plans import pool_queries


def slow(qi, qm, bi, bm, k, same):
    out = []
    for i, x in zip(qi, qm, strict=True):
        s = sorted((-round(float(y @ x), 12), int(j), float(y @ x)) for j, y in zip(bi, bm, strict=True) if not (same and i == j))
        out += [(int(i), j, round(v, 9)) for _, j, v in s[:k]]
    return sorted(out)


@pytest.mark.parametrize("case", ["random", "copies", "few different", "close", "repeated ids"])
@pytest.mark.parametrize("same", [True, False])
def test_best_by_brute_force(monkeypatch, case, same):
    monkeypatch.setattr(V, "BLOCK", 128)
    monkeypatch.setattr(V, "ROWS", 64)
    rng = np.random.default_rng(0)
    m, ids = rng.normal(size=(700, 16)), rng.permutation(700)
    if case == "copies":
        m[:500] = m[0]
    if case == "few different":
        m = np.sign(m[:, :4])
    if case == "close":  # closer than single precision tells apart
        m = m[0] + 1e-7 * m
    if case == "repeated ids":
        ids = ids // 3
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    got = V.best_of(ids[:150], m[:150], ids, m, 4, same)
    assert sorted((int(a), int(b), round(float(c), 9)) for a, b, c in zip(*got, strict=True)) == slow(ids[:150], m[:150], ids, m, 4, same)


def test_blocks_meet_in_groups(spark, monkeypatch):
    monkeypatch.setattr(V, "TOGETHER", (2, 3))
    rng = np.random.default_rng(2)
    m = rng.normal(size=(500, 8)).round(1)
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id long, embedding array<double>")
    got = sorted((r["query"], r["neighbour"], round(r["similarity"], 9)) for r in V.nearest(rows.where("id < 200"), rows, "id", 3, same=True, block=20).collect())
    m /= np.linalg.norm(m, axis=1, keepdims=True)
    assert got == slow(range(200), m[:200], range(500), m, 3, True)


def test_scores_are_made_once(spark):
    assert "CoGroup" not in pool_queries.scores(spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
