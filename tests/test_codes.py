"""Search by codes: recall and work at two sizes, exactness where all is looked into, odd rows."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pytest

from tessera.operators import codes

SCHEMA = "vec_id long, embedding array<double>"


def clustered(n, seed=0, width=32):
    """Vectors in groups of some 25 in groups of some 25, as embeddings of templates lie."""
    rng = np.random.default_rng(seed)
    wide = rng.normal(size=(max(1, n // 600), width))
    middles = wide[rng.integers(0, len(wide), max(1, n // 25))] + 0.6 * rng.normal(size=(max(1, n // 25), width))
    return middles[rng.integers(0, len(middles), n)] + 0.25 * rng.normal(size=(n, width))


def frame(spark, x, ids=None):
    return spark.createDataFrame(pd.DataFrame({"vec_id": np.arange(len(x)) if ids is None else ids, "embedding": [r.tolist() for r in x]}), SCHEMA)


def exact(x, asked, k):
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    s = u[asked] @ u.T
    s[np.arange(len(asked)), asked] = -np.inf
    return {int(a): set(np.argsort(-np.round(r, 12), kind="stable")[:k].tolist()) for a, r in zip(asked, s, strict=True)}


def test_recall_and_equal_work_at_ten_times_the_size(spark, tmp_path):
    share, scanned = {}, {}
    for n in (2_000, 20_000):
        x = clustered(n)
        index = codes.build(frame(spark, x), "vec_id", str(tmp_path / str(n)))
        asked = np.arange(0, n, n // 100)
        found = codes.search(codes.load(spark, index.path), frame(spark, x[asked], asked), "vec_id", 5, probes=8, candidates=64, same=True)
        want, got = exact(x, asked, 5), {}
        for r in found.neighbours.collect():
            got.setdefault(r["query"], set()).add(r.neighbour)
        share[n] = np.mean([len(want[a] & got.get(a, set())) / 5 for a in want])
        work = found.work.collect()
        assert len(work) == 100 and all(r.cells <= 8 and r.codes <= 8 * codes.LEAF and r.compared <= 64 for r in work)
        scanned[n] = np.mean([r.codes for r in work])
    assert min(share.values()) >= 0.9, share
    assert scanned[20_000] < 1.5 * scanned[2_000], scanned


def test_exact_where_all_leaves_are_looked_into_with_ties_and_odd_rows(spark, tmp_path):
    x = np.round(clustered(1_500, 3, 8), 1)
    x[1000:1400] = x[7]  # one vector has a quarter of all ids
    x[1400:1500] = x[1300:1400] * 2  # and equal ones of another length
    rows = [(i, r.tolist()) for i, r in enumerate(x)]
    odd = [(None, [1.0] * 8), (5000, None)]
    df = spark.createDataFrame(rows + odd, SCHEMA).selectExpr("*", "1 AS cell", "2 AS n", "'x' AS id")
    index = codes.build(df, "vec_id", str(tmp_path / "i"))
    found = codes.search(index, df.where("vec_id % 10 = 0"), "vec_id", 6, probes=10_000, candidates=10_000, same=True)
    asked = np.arange(0, 1500, 10)
    got = {}
    for r in found.neighbours.collect():
        if r["query"] is not None and r["query"] < 1500:
            got.setdefault(r["query"], {})[r["rank"]] = r.neighbour
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    for a in asked.tolist():
        s = np.round(u[a] @ u.T, 12)
        s[a] = -np.inf
        assert [got[a][k] for k in range(1, 7)] == np.lexsort((np.arange(1500), -s))[:6].tolist()


def test_cells_that_centres_do_not_part_are_dealt_by_hash(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(codes, "DEEPEST", 0)
    x = clustered(900, 5)
    index = codes.build(frame(spark, x), "vec_id", str(tmp_path / "i"))
    assert index.read("leaves").selectExpr("sum(n)").head()[0] == 900
    assert index.read("leaves").selectExpr("max(n)").head()[0] <= codes.LEAF
    asked = np.arange(0, 900, 30)
    found = codes.search(index, frame(spark, x[asked], asked), "vec_id", 3, probes=10_000, candidates=10_000, same=True)
    got = {}
    for r in found.neighbours.collect():
        got.setdefault(r["query"], set()).add(r.neighbour)
    assert got == exact(x, asked, 3)


def test_empty_and_tiny_bases(spark, tmp_path):
    none = spark.createDataFrame([], SCHEMA)
    one = spark.createDataFrame([(3, [1.0, 0.0])], SCHEMA)
    index = codes.build(none, "vec_id", str(tmp_path / "none"))
    assert codes.search(index, one, "vec_id", 2).neighbours.count() == 0
    index = codes.build(one, "vec_id", str(tmp_path / "one"))
    assert [tuple(r) for r in codes.search(index, one, "vec_id", 2).neighbours.collect()] == [(3, 1, 3, 1.0)]
    assert codes.search(index, one, "vec_id", 2, same=True).neighbours.count() == 0
    assert codes.search(index, none, "vec_id", 2).neighbours.count() == 0
    with pytest.raises(ValueError):
        codes.search(index, one, "vec_id", codes.TIES)


def test_vectors_without_groups_are_found_too(spark, tmp_path):
    x = np.random.default_rng(5).normal(size=(12_000, 64))
    frame(spark, x).write.parquet(str(tmp_path / "embeddings.parquet"))
    from tessera.plans.scale_queries import knn_topk_codes

    assert tuple(knn_topk_codes(spark, str(tmp_path)).head()) == (12_000, 60_000, True, True)


def test_few_leaves_are_enough_for_a_recall_where_vectors_lie_in_groups(spark, tmp_path):
    x = clustered(20_000)
    index = codes.build(frame(spark, x), "vec_id", str(tmp_path / "i"))
    asked = np.arange(0, 20_000, 100)
    found = codes.search(index, frame(spark, x[asked], asked), "vec_id", 5, same=True, recall=0.9)
    want, got = exact(x, asked, 5), {}
    for r in found.neighbours.collect():
        got.setdefault(r["query"], set()).add(r.neighbour)
    assert np.mean([len(want[a] & got.get(a, set())) / 5 for a in want]) >= 0.9
    assert found.probes <= 16
    assert all(r.cells <= found.probes and r.compared <= found.candidates for r in found.work.collect())


def test_few_vectors_are_compared_where_all_lie_alike(spark, tmp_path):
    x = np.random.default_rng(6).normal(size=(3_000, 64))
    index = codes.build(frame(spark, x), "vec_id", str(tmp_path / "i"))
    found = codes.search(index, frame(spark, x[:300]), "vec_id", 5, same=True, recall=0.9)
    assert found.candidates == 12  # twice the neighbours and itself: the codes alone tell the order
    want, got = exact(x, np.arange(300), 5), {}
    for r in found.neighbours.collect():
        got.setdefault(r["query"], set()).add(r.neighbour)
    assert np.mean([len(want[a] & got[a]) / 5 for a in want]) >= 0.9
