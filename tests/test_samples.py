"""Queries that SQL can't express, held against their definitions."""

from __future__ import annotations

import os
import struct

import numpy as np
import xxhash
from pyspark.sql import functions as F

from tessera.operators import pool, rollouts, vectors
from tessera.plans import registry, table

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def signed(h):
    return h - (1 << 64) if h >> 63 else h


def hashed(key, seed):
    """Spark's xxhash64 of a long and an int: each is hashed with the hash before it as the seed."""
    return signed(xxhash.xxh64_intdigest(struct.pack("<i", seed), xxhash.xxh64_intdigest(struct.pack("<q", key), 42)))


def run(spark, name):
    return registry.QUERIES[name](spark, FOLDER).collect()


def parts(spark):
    return [r.p_partkey for r in table(spark, FOLDER, "part").select("p_partkey").collect()]


def test_samples_are_those_that_hash_lowest(spark):
    ids = parts(spark)
    assert all(isinstance(i, int) for i in ids)
    want = sorted(ids, key=lambda i: (hashed(i, 42), i))[:100]
    assert sorted(r.idx for r in run(spark, "sample_exact")) == sorted(want)
    taken = {r.o_custkey for r in table(spark, FOLDER, "orders").select("o_custkey").collect()}
    rest = sorted((i for i in ids if i not in taken), key=lambda i: (hashed(i, 7), i))[:50]
    assert sorted(r.idx for r in run(spark, "random_fill")) == sorted(rest)


def test_seeded_order_is_a_permutation_by_hash(spark):
    got = sorted(run(spark, "seeded_order"), key=lambda r: r.place)
    assert [r.place for r in got] == list(range(25)) and len({r.seed for r in got}) == 25
    table_ = table(spark, FOLDER, "nation").select("n_nationkey", F.xxhash64("n_nationkey", F.lit(42)).alias("h")).collect()
    assert [r.n_nationkey for r in got] == [r.n_nationkey for r in sorted(table_, key=lambda r: (r.h, r.n_nationkey))]


def test_quotas_of_ranks(spark):
    got = run(spark, "stratified_quota")
    c = table(spark, FOLDER, "lineitem").select((F.col("l_linenumber") % 5).alias("rank"), F.col("l_partkey").alias("idx")).distinct().collect()
    left = {rank: {r.idx for r in c if r["rank"] == rank} for rank in range(5)}
    taken: set = set()
    want = []
    for rank, weight in enumerate([0.35, 0.25, 0.2, 0.1, 0.1]):
        own = sorted(left[rank] - taken, key=lambda i: (hashed(i, 42), i))[: int(weight * 512)]
        taken |= set(own)
        want += [(i, rank) for i in own]
    fill = sorted({r.idx for r in c} - taken, key=lambda i: (hashed(i, 42), i))[: max(0, 512 - len(taken))]
    assert sorted((r.idx, r["rank"]) for r in got) == sorted(want + [(i, -1) for i in fill])


def test_draws_follow_a_line_of_weights(spark):
    got = run(spark, "sample_weighted")
    assert sorted(r.draw for r in got) == list(range(1000))
    sizes = {r.p_partkey: r.p_size for r in table(spark, FOLDER, "part").select("p_partkey", "p_size").collect()}
    drawn = np.mean([sizes[r.p_partkey] for r in got])
    weights = np.array([v * v for v in sizes.values()], float)
    assert abs(drawn - (weights * list(sizes.values())).sum() / weights.sum()) < 2.5


def test_embedded_texts(spark):
    texts = {r.item_id: r.text for r in table(spark, FOLDER, "benchmark").collect()}
    got = run(spark, "embedded_texts")
    assert {r.item_id for r in got} == set(texts)
    for r in got:
        assert np.allclose(r.embedding, vectors.hashed_embedding([texts[r.item_id] or ""])[0])


def test_shuffled_choices_are_permutations(spark):
    got = run(spark, "shuffled_choices")
    assert len(got) == table(spark, FOLDER, "benchmark").count()
    places = set()
    for r in got:
        row = r.asDict()
        choices = next(v for v in row.values() if isinstance(v, list))
        place = next(v for k, v in row.items() if isinstance(v, int) and k != "item_id")
        assert sorted(choices) == [f"{c}{r.item_id}" for c in "abcd"] and choices[place] == f"a{r.item_id}"
        places.add(place)
    assert places == {0, 1, 2, 3}


def test_pair_accuracy_against_all_pairs(spark):
    rng = np.random.default_rng(5)
    rows = [(u, i, float(rng.integers(0, 4)), float(rng.integers(0, 3))) for u in range(6) for i in range([1, 2, 3, 9, 30, 60][u])]
    got = {r.uid: r.accuracy for r in rollouts.pair_accuracy(spark.createDataFrame(rows, "uid int, sample int, score double, reward double"), "score", "reward").collect()}
    for u in range(6):
        own = [(s, a) for x, _, s, a in rows if x == u]
        pairs = [(abs(a - b), (s - t) * (a - b) > 0) for k, (s, a) in enumerate(own) for t, b in own[:k]]
        if len(own) < 2:
            assert u not in got
        else:
            w = sum(p for p, _ in pairs)
            assert abs(got[u] - (sum(p for p, ok in pairs if ok) / w if w else 0.5)) < 1e-12


def test_entries_and_demonstrations(spark):
    rows = [(i, "s" if i % 3 else "t", f"d{i % 2}") for i in range(30)] + [(30, " ", "d0"), (31, None, "d1")]
    df = spark.createDataFrame(rows, "idx long, skeleton string, db string")
    got = pool.entries(df, "skeleton", ["db"], "idx").collect()
    for fid, s in enumerate("st"):
        own = [r[0] for r in rows if r[1] == s]
        assert sorted((r["fid"], r["count"], r["place"], r["idx"]) for r in got if r.skeleton == s) == [(fid, len(own), p, i) for p, i in enumerate(own)]
    assert len(got) == 30
