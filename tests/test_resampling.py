"""Closed forms against all draws, one by one."""

from __future__ import annotations

import itertools
import random
from collections import Counter, defaultdict

import numpy as np

from tessera.operators import resampling


def slow(rows, sizes):
    prompts = defaultdict(list)
    for source, prompt, vote, value in rows:
        if value is not None:
            prompts[source, prompt].append((vote, value))
    out = defaultdict(list)
    for (source, _), x in prompts.items():
        for n in sizes:
            drawn = list(itertools.product(x, repeat=n))
            best, worst, maj = ([f(d) for d in drawn] for f in (lambda d: max(v for _, v in d), lambda d: min(v for _, v in d), first_majority))
            for name, v in (("best", best), ("worst", worst), ("maj", maj)):
                out[source, f"{name}@{n}"].append((np.mean(v), np.std(v)))
    return {k: np.mean(v, axis=0) for k, v in out.items()}


def first_majority(drawn):
    votes = Counter(vote for vote, _ in drawn)  # keeps the order in which votes came first
    winner = max(votes, key=votes.get)
    return next(v for vote, v in drawn if vote == winner)


def test_by_all_draws(spark):
    rng = random.Random(1)
    rows = [(f"s{p % 3}", p, rng.choice(["a", "b", "c", None]), rng.choice([0.0, 1.0, 0.5, 1e6 + rng.random()])) for p in range(12) for _ in range(rng.randint(1, 5))]
    rows += [("s0", 50, "a", None), ("s9", 51, "a", None)]
    df = spark.createDataFrame(rows, "source string, prompt int, vote string, value double")
    sizes = (1, 2, 4, 5)
    got = resampling.best_and_worst(df, "source", "prompt", "value", sizes).unionByName(resampling.majority(df, "source", "prompt", "vote", "value", sizes))
    want = slow(rows, sizes)
    found = {(r.source, r.stat): (r["mean"], r["std"]) for r in got.collect()}
    assert found.keys() == want.keys()
    for k, v in want.items():
        assert np.allclose(found[k], v, rtol=1e-6, atol=1e-6), k


def test_chances_add_up_for_many_votes_and_draws():
    for counts in ([1], [3, 1], [5, 5, 5], list(range(1, 30)), [1000, 1, 1]):
        for n in (1, 2, 7, 32):
            p = resampling.winning(np.array(counts, float), n)
            assert abs(p.sum() - 1) < 1e-9 and (p >= 0).all()
    even = resampling.winning(np.array([4.0, 4.0, 4.0, 4.0]), 9)
    assert np.allclose(even, 0.25)


def test_empty(spark):
    none = spark.createDataFrame([], "source string, prompt int, vote string, value double")
    assert resampling.majority(none, "source", "prompt", "vote", "value", (2,)).count() == 0
    assert resampling.best_and_worst(none, "source", "prompt", "value", (2,)).count() == 0
