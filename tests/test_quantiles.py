"""Quantiles against sorted values; sketches within their rank error."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
import pytest

from tessera.operators import pool, quantiles

SHARES = [0.0, 0.01, 0.25, 0.5, 0.75, 0.99, 0.999, 1.0]


@pytest.mark.parametrize("kind", ["normal", "skewed", "ties", "tiny", "one", "wide"])
def test_exact_whatever_the_values(spark, monkeypatch, kind):
    monkeypatch.setattr(quantiles, "WITHIN", 50)
    rng = np.random.default_rng(1)
    x = {
        "normal": rng.normal(size=20_000),
        "skewed": np.exp(20 * rng.normal(size=20_000)),
        "ties": np.concatenate([np.zeros(15_000), rng.normal(size=5_000), np.full(3_000, 0.5)]),
        "tiny": 1.0 + np.arange(3_000) * 2.0**-52,
        "one": np.array([3.5]),
        "wide": np.concatenate([[-1.7e308, 1.7e308], rng.normal(size=3_000)]),
    }[kind]
    df = spark.createDataFrame(pd.DataFrame({"v": x}))
    got = quantiles.exact(df, "v", SHARES, size=64)
    s = np.sort(x)
    for share, value in zip(SHARES, got, strict=True):
        at = share * (len(s) - 1)
        a, b = float(s[math.floor(at)]), float(s[math.ceil(at)])
        assert value == pytest.approx(a if a == b else a + (at - math.floor(at)) * (b - a), rel=1e-12), share


def test_nothing_to_tell(spark):
    df = spark.createDataFrame([(None,), (float("nan"),)], "v double")
    assert quantiles.exact(df, "v", [0.5]) == [None]
    assert [tuple(r) for r in pool.percentiles(df, "v", [50.0]).collect()] == [(50.0, None)]


def test_sketches_merge_within_their_error(spark):
    rng = np.random.default_rng(2)
    x = rng.exponential(size=30_000)
    df = spark.createDataFrame(pd.DataFrame({"day": np.arange(30_000) % 3, "hour": np.arange(30_000) % 24, "v": x}))
    hours = quantiles.sketched(df, ["day", "hour"], "v")
    days = {r.day: r for r in quantiles.merged(hours, ["day"]).select("day", "n", *[quantiles.about(quantiles.F.col("sketch"), s).alias(f"q{i}") for i, s in enumerate(SHARES)]).collect()}
    for day in range(3):
        own = np.sort(x[np.arange(30_000) % 3 == day])
        assert days[day].n == 10_000
        for i, s in enumerate(SHARES):
            assert abs(np.searchsorted(own, days[day][f"q{i}"]) / 10_000 - s) <= 2 * quantiles.rank_error(quantiles.SIZE)
