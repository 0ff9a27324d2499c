"""Scorers from files, and scorers that hang."""

from __future__ import annotations

import time

import pytest
from pyspark.sql import functions as F

from tessera.operators import execution

FILE = '''
import time

HALF = 0.5


def share(a, t):
    return HALF if a == t else 0.0


def scaled(a, t, by=1.0, least=0.0):
    return max(least, by * share(a, t))


def slow(a, t):
    if a == "x":
        time.sleep(60)
    return 1.0


number = 3
'''


@pytest.fixture
def path(tmp_path):
    (tmp_path / "scorers.py").write_text(FILE)
    return f"file://{tmp_path}/scorers.py"


@pytest.fixture
def pairs(spark):
    return spark.createDataFrame([("x", "x"), ("x", "y"), (None, None), ("z", "z")], "a string, t string")


def scores(pairs, function, **how):
    return [r.s for r in pairs.select(execution.scored(function, F.col("a"), F.col("t"), **how).alias("s")).collect()]


def test_a_scorer_by_path_and_name(spark, path, pairs):
    assert [s.score for s in scores(pairs, execution.scorer_from(spark, path, "share"))] == [0.5, 0.0, 0.5, 0.5]
    assert [s.score for s in scores(pairs, execution.scorer_from(spark, path, "scaled", by=4.0, least=0.25))] == [2.0, 0.25, 2.0, 2.0]


def test_what_is_missing(spark, path, tmp_path):
    assert execution.scorer_from(spark, None, "share") is None and execution.scorer_from(spark, "", "share") is None
    with pytest.raises(FileNotFoundError):
        execution.scorer_from(spark, f"file://{tmp_path}/none.py", "share")
    for name in ("none", "number"):
        with pytest.raises(AttributeError):
            execution.scorer_from(spark, path, name)
    (tmp_path / "broken.py").write_text("1 / 0")
    with pytest.raises(RuntimeError, match="division"):
        execution.scorer_from(spark, f"file://{tmp_path}/broken.py", "share")
    (tmp_path / "empty.py").write_text("")
    with pytest.raises(AttributeError):
        execution.scorer_from(spark, f"file://{tmp_path}/empty.py", "share")


def test_a_scorer_that_hangs_scores_nothing(spark, path, pairs):
    began = time.monotonic()
    got = scores(pairs, execution.scorer_from(spark, path, "slow"), seconds=0.3)
    assert [s.score for s in got] == [0.0, 0.0, 1.0, 1.0] and time.monotonic() - began < 30
    assert [s.error for s in got] == ["TimeoutError: more than 0.3 s"] * 2 + [None] * 2
