"""The sampler is a permutation, resumes where it was, and sorts nothing."""

from __future__ import annotations

import pytest

from tessera.operators import sampler as S


@pytest.mark.parametrize("n", [1, 2, 3, 5, 10, 37, 64, 1000, 30_011])
def test_permutation_and_its_inverse(spark, n):
    s = S.Sampler(n, 7, 2)
    got = spark.range(n).select("id", s.position_of(S.F.col("id")).alias("p")).select("id", "p", s.row_at(S.F.col("p")).alias("back")).collect()
    assert sorted(r.p for r in got) == list(range(n))
    assert all(r.back == r.id for r in got)
    if n > 30:
        assert sum(r.p == r.id for r in got) < n / 4
        other = spark.range(n).select(S.Sampler(n, 7, 3).position_of(S.F.col("id")).alias("p")).collect()
        assert [r.p for r in other] != [r.p for r in got]


def test_resumes_as_the_tail_of_a_full_run(spark):
    s = S.Sampler(500, 11)
    full = [r["row"] for r in sorted(S.next_rows(spark, s, 1300).collect(), key=lambda r: (r.epoch, r.position))]
    assert len(full) == 1300 and sorted(full[:500]) == sorted(full[500:1000]) == list(range(500))
    for p in (0, 1, 499, 500, 777):
        later = S.Sampler(**s.take(p).state())
        rest = [r["row"] for r in sorted(S.next_rows(spark, later, 1300 - p).collect(), key=lambda r: (r.epoch, r.position))]
        assert rest == full[p:]
    later = s.take(620)
    rows = S.rest_of_epoch(spark.range(500).withColumnRenamed("id", "row"), "row", later)
    assert [r["row"] for r in sorted(rows.collect(), key=lambda r: r.position)] == full[620:1000]
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Sort" not in plan and "Exchange" not in plan
    assert S.next_rows(spark, s, 0).count() == 0


def test_wrong_states():
    for state in ((0, 1, 0, 0), (5, 1, 0, 6), (5, 1, 0, -1)):
        with pytest.raises(ValueError):
            S.Sampler(*state)
