"""Synthesis that is stopped and gone on with, against one that isn't."""

from __future__ import annotations

import os

import pytest
from pyspark.sql import functions as F

from tessera.operators import generation, synthesis


def stages(log, stop_at=None):
    """Two stages of a generator that writes down what it is asked, and may break at a stage and attempt."""

    def ask(prompts):
        with open(log, "a") as f:
            f.writelines(p + "\n" for p in prompts)
        return [str((int(p.split()[1]) + int(p.split()[2])) % 3) for p in prompts]

    def step(name):
        def run(rows):
            prompt = F.concat_ws(" ", F.lit(name), "k", "attempt")
            if stop_at:
                prompt = F.when((F.lit(name) == stop_at[0]) & (F.col("attempt") == stop_at[1]), F.raise_error(F.lit("stopped"))).otherwise(prompt)
            said = generation.complete(rows.withColumn("prompt", prompt), "prompt", "said", lambda: ask)
            return said.withColumn(name, F.col("said")).withColumn("reason", F.when(F.col("said") == "0", f"{name}_zero")).drop("prompt", "said")

        return run

    return [synthesis.Stage(n, step(n)) for n in ("first", "second")]


def run(spark, path, log, stop_at=None, rounds=20):
    ledger = synthesis.Ledger(spark, path)
    rows = spark.range(30).select(F.col("id").alias("k"), F.lit("x").alias("more"))
    synthesis.synthesize(rows, "k", {"first": "string", "second": "string"}, stages(log, stop_at), ledger, rounds, attempts=3, database=lambda k, a: synthesis.drawn(k, a, ["a", "b", "c"], 1))
    return ledger


def kept(ledger):
    return sorted(map(tuple, ledger.rows().drop("round").collect()), key=str)


def test_a_stopped_run_goes_on_and_asks_nothing_again(spark, tmp_path):
    whole = run(spark, str(tmp_path / "whole"), str(tmp_path / "a"))
    with pytest.raises(Exception, match="stopped"):
        run(spark, str(tmp_path / "stopped"), str(tmp_path / "b"), stop_at=("second", 2))
    before = synthesis.Ledger(spark, str(tmp_path / "stopped")).rounds()
    assert before and len(before) < len(whole.rounds())
    asked = {line.strip() for line in open(tmp_path / "b")}
    # What a stopped round left behind doesn't count.
    os.makedirs(tmp_path / "stopped" / f"round-{len(before)}", exist_ok=True)
    (tmp_path / "stopped" / f"round-{len(before)}" / "part-0.parquet").write_bytes(b"half")
    finished = {f"{r.tried} {r.k} {r.tried_attempt}" for r in synthesis.Ledger(spark, str(tmp_path / "stopped")).rows().where("tried IS NOT NULL").collect()}
    later = run(spark.newSession(), str(tmp_path / "stopped"), str(tmp_path / "c"))
    again = {line.strip() for line in open(tmp_path / "c")}
    assert finished and finished <= asked and not finished & again
    assert kept(later) == kept(whole)
    # Nothing is left to do: a further run asks nothing.
    run(spark, str(tmp_path / "stopped"), str(tmp_path / "d"))
    assert not os.path.exists(tmp_path / "d")


def test_records(spark, tmp_path):
    ledger = run(spark, str(tmp_path / "l"), str(tmp_path / "a"))
    good = {r.k: r for r in synthesis.succeeded(ledger).collect()}
    bad = synthesis.failures(ledger, "k").collect()
    for k in range(30):
        # A stage fails where key and attempt add up to a multiple of three: the first one always does so first.
        won = next(a for a in (1, 2, 3) if (k + a) % 3)
        assert good[k].tried_attempt == won and good[k].first == good[k].second == str((k + won) % 3) and good[k].more == "x"
        assert sorted((r.stage, r.attempt, r.reason) for r in bad if r.k == k) == [("first", a, "first_zero") for a in range(1, won)]
    dbs = {r.db for r in bad} | {r.db for r in good.values()}
    assert dbs == {"a", "b", "c"}
    with pytest.raises(ValueError, match="status"):
        synthesis.synthesize(spark.range(1).selectExpr("id AS k", "1 AS status"), "k", {}, [], ledger, 1)


def test_same_results(spark):
    a = spark.createDataFrame([(1, "x"), (1, "x"), (1, None), (2, "y"), (3, "z")], "k int, v string")
    b = spark.createDataFrame([(1, None), (1, "x"), (2, "y"), (2, "w"), (4, "z")], "k int, v string")
    keys = spark.createDataFrame([(i,) for i in (1, 2, 3, 4, 5)], "k int")
    assert {r.k: r.same for r in synthesis.same_results(a, b, "k", keys).collect()} == {1: True, 2: False, 3: False, 4: False, 5: True}


def test_same_results_reads_each_side_once(spark, tmp_path):
    def logged(name):
        log = str(tmp_path / name)

        def run(batches):
            for pdf in batches:
                with open(log, "a") as f:
                    f.writelines("row\n" for _ in range(len(pdf)))
                yield pdf

        return spark.range(20).selectExpr("id AS k", f"IF(id = 3, '{name}', 'v') AS side").mapInPandas(run, "k long, side string")

    got = {r.k: r.same for r in synthesis.same_results(logged("a"), logged("b"), "k", spark.range(21).withColumnRenamed("id", "k")).collect()}
    assert got == {k: k != 3 for k in range(21)}
    assert [len(open(tmp_path / n).readlines()) for n in "ab"] == [20, 20]
