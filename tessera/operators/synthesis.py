"""Synthesis by stages in rounds, with a ledger from which a run goes on.

Rows stand at stages; in a round every open row takes the step of its own
stage. What goes well moves on to the next stage, what fails starts another
attempt, with another database. Each round is a table of its own that counts
when it is complete: a run that was stopped goes on after the last one, in
whatever session, and asks nothing again that a complete round has answered.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import free, scratch

OPEN, DONE, GIVEN_UP = "open", "done", "given_up"


@dataclass(frozen=True)
class Ledger:
    """Tables ``round-0``, ``round-1`` ... in a folder that only grows; one without Spark's mark of success doesn't count."""

    spark: SparkSession
    path: str

    def rounds(self) -> list[int]:
        """The complete rounds, as far as none is missing before them."""
        hadoop = self.spark._jvm.org.apache.hadoop.fs
        folder = hadoop.Path(self.path)
        fs = folder.getFileSystem(self.spark._jsc.hadoopConfiguration())
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        known = {int(m[1]) for m in (re.fullmatch(r"round-(\d+)", n) for n in names) if m and fs.exists(hadoop.Path(f"{self.path}/{m[0]}/_SUCCESS"))}
        out = []
        while len(out) in known:
            out.append(len(out))
        return out

    def append(self, rows: DataFrame, round_: int) -> None:
        """Writes a round; a part that a stopped run has left there goes."""
        rows.write.mode("overwrite").parquet(f"{self.path}/round-{round_}")

    def round(self, round_: int) -> DataFrame:
        return self.spark.read.parquet(f"{self.path}/round-{round_}")

    def rows(self) -> DataFrame | None:
        """All complete rounds with their number in ``round``."""
        out = None
        for k in self.rounds():
            one = self.round(k).withColumn("round", F.lit(k))
            out = one if out is None else out.unionByName(one)
        return out


@dataclass(frozen=True)
class Stage:
    """A stage's ``step`` gets the rows that stand there and gives them back with their payload filled in and ``reason``: null if it went well."""

    name: str
    step: Callable[[DataFrame], DataFrame]


def drawn(key: Column, attempt: Column, names: list[str], seed: int) -> Column:
    """The database of an attempt, by hash of key and attempt."""
    return F.get(F.array(*[F.lit(n) for n in names]), F.pmod(F.xxhash64(key, attempt, F.lit(seed)), F.lit(len(names))).cast("int"))


def synthesize(rows: DataFrame, key: str, payload: dict[str, str], stages: list[Stage], ledger: Ledger, rounds: int, attempts: int = 8, database: Callable[[Column, Column], Column] | None = None, back: int = 0) -> None:
    """Takes ``rows`` through the stages, round by round, and records each in the ledger.

    ``payload`` names the columns that stages fill in, with their types.
    A row that fails has one attempt more, of ``attempts``, and goes back to
    stage number ``back`` with an empty payload; ``database(key, attempt)``
    draws another one for it. Records are the rows with ``stage``, ``attempt``
    and ``status`` as they are after the round, ``tried``, ``tried_attempt``,
    ``db`` and ``reason`` as they were in it. Ends when nothing is open or
    after ``rounds`` rounds in all, those of earlier runs included; a run
    that finds rounds in the ledger takes its rows from there.
    """
    done = ledger.rounds()
    taken = [*payload, "stage", "attempt", "status", "tried", "tried_attempt", "db", "reason", "round"]
    if clash := [c for c in taken if free(rows, c) != [c]]:
        raise ValueError(f"columns of the rows have names that records need: {clash}")
    if not done:
        first = rows.select("*", *[F.lit(None).cast(t).alias(c) for c, t in payload.items()], F.lit(0).alias("stage"), F.lit(1).alias("attempt"), F.lit(OPEN).alias("status"))
        ledger.append(first.select("*", *[F.lit(None).cast(t).alias(c) for c, t in (("tried", "string"), ("tried_attempt", "int"), ("db", "string"), ("reason", "string"))]), 0)
        done = [0]
    for k in range(done[-1] + 1, rounds + 1):
        left = ledger.round(k - 1).where(F.col("status") == OPEN)
        if left.isEmpty():
            break
        if database is not None:
            left = left.withColumn("db", database(F.col(key), F.col("attempt")))
        with scratch(ledger.spark):  # what a step puts aside goes when its round is written
            ledger.append(after(left, stages, payload, attempts, back), k)


def after(left: DataFrame, stages: list[Stage], payload: dict[str, str], attempts: int, back: int) -> DataFrame:
    """The records of a round for the rows that were open before it."""
    record = None
    for i, stage in enumerate(stages):
        tried = stage.step(left.where(F.col("stage") == i).drop("reason")).withColumn("tried", F.lit(stage.name)).withColumn("tried_attempt", F.col("attempt"))
        record = tried if record is None else record.unionByName(tried)
    good = F.col("reason").isNull()
    status = F.when(good & (F.col("stage") == len(stages) - 1), DONE).when(~good & (F.col("attempt") >= attempts), GIVEN_UP).otherwise(OPEN)
    record = record.withColumn("status", status)
    if back == 0:  # a new attempt has nothing of the last one
        record = record.withColumns({c: F.when(good, F.col(c)) for c in payload})
    return record.withColumn("attempt", F.when(good, F.col("attempt")).otherwise(F.col("attempt") + 1)).withColumn("stage", F.when(good, F.col("stage") + 1).otherwise(F.lit(back)))


def succeeded(ledger: Ledger) -> DataFrame:
    """The finished rows with their payload, and the attempt that went well."""
    return ledger.rows().where(F.col("status") == DONE).drop("stage", "attempt", "status", "tried", "reason")


def failures(ledger: Ledger, key: str) -> DataFrame:
    """``(key, stage, attempt, db, reason)``: all steps that failed."""
    return ledger.rows().where(F.col("reason").isNotNull()).select(key, F.col("tried").alias("stage"), F.col("tried_attempt").alias("attempt"), "db", "reason")


def same_results(a: DataFrame, b: DataFrame, key: str, keys: DataFrame) -> DataFrame:
    """``(key, same)`` for each of ``keys``: whether its rows in ``a`` and ``b`` are the same set.

    One grouping of both sides' rows for the results of all keys, so that each
    is read once: order and repeats don't count, nulls are equal; keys without
    rows on either side are the same.
    """
    (side,) = free(a, "side")
    both = a.withColumn(side, F.lit(1)).union(b.withColumn(side, F.lit(2)))
    differ = both.groupBy(*a.columns).agg(F.bit_or(side).alias(side)).where(F.col(side) != 3).select(key).distinct().withColumn("differs", F.lit(True))
    return keys.select(key).distinct().join(differ, key, "left").select(key, F.col("differs").isNull().alias("same"))
