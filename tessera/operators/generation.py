"""Synthesis in rounds with a pluggable text generator."""

from __future__ import annotations

import hashlib
import json
import time
from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut


class TextGenerator(Protocol):
    """Completes prompts; made once for a task."""

    def __call__(self, prompts: list[str]) -> list[str]: ...


def stub(prompts: list[str]) -> list[str]:
    """A deterministic stand-in for a model: answers with a hash of the prompt; one in four is of no use."""
    out = []
    for p in prompts:
        h = hashlib.sha256(p.encode()).hexdigest()
        out.append("no answer" if int(h[0], 16) % 4 == 0 else f"<sql>SELECT {int(h[1:5], 16)}</sql><question>What is {h[:4]}?</question>")
    return out


class Retrying:
    """A generator that asks again: waits double each time, and endpoints take turns; the last failure is raised."""

    def __init__(self, endpoints: list[TextGenerator], tries: int = 3, wait: float = 1.0, sleep: Callable[[float], None] = time.sleep):
        if not endpoints or tries < 1:
            raise ValueError("an endpoint and a try are needed")
        self.endpoints, self.tries, self.wait, self.sleep, self.turn = endpoints, tries, wait, sleep, 0

    def __call__(self, prompts: list[str]) -> list[str]:
        for k in range(self.tries):
            ask = self.endpoints[self.turn % len(self.endpoints)]
            self.turn += 1
            try:
                said = ask(prompts)
                if len(said) != len(prompts):
                    raise ValueError(f"{len(said)} answers to {len(prompts)} prompts")
                return said
            except Exception:
                if k + 1 == self.tries:
                    raise
                self.sleep(self.wait * 2**k)
        raise AssertionError


def structured(generate: TextGenerator, prompts: list[str], check: Callable[[dict], str | None], tries: int = 3) -> list[tuple[dict | None, str | None]]:
    """(value, error) for each prompt: a JSON object that ``check`` has nothing against.

    What is wrong with an answer is told in the next try's prompt; after the
    last try the error stays.
    """
    out: list[tuple[dict | None, str | None]] = [(None, None)] * len(prompts)
    left, asked = list(range(len(prompts))), list(prompts)
    for _ in range(tries):
        if not left:
            break
        for i, said in zip(list(left), generate([asked[i] for i in left]), strict=True):
            value = None
            try:
                value = json.loads(said)
                wrong = check(value) if isinstance(value, dict) else "no object"
            except ValueError as e:
                wrong = f"no JSON: {e}"
            out[i] = (None, wrong) if wrong else (value, None)
            asked[i] = f"{prompts[i]}\n\nThe last answer was not accepted: {wrong}"
        left = [i for i in left if out[i][1] is not None]
    return out


def complete(rows: DataFrame, prompt: str, answer: str, make: Callable[[], TextGenerator] = lambda: stub, error: str | None = None) -> DataFrame:
    """Adds the generator's answers; a batch for which it fails has nulls, and what went wrong in ``error``, if that is named."""
    place = rows.columns.index(prompt)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        generate = make()
        for pdf in batches:
            wrong = None
            try:
                said = generate(pdf.iloc[:, place].tolist())
            except Exception as e:  # noqa: BLE001  a failed call is a missing answer
                said, wrong = [None] * len(pdf), f"{type(e).__name__}: {e}"
            yield pdf.assign(**{answer: said} | ({error: [wrong] * len(pdf)} if error else {}))

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, `{answer}` string" + (f", `{error}` string" if error else ""))


def error_summary(rows: DataFrame, kind: str) -> DataFrame:
    """One row: how many errors there are, and their kinds in order; kinds are few."""
    return rows.agg(F.count(F.lit(1)).alias("errors"), F.array_sort(F.collect_set(kind)).alias("kinds"))


def in_rounds(pending: DataFrame, key: str, attempt: Callable[[DataFrame, int], DataFrame], rounds: int, target: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(successes, failures of all rounds): what fails is tried again until all is done or rounds or target end.

    ``attempt(rows, round)`` adds a boolean ``ok`` and a ``reason``. A success
    is never tried again.
    """
    done = failed = None
    left = pending
    for k in range(rounds):
        tried = cut(attempt(left, k).withColumn("attempt", F.lit(k)))
        good, bad = tried.where("ok"), tried.where("NOT ok")
        done = good if done is None else done.unionByName(good)
        failed = bad if failed is None else failed.unionByName(bad)
        left = pending.join(done.select(key), key, "left_anti")
        if left.isEmpty() or (target is not None and done.count() >= target):
            break
    return done, failed


def token_usage(calls: DataFrame) -> DataFrame:
    """``(step, model, input, output, calls)``."""
    return calls.groupBy("step", "model").agg(F.sum("input").alias("input"), F.sum("output").alias("output"), F.count(F.lit(1)).alias("calls"))


def endpoint(place: Column, urls: list[str]) -> Column:
    """Endpoints in turn, by place."""
    return F.get(F.array(*[F.lit(u) for u in urls]), F.pmod(place, F.lit(len(urls))).cast("int"))


def demonstrations(items: Column, form: Callable[[Column], Column]) -> Column:
    """Rendered examples with a blank line between them."""
    return F.array_join(F.transform(items, form), "\n\n")


def failure(rank: Column, db: Column, attempt: Column, stage: Column, reason: Column, sql: Column, most: int = 1000) -> Column:
    """A failure record; long SQL is cut."""
    cut_ = F.when(F.length(sql) > most, F.concat(F.substring(sql, 1, most), F.lit("..."))).otherwise(sql)
    return F.struct(rank.alias("selection_rank"), db.alias("db_id"), attempt.alias("attempt_id"), stage.alias("stage"), reason.alias("reason"), cut_.alias("sql"))


def last_attempts(failures: DataFrame, key: str) -> DataFrame:
    """The last failure of each row."""
    return failures.withColumn("__r", F.row_number().over(Window.partitionBy(key).orderBy(F.desc("attempt")))).where("__r = 1").drop("__r")
