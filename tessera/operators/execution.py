"""Execution of SQL held as data: result sets compared, rewards, validation.

Queries over Spark tables are compared by EXCEPT. Queries against SQLite files
run in Arrow batches, each with a deadline; failures are data.
"""

from __future__ import annotations

import hashlib
import signal
import sqlite3
import struct
import threading
import time
from collections import OrderedDict
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from functools import partial

import numpy as np
import pandas as pd
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.functions import text as T

#: Seconds that a query may take, rows that are fetched, characters of a result that are shown.
TIMEOUT, FETCH, SHOWN = 20.0, 30, 300
#: Seconds that a scorer may take for a pair.
SCORING = 300.0
#: Virtual machine steps between two looks at the clock.
STEPS = 10_000
#: Rows of a result that are read at once, different ones at most, and digests of results that a task remembers.
PIECE, MOST, KEPT = 10_000, 5_000_000, 100_000
#: Files that a task has open.
OPEN = 16


def same_rows(a: DataFrame, b: DataFrame) -> DataFrame:
    """One row ``same``: whether both have the same set of rows; order and repeats don't count, nulls are equal."""
    differ = a.subtract(b).limit(1).union(b.subtract(a).limit(1))
    return differ.agg((F.count(F.lit(1)) == 0).alias("same"))


class TooLarge(sqlite3.Error):
    """A result has more than MOST different rows: whether it equals another isn't known."""


def encoded(value: object) -> bytes:
    """A value of a result, with its type and length: numbers are equal as they are to SQL, whole floats as whole numbers."""
    if value is None:
        return b"n"
    if isinstance(value, float):
        if value.is_integer():
            value = int(value)
        else:
            return b"f" + struct.pack(">d", value)
    if isinstance(value, int):
        body, kind = b"%d" % value, b"i"
    elif isinstance(value, str):
        body, kind = value.encode("utf-8", "surrogatepass"), b"t"
    else:
        body, kind = bytes(value), b"b"
    return kind + b"%d:" % len(body) + body


def digest(cursor: sqlite3.Cursor) -> bytes:
    """A digest of the set of a result's rows: their order and repeats don't count, 1 and 1.0 are equal.

    Rows are hashed as the sequence of their values' bytes, to 128 bits; of
    these the different ones are kept sorted, MOST of them at most.
    """
    found = np.zeros(0, "S32")
    while rows := cursor.fetchmany(PIECE):
        # As hexadecimal text: arrays of bytes lose zeros at the end.
        new = np.array([hashlib.blake2b(b"".join(map(encoded, r)), digest_size=16).hexdigest() for r in rows], "S32")
        found = np.unique(np.concatenate([found, new]))
        if len(found) > MOST:
            raise TooLarge(f"the result has more than {MOST} different rows")
    return hashlib.sha256(found.tobytes()).digest()


def connect(path: str) -> sqlite3.Connection:
    """A read-only connection; whether the file is there shows when it is asked."""
    db = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    db.text_factory = lambda b: b.decode("utf-8", "replace")
    return db


class Connections:
    """Connections of a task by path; the one not used for longest is closed when there are more than OPEN."""

    def __init__(self):
        self.known: OrderedDict[str, sqlite3.Connection] = OrderedDict()

    def get(self, path: str) -> sqlite3.Connection:
        if path not in self.known:
            self.known[path] = connect(path)
        self.known.move_to_end(path)
        if len(self.known) > OPEN:
            self.known.popitem(last=False)[1].close()
        return self.known[path]

    def close(self) -> None:
        while self.known:
            self.known.popitem()[1].close()


def run_sqlite(path: str, sql: str, timeout: float = TIMEOUT, fetch: int | None = None, read: Callable[[sqlite3.Cursor], object] | None = None, connections: Connections | None = None) -> tuple[str, object, str]:
    """(status, rows, detail): ok, timeout, error, too_large, or db_not_found; rows, or what ``read`` makes of them, only if ok.

    The file is opened read-only, for this query alone if no connections are given.
    """
    own = connections or Connections()
    try:
        db = own.get(path)
        deadline = time.monotonic() + timeout
        db.set_progress_handler(lambda: time.monotonic() > deadline, STEPS)
        cursor = db.execute(sql)
        try:
            if read is not None:
                return "ok", read(cursor), ""
            return "ok", cursor.fetchall() if fetch is None else cursor.fetchmany(fetch), ""
        finally:
            cursor.close()
    except sqlite3.OperationalError as e:
        if "unable to open" in str(e):
            return "db_not_found", None, str(e)
        return ("timeout" if "interrupt" in str(e) else "error"), None, str(e)
    except TooLarge as e:
        return "too_large", None, str(e)
    except (sqlite3.Error, sqlite3.Warning) as e:
        return "error", None, str(e)
    finally:
        if connections is None:
            own.close()


def execute(rows: DataFrame, path: str, sql: str, timeout: float = TIMEOUT, fetch: int = FETCH) -> DataFrame:
    """Adds ``status``, ``n_rows``, ``result`` (cut to SHOWN characters) and ``detail`` of each row's query."""
    n_path, n_sql = rows.columns.index(path), rows.columns.index(sql)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        connections = Connections()
        for pdf in batches:
            out = []
            for p, s in zip(pdf.iloc[:, n_path], pdf.iloc[:, n_sql], strict=True):
                if not (s or "").strip():
                    out.append(("sql_empty", None, None, ""))
                    continue
                status, got, detail = run_sqlite(p, s, timeout, fetch, connections=connections)
                shown = None if got is None else str(got)
                shown = shown if shown is None or len(shown) <= SHOWN else shown[:SHOWN] + "..."
                out.append(("empty_result" if status == "ok" and not got else status, None if got is None else len(got), shown, detail))
            new = pd.DataFrame(out, columns=["status", "n_rows", "result", "detail"])
            new["n_rows"] = new["n_rows"].astype("Int32")
            yield pd.concat([pdf.reset_index(drop=True), new], axis=1)
        connections.close()

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, status string, n_rows int, result string, detail string")


def compare(rows: DataFrame, path: str, predicted: str, gold: str, timeout: float = 5.0) -> DataFrame:
    """Adds ``correct``: whether both queries of a row have the same set of result rows.

    Results are read in pieces and kept as digests only; of the gold ones the
    last KEPT used are remembered by a task. If both results have
    more than MOST different rows, ``correct`` is null: it isn't known.
    """
    n_path, n_pred, n_gold = (rows.columns.index(c) for c in (path, predicted, gold))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: OrderedDict[tuple[str, str], tuple[str, bytes | None]] = OrderedDict()
        connections = Connections()

        def results(p: str, s: str) -> tuple[str, bytes | None]:
            return run_sqlite(p, s, timeout, read=digest, connections=connections)[:2]

        def correct(p: str, s: str | None, g: str) -> bool | None:
            if (p, g) not in known:
                known[p, g] = results(p, g)
            known.move_to_end((p, g))
            if len(known) > KEPT:
                known.popitem(last=False)
            wanted, want = known[p, g]
            if s is None or wanted not in ("ok", "too_large"):
                return False
            status, got = results(p, s)
            if status == "too_large" and wanted == "too_large":
                return None
            return status == wanted == "ok" and got == want

        for pdf in batches:
            said = [correct(*x) for x in zip(pdf.iloc[:, n_path], pdf.iloc[:, n_pred], pdf.iloc[:, n_gold], strict=True)]
            yield pdf.assign(correct=pd.array(said, "boolean"))
        connections.close()

    schema = ", ".join(f"`{c}` {t}" for c, t in rows.dtypes)
    return rows.mapInPandas(run, f"{schema}, correct boolean")


def db_path(root: str, split: Column, db: Column) -> Column:
    """Path of a split's database file."""
    folder = F.when(split == "dev", "dev_databases").when(split == "question_bank", "bank_databases").otherwise("train_databases")
    return F.concat(F.lit(root + "/"), folder, F.lit("/"), db, F.lit("/"), db, F.lit(".sqlite"))


def rewards(completion: Column, correct: Column) -> Column:
    """``struct<format, exec, score, acc_exec, acc_strict>``: 1 for the format and 3 for the result."""
    form, run = T.format_reward(completion), correct.cast("double")
    return F.struct(form.alias("format"), run.alias("exec"), (form + 3 * run).alias("score"), (run > 0).alias("acc_exec"), ((form > 0) & (run > 0)).alias("acc_strict"))


def scorer_from(spark: SparkSession, path: str | None, name: str, **more) -> Callable | None:
    """The function ``name`` of the Python file at ``path``, which gets ``more`` as further keywords; None without a path.

    The file is read by Spark, so any path that its readers open will do, and
    the function goes to the tasks with what it uses of its file: the
    executors need no copy. Raises FileNotFoundError where there is no file,
    RuntimeError where it can't be run, AttributeError where it has no such
    function.
    """
    if not path:
        return None
    try:
        source = spark.read.text(path, wholetext=True).head()
    except AnalysisException as e:
        raise FileNotFoundError(f"no file of scorers: {path}") from e
    space: dict = {"__name__": "scorers"}  # no module of this name is known, so its functions are sent whole
    try:
        exec(compile(source[0] if source else "", path, "exec"), space)  # noqa: S102  running the user's file is the feature
    except Exception as e:  # noqa: BLE001  whatever the file raises
        raise RuntimeError(f"the file of scorers can't be run: {path}: {e}") from e
    if not callable(space.get(name)):
        raise AttributeError(f"no function {name} in {path}")
    return partial(space[name], **more) if more else space[name]


@contextmanager
def deadline(seconds: float | None) -> Iterator[None]:
    """Raises TimeoutError in what runs inside for longer; only a process's main thread can be stopped, as a task's is."""
    if seconds is None or threading.current_thread() is not threading.main_thread():
        yield
        return

    def late(*_: object) -> None:
        raise TimeoutError(f"more than {seconds:g} s")

    before = signal.signal(signal.SIGALRM, late)
    signal.setitimer(signal.ITIMER_REAL, seconds)
    try:
        yield
    finally:
        signal.setitimer(signal.ITIMER_REAL, 0)
        signal.signal(signal.SIGALRM, before)


def scored(function: Callable[[str | None, str | None], float], answer: Column, truth: Column, seconds: float | None = SCORING) -> Column:
    """A Python scorer as ``struct<score, error>``: pairs for which it fails, or takes longer than ``seconds``, have 0.0 and what went wrong."""

    @F.pandas_udf("score double, error string")
    def run(a: pd.Series, t: pd.Series) -> pd.DataFrame:
        out: list[tuple[float, str | None]] = []
        for x, y in zip(a, t, strict=True):
            try:
                with deadline(seconds):
                    out.append((float(function(x, y)), None))
            except Exception as e:  # noqa: BLE001  a scorer's failure is a score of nothing
                out.append((0.0, f"{type(e).__name__}: {e}"))
        return pd.DataFrame(out, columns=["score", "error"])

    return run(answer, truth)


def scores_by(function: Callable[[str | None, str | None], float], answer: Column, truth: Column) -> Column:
    """The scores of :func:`scored`."""
    return scored(function, answer, truth)["score"]


#: Ways to reward completions, by name: (completion, answer, truth) -> score.
MANAGERS: dict[str, Callable[[Column, Column, Column], Column]] = {
    "format": lambda completion, answer, truth: T.format_reward(completion),
    "result": lambda completion, answer, truth: answer.eqNullSafe(truth).cast("double"),
    "format_and_result": lambda completion, answer, truth: rewards(completion, answer.eqNullSafe(truth))["score"],
}


def reward(manager: str, completion: Column, answer: Column, truth: Column) -> Column:
    """The score by a manager's name; raises for others than MANAGERS has."""
    if manager not in MANAGERS:
        raise ValueError(f"no such reward manager: {manager}; there are {', '.join(MANAGERS)}")
    return MANAGERS[manager](completion, answer, truth)


def by_source(source: Column, scorers: dict[str, Column]) -> Column:
    """The score of a row's source; raises for a source that has no scorer."""
    out = F.raise_error(F.concat(F.lit("no scorer for "), F.coalesce(source, F.lit("null")))).cast("double")
    for name, score in scorers.items():
        out = F.when(source == name, score.cast("double")).otherwise(out)
    return out


def tool_rewards(steps: DataFrame, instance: str, step: str, score: str, penalty: float = -0.05) -> DataFrame:
    """Adds ``tool_reward`` to the calls of a scoring tool: nothing for a call that does better than the one before it, else a penalty.

    Before the first call an instance's score is 0.
    """
    before = F.lag(score, 1, 0.0).over(Window.partitionBy(instance).orderBy(step))
    return steps.withColumn("tool_reward", F.when(F.col(score) > before, 0.0).otherwise(F.lit(float(penalty))))


def gold_uses(rows: DataFrame, gold: str) -> DataFrame:
    """``(gold, used)``: each different gold query, to be run once, and how many rows want its result."""
    return rows.groupBy(gold).agg(F.count(F.lit(1)).alias("used"))
