"""The folder that all machines of a cluster share, and tables cut off in it."""

from __future__ import annotations

import os
import re
import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

#: The folder that holds this library.
ROOT = str(Path(__file__).resolve().parents[2])
#: Spark removes the shuffle files of an execution at its end if this is set.
CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def reachable(spark: SparkSession) -> SparkSession:
    """Lets Python workers of this machine find the library, wherever the driver was started."""
    environment = spark.sparkContext.environment
    paths = environment.get("PYTHONPATH", "").split(os.pathsep)
    if ROOT not in paths:
        environment["PYTHONPATH"] = os.pathsep.join(filter(None, [*paths, ROOT]))
    return spark


def free(df: DataFrame, *names: str) -> list[str]:
    """Column names that start like ``names`` and that ``df`` doesn't have."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir, shared by all its machines.

    Only where none is set and all of Spark runs in this process, as in tests,
    a folder of this machine is taken; on a cluster that raises.
    """
    context = spark.sparkContext
    if not context._jsc.sc().getCheckpointDir().isDefined():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and not re.fullmatch(r"local(\[[^\]]*\])?", context.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all machines of the cluster share")
        context.setCheckpointDir(folder or tempfile.mkdtemp(prefix="tessera-checkpoint-"))
    return context._jsc.sc().getCheckpointDir().get()


_open = threading.local()
_lock = threading.Lock()
#: By session: threads that write now, and the setting before the first of them.
_writing: dict[int, tuple[int, str | None]] = {}


@contextmanager
def cleaning(spark: SparkSession) -> Iterator[None]:
    """Lets used shuffle files go; the setting is as it was before when the last of the threads inside is done."""
    key = id(spark)
    with _lock:
        n, before = _writing.get(key, (0, None))
        if not n:
            before = spark.conf.get(CLEAN, None)
            spark.conf.set(CLEAN, "true")
        _writing[key] = (n + 1, before)
    try:
        yield
    finally:
        with _lock:
            n, before = _writing[key]
            _writing[key] = (n - 1, before)
            if n == 1:
                del _writing[key]
                if before is None:
                    spark.conf.unset(CLEAN)
                else:
                    spark.conf.set(CLEAN, before)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes the tables that this thread cuts off inside, at the end.

    What is made of them must be written or read by then, or be cut off as
    ``outside``: such a table belongs to what is around.
    """
    made: list[str] = []
    stack = _open.__dict__.setdefault("stack", [])
    stack.append(made)
    try:
        yield
    finally:
        stack.pop()
        conf = spark._jsc.hadoopConfiguration()
        for path in made:
            there = spark._jvm.org.apache.hadoop.fs.Path(path)
            there.getFileSystem(conf).delete(there, True)


def cut(df: DataFrame, outside: bool = False) -> DataFrame:
    """Write ``df`` as a table in the shared folder and go on from there.

    That ends the lineage, and sizes are known again: a checkpoint would keep
    the estimates of the plan behind it, which joins multiply. What was
    shuffled on the way there is not needed again and goes. The table stays
    until the folder is cleared, or :func:`scratch` ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/cut-{uuid.uuid4().hex}"
    stack = _open.__dict__.get("stack", [])
    if len(stack) > outside:
        stack[-1 - outside].append(path)
    with cleaning(spark):
        df.select("*").write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
