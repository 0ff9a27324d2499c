"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import ctypes
import weakref

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.sources.shared import cut, free, reachable, scratch, shared_folder

__all__ = ["ARROW_ROWS", "Memory", "buckets_for", "cut", "forget", "free", "id_and_text", "release", "scratch", "session", "shared_folder", "table", "total_bytes", "with_number"]

#: Rows in one Arrow batch: with texts of up to some 100 KB a batch stays small.
ARROW_ROWS = 512


def session(df: DataFrame) -> SparkSession:
    """The session of ``df``, set up for batches of long texts and for workers that find this library."""
    spark = reachable(df.sparkSession)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(ARROW_ROWS))
    return spark


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``(doc_id, text)`` for Python: ids are strings there, as pandas would turn numbers beside a null into floats."""
    return docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))


def with_number(df: DataFrame) -> DataFrame:
    """The ``doc_id`` of what comes back from Python as a number again."""
    return df.withColumn("doc_id", F.col("doc_id").cast("long"))


def total_bytes(df: DataFrame, text: str = "text") -> int:
    """UTF-8 bytes of all texts: the measure that bucket counts follow."""
    return df.agg(F.sum(F.octet_length(text)).alias("n")).head()["n"] or 0


def buckets_for(n_bytes: int, each: int) -> int:
    return max(1, -(-n_bytes // each))


class Memory:
    """The results of late: when one half is full, what the other half has goes."""

    known: weakref.WeakSet[Memory] = weakref.WeakSet()

    def __init__(self, half: int):
        self.half = half
        self.known.add(self)
        self.recent: dict = {}
        self.older: dict = {}

    def get(self, key):
        found = self.recent.get(key)
        if found is None and (found := self.older.get(key)) is not None:
            self.put(key, found)
        return found

    def put(self, key, value) -> None:
        self.turn()
        self.recent[key] = value

    def turn(self) -> None:
        """Starts a new half if the recent one is full."""
        if len(self.recent) >= self.half:
            self.recent, self.older = {}, self.recent


def forget() -> None:
    """Empties all memories of this process: what works on large arrays next needs the room."""
    for memory in list(Memory.known):
        memory.recent, memory.older = {}, {}
    release()


def release() -> None:
    """Gives memory that is free back to the system: a worker that waits for its next task holds what it has."""
    pa.default_memory_pool().release_unused()
    getattr(ctypes.CDLL(None), "malloc_trim", int)(0)  # only some C libraries have it
