"""An index of vectors in cells: written once, read again, searched by few cells or exactly by all."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut

#: Vectors that centres are fitted on, at most: those whose keys hash lowest.
SAMPLE = 50_000
#: Cells at most, rounds of fitting, and vectors of one stored block.
CELLS, ROUNDS, BLOCK = 4096, 12, 4096
#: Share of the cells that a search looks into, and how many at least.
SHARE, LEAST = 0.25, 8
#: Vectors that are held against all centres at once.
AT_ONCE = 256


@dataclass(frozen=True)
class Index:
    """Blocks ``(cell, piece, ids, matrix)`` and centres in a folder; the centres, CELLS at most, are also in memory."""

    path: str
    blocks: DataFrame
    centres: np.ndarray

    @property
    def cells(self) -> int:
        return len(self.centres)


def unit(rows: list | pd.Series) -> np.ndarray:
    m = np.stack(list(rows)).astype(np.float64)
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def fit(sample: np.ndarray, cells: int, seed: int) -> np.ndarray:
    """Centres of the sample's unit vectors by k-means on the sphere; a cell that gets empty keeps its centre."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.permutation(len(sample))[:cells]].copy()
    for _ in range(ROUNDS):
        near = np.concatenate([(sample[i : i + BLOCK] @ centres.T).argmax(1) for i in range(0, len(sample), BLOCK)])
        sums = np.zeros_like(centres)
        np.add.at(sums, near, sample)
        norms = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(norms > 0, sums / np.where(norms > 0, norms, 1), centres)
    return centres


def packed(rows: DataFrame, keys: list[str], key: str) -> DataFrame:
    """``(keys, ids, matrix)``: the rows of each group, which is a block at most, as one row of packed unit vectors."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "ids": [pdf[key].to_numpy(np.int64).tobytes()], "matrix": [unit(pdf["embedding"]).tobytes()]})

    return rows.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} int" for k in keys) + ", ids binary, matrix binary")


def celled(vectors: DataFrame, key: str, centres: np.ndarray, probes: int) -> DataFrame:
    """``(key, embedding, cell)``: each vector with each of its ``probes`` nearest cells."""
    shared = vectors.sparkSession.sparkContext.broadcast(centres)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for at in range(0, len(pdf), AT_ONCE):
                part = pdf.iloc[at : at + AT_ONCE]
                s = unit(part["embedding"]) @ shared.value.T
                near = np.argsort(-s, axis=1, kind="stable")[:, :probes].astype(np.int32)
                yield pd.DataFrame({key: part[key], "embedding": part["embedding"], "cells": list(near)})

    found = vectors.select(F.col(key).cast("long").alias(key), F.col("embedding").cast("array<double>").alias("embedding")).where(f"{key} IS NOT NULL AND embedding IS NOT NULL")
    return found.mapInPandas(run, f"{key} long, embedding array<double>, cells array<int>").withColumn("cell", F.explode("cells")).drop("cells")


def pieces(rows: DataFrame, key: str, name: str, block: int) -> DataFrame:
    """Adds the piece of its cell that a row is in: pieces have about ``block`` rows, so a cell that has most rows is many."""
    counts = rows.groupBy("cell").agg(F.count(F.lit(1)).alias("__n"))
    joined = rows.join(F.broadcast(counts), "cell")  # one row for each cell, CELLS at most
    return joined.withColumn(name, F.pmod(F.xxhash64(key), F.ceil(F.col("__n") / block)).cast("int")).drop("__n")


def build(vectors: DataFrame, key: str, path: str, cells: int | None = None, seed: int = 17, block: int = BLOCK) -> Index:
    """Writes an index of ``vectors(key, embedding)`` to ``path``: all of them, in about sqrt(n) cells.

    Centres are fitted on SAMPLE vectors at most. Rows without key or vector
    are left out.
    """
    n = vectors.count()
    sample = vectors.where(F.col("embedding").isNotNull()).orderBy(F.xxhash64(key, F.lit(seed)), key).limit(SAMPLE).select(F.col("embedding").cast("array<double>").alias("e")).toPandas()["e"]
    cells = min(CELLS, cells or max(1, round(n**0.5)), max(1, len(sample)))
    centres = fit(unit(sample), cells, seed) if len(sample) else np.zeros((1, 1))
    placed = pieces(cut(celled(vectors, key, centres, 1)), key, "piece", block)
    packed(placed, ["cell", "piece"], key).write.mode("overwrite").parquet(f"{path}/blocks")
    spark = vectors.sparkSession
    spark.createDataFrame([(i, c.tolist()) for i, c in enumerate(centres)], "cell int, centre array<double>").write.mode("overwrite").parquet(f"{path}/centres")
    return load(spark, path)


def load(spark: SparkSession, path: str) -> Index:
    centres = [r["centre"] for r in spark.read.parquet(f"{path}/centres").orderBy("cell").toLocalIterator()]
    return Index(path, spark.read.parquet(f"{path}/blocks"), np.array(centres))


def search(index: Index, queries: DataFrame, key: str, k: int, probes: int | None = None, same: bool = False, block: int = 512) -> DataFrame:
    """``(query, rank, neighbour, similarity)``: the k most similar indexed vectors of the nearest ``probes`` cells.

    With all cells the result is exact. Ties go to the smaller id. Blocks of
    queries meet blocks of the base cell by cell; a hot cell has many blocks.
    ``same``: a vector is not its own neighbour.
    """
    probes = min(index.cells, probes or max(LEAST, round(index.cells * SHARE)))
    asked = pieces(cut(celled(queries, key, index.centres, probes)), key, "part", block)
    left = packed(asked, ["cell", "part"], key).select("cell", F.col("ids").alias("qi"), F.col("matrix").alias("qm"))
    there = index.blocks.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))
    left = left.join(F.broadcast(there), "cell").withColumn("piece", F.explode(F.sequence(F.lit(0), F.col("n").cast("int") - 1))).drop("n")
    # Pieces are numbered by hash; which numbers a cell has is known from its blocks in their order.
    order = Window.partitionBy("cell").orderBy("piece")
    right = index.blocks.select("cell", "piece", F.col("ids").alias("bi"), F.col("matrix").alias("bm"))
    numbered = index.blocks.select("cell", "piece").withColumn("at", F.row_number().over(order) - 1)
    right = right.join(F.broadcast(numbered), ["cell", "piece"]).drop("piece").withColumnRenamed("at", "piece")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for qi, qm, bi, bm in pdf[["qi", "qm", "bi", "bm"]].itertuples(index=False):
                qi, bi = np.frombuffer(qi, np.int64), np.frombuffer(bi, np.int64)
                s = np.frombuffer(qm, np.float64).reshape(len(qi), -1) @ np.frombuffer(bm, np.float64).reshape(len(bi), -1).T
                if same:
                    s[qi[:, None] == bi[None, :]] = -np.inf
                order = np.argsort(-np.round(s, 12), axis=1, kind="stable")[:, :k]  # ties go to the smaller id
                value = np.take_along_axis(s, order, 1)
                keep = np.isfinite(value).ravel()
                yield pd.DataFrame({"query": np.repeat(qi, order.shape[1])[keep], "neighbour": bi[order].ravel()[keep], "similarity": value.ravel()[keep]})

    # Each block of queries is there many times, which its files' sizes don't tell: it must not go through the driver.
    pairs = left.join(right.hint("merge"), ["cell", "piece"]).select("qi", "qm", "bi", "bm")
    found = pairs.mapInPandas(run, "query long, neighbour long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "similarity")


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """One row ``(asked, found, recall)``: how many of the exact neighbours are among those found."""
    hit = exact.select("query", "neighbour").join(found.select("query", "neighbour").withColumn("hit", F.lit(1)), ["query", "neighbour"], "left")
    return hit.agg(F.count(F.lit(1)).alias("asked"), F.count("hit").alias("found"), F.avg(F.coalesce("hit", F.lit(0))).alias("recall"))
