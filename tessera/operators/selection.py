"""Farthest-first selection with bounds: several picks a job, and only the blocks that can hold one."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.operators.vectors import distance_to
from tessera.sources.shared import cut

#: Vectors of a block, and candidates that a job brings to the driver at most: what a job picks from.
BLOCK, POOL = 1024, 512
#: Distances within this below 0 count as 0; distances are compared to so many digits.
SLACK, DIGITS = 1e-6, 12


@dataclass(frozen=True)
class Selected:
    """``picks(selection_rank, key, distance)``, how many jobs ran over the blocks, and how many times a block was opened."""

    picks: DataFrame
    jobs: int
    opened: int


def blocks(candidates: DataFrame, start: DataFrame, key: str, cells: int) -> DataFrame:
    """``(cell, piece, ids, matrix, distance, centre, angle, most, opened)``: neighbours together, about BLOCK vectors at most.

    Vectors go to the nearest of some of them; large cells are cut by hash. A
    block's angle is that of its farthest vector from its centre, so that it
    bounds how near a vector elsewhere can be to any of the block.
    """
    named = candidates.select(F.col(key).cast("long").alias("id"), F.col("embedding").cast("array<double>").alias("e")).join(start.select(F.col(key).cast("long").alias("id"), "distance"), "id").where("id IS NOT NULL AND e IS NOT NULL")
    seeds = named.orderBy(F.xxhash64("id", F.lit(5)), "id").limit(cells).select("e").toPandas()["e"]  # bounded by cells
    centres = unit(list(seeds)) if len(seeds) else np.zeros((1, 1))
    shared = candidates.sparkSession.sparkContext.broadcast(centres)

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                x = unit(list(pdf["e"]))
                yield pd.DataFrame({"id": pdf["id"], "distance": pdf["distance"], "v": [r.tobytes() for r in x], "cell": (x @ shared.value.T).argmax(1).astype(np.int32)})

    placed = cut(named.mapInPandas(place, "id long, distance double, v binary, cell int"))
    sizes = placed.groupBy("cell").agg(F.count(F.lit(1)).alias("n"))  # a row for each cell
    dealt = placed.join(F.broadcast(sizes), "cell").withColumn("piece", F.pmod(F.xxhash64("id"), F.ceil(F.col("n") / (0.8 * BLOCK))).cast("int"))

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("id")
        m = np.frombuffer(b"".join(pdf["v"]), np.float64).reshape(len(pdf), -1)
        centre = m.mean(0)
        centre = centre / (np.linalg.norm(centre) or 1.0)
        angle = float(np.arccos(np.clip((m @ centre).min(), -1, 1)))
        d = clamped(pdf["distance"].to_numpy(np.float64))
        return pd.DataFrame({"cell": [pdf["cell"].iloc[0]], "piece": [pdf["piece"].iloc[0]], "ids": [pdf["id"].to_numpy(np.int64).tobytes()], "matrix": [m.tobytes()], "distance": [d.tobytes()], "centre": [centre.tobytes()], "angle": [angle], "most": [float(d.max())], "opened": [0]})

    return dealt.groupBy("cell", "piece").applyInPandas(pack, "cell int, piece int, ids binary, matrix binary, distance binary, centre binary, angle double, most double, opened long")


def unit(rows: list) -> np.ndarray:
    m = np.stack([np.asarray(r, np.float64) for r in rows])
    norms = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(norms == 0, 1, norms)


def clamped(d: np.ndarray) -> np.ndarray:
    return np.where((d > -SLACK) & (d < 0), 0.0, d)


def touched(centre: np.ndarray, angle: float, most: float, picks: np.ndarray) -> np.ndarray:
    """Which picks can be nearer to one of the block's vectors than ``most``, the largest distance that any of them has.

    A pick is at the angle t from the centre, so at t - angle at least from
    each vector; its distance from them is 1 - cos of that at least.
    """
    least = np.maximum(np.arccos(np.clip(picks @ centre, -1, 1)) - angle, 0)
    return 1 - np.cos(least) < most + SLACK


def farthest_first(candidates: DataFrame, start: DataFrame, key: str, k: int, pool: int = POOL, cells: int = 256) -> Selected:
    """k times the candidate farthest from all that are chosen, the smallest id of equals: the greedy selection itself.

    ``start(key, distance)`` has the distances to what exists already. A job
    brings the ``pool`` candidates that are farthest now to the driver, and the
    largest distance among all others, the floor. Distances only fall, so as
    long as the farthest of the pool is above the floor it is the farthest of
    all: picks are made of the pool alone until that ends. Then the next job
    lowers the distances of the blocks that a new pick can reach; the others
    keep theirs, unopened. Distances within 1e-6 below 0 count as 0; selection
    ends when nothing is left, or nothing that is not nearer than 0.

    Rows without key, vector or start distance are left out.
    """
    spark = candidates.sparkSession
    packed = cut(blocks(candidates, start, key, cells))
    chosen: list[tuple[int, int, float]] = []
    fresh, jobs = np.zeros((0, 1)), 0
    while len(chosen) < k:
        if len(fresh):
            shared = spark.sparkContext.broadcast((fresh, np.array([c[1] for c in chosen], np.int64)))

            def lower(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
                picks, done = shared.value
                for pdf in batches:
                    distance, most, opened = [], [], []
                    for r in pdf.itertuples(index=False):
                        d, top = r.distance, r.most
                        reach = touched(np.frombuffer(r.centre, np.float64), r.angle, top, picks)
                        if reach.any():
                            ids = np.frombuffer(r.ids, np.int64)
                            m = np.frombuffer(r.matrix, np.float64).reshape(len(ids), -1)
                            x = clamped(np.minimum(np.frombuffer(d, np.float64), 1 - (m @ picks[reach].T).max(1)))
                            x = np.where(np.isin(ids, done), -np.inf, x)
                            d, top = x.tobytes(), float(x.max())
                        distance.append(d)
                        most.append(top)
                        opened.append(r.opened + bool(reach.any()))
                    yield pdf.assign(distance=distance, most=most, opened=opened)

            packed = cut(packed.mapInPandas(lower, packed.schema))
            jobs += 1
        jobs += 1

        def farthest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    d, ids = np.round(np.frombuffer(r.distance, np.float64), DIGITS), np.frombuffer(r.ids, np.int64)
                    first = np.lexsort((ids, -d))[: pool + 1]
                    first = first[d[first] >= 0]
                    m = np.frombuffer(r.matrix, np.float64).reshape(len(ids), -1)
                    exact = np.frombuffer(r.distance, np.float64)
                    yield pd.DataFrame({"id": ids[first], "distance": exact[first], "v": [m[i].tobytes() for i in first]})

        # The pool's smallest distance, to as many digits as are compared, bounds all that isn't in it.
        rows = packed.mapInPandas(farthest, "id long, distance double, v binary").orderBy(F.desc(F.round("distance", DIGITS)), "id").limit(pool + 1).collect()
        if not rows:
            break
        more = len(rows) > pool
        floor = (round(rows[pool]["distance"], DIGITS), -rows[pool]["id"]) if more else (-np.inf, 0)
        rows = rows[:pool]
        ids, d = np.array([r["id"] for r in rows]), np.array([r["distance"] for r in rows])
        m = np.frombuffer(b"".join(r["v"] for r in rows), np.float64).reshape(len(rows), -1)
        new: list[int] = []
        while len(chosen) < k:
            rounded = np.round(d, DIGITS)
            at = int(np.lexsort((ids, -rounded))[0])
            # The first of a job is the farthest of all, even where repeated rows make it equal to the floor.
            if d[at] < 0 or new and (float(rounded[at]), -int(ids[at])) <= floor:
                break
            chosen.append((len(chosen), int(ids[at]), float(d[at])))
            new.append(at)
            d = clamped(np.minimum(d, 1 - m @ m[at]))
            d[at] = -np.inf
        fresh = m[new]
        if not new:
            break
    opened = packed.agg(F.sum("opened").alias("n")).head()["n"]
    return Selected(spark.createDataFrame(chosen, f"selection_rank int, {key} long, distance double"), jobs, opened or 0)


def report(picks: DataFrame) -> DataFrame:
    """One row ``(selected, min, p50, p95, max)``: the distances that picks had from all before them; percentiles interpolate."""
    at = F.percentile("distance", F.array(F.lit(0.5), F.lit(0.95)))  # picks are as many as were asked for
    return picks.agg(F.count(F.lit(1)).alias("selected"), F.min("distance").alias("min"), at.alias("p"), F.max("distance").alias("max")).select("selected", "min", F.col("p")[0].alias("p50"), F.col("p")[1].alias("p95"), "max")


def complementary(candidates: DataFrame, existing: DataFrame, key: str, k: int) -> Selected:
    """k candidates that complement ``existing``: farthest first from it and from each other."""
    return farthest_first(candidates, distance_to(candidates, existing, key), key, k)
