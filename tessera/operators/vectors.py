"""Vectors: embedding, exact nearest neighbours by blocks, outliers, farthest-first selection."""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut

#: Vectors of a block.
BLOCK = 4096
#: Blocks of queries and of the base that meet in one task at most, and queries that are multiplied at once.
TOGETHER, ROWS = (8, 32), 512
#: Products of which the largest is looked at first.
RUN = 64
#: Chosen vectors after which blocks are written anew.
REFRESH = 16
#: Dimensions of the built-in embedding.
DIMENSIONS = 64

#: Turns texts into rows of a float32 matrix.
Embedder = Callable[[list[str]], np.ndarray]


def hashed_embedding(texts: list[str]) -> np.ndarray:
    """A deterministic stand-in for a model: signed hashes of tokens and of their pairs, scaled to length 1."""
    out = np.zeros((len(texts), DIMENSIONS), np.float32)
    for i, text in enumerate(texts):
        tokens = re.findall(r"\w+|[^\w\s]", text.lower())
        for part in [*tokens, *(f"{a} {b}" for a, b in zip(tokens, tokens[1:], strict=False))]:
            h = zlib.crc32(part.encode())
            out[i, h % DIMENSIONS] += 1 if h & 1 << 20 else -1
    norms = np.linalg.norm(out, axis=1, keepdims=True)
    return out / np.where(norms == 0, 1, norms)


def embed(rows: DataFrame, key: str, text: str, model: Embedder = hashed_embedding) -> DataFrame:
    """``(key, embedding)``; a model is loaded once for a task, null texts have the empty string's vector."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({key: pdf[key], "embedding": list(model([t or "" for t in pdf[text]]))})

    return rows.select(key, text).mapInPandas(run, f"{key} {dict(rows.dtypes)[key]}, embedding array<float>")


def blocks(vectors: DataFrame, key: str, n: int) -> DataFrame:
    """``(block, ids, matrix)``: vectors in n blocks by hash, each one row with packed doubles scaled to length 1."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(norms == 0, 1, norms)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf[key].to_numpy(np.int64).tobytes()], "matrix": [m.tobytes()]})

    keyed = vectors.select(key, "embedding", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"))
    return keyed.groupBy("block").applyInPandas(run, "block int, ids binary, matrix binary")


def best_of(qi: np.ndarray, qm: np.ndarray, bi: np.ndarray, bm: np.ndarray, k: int, same: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Query, neighbour and similarity of the k most similar base vectors of each query.

    Products in single precision tell which vectors can be among the k best,
    with room for their error; these few are compared in double precision.
    """
    good_q, good_b = np.isfinite(qm).all(1), np.isfinite(bm).all(1)
    qi, qm, bi, bm = qi[good_q], qm[good_q], bi[good_b], bm[good_b]
    first = np.argsort(bi, kind="stable")  # ties go to the smaller id
    bi, bm = bi[first], bm[first]
    own = int(np.unique(bi, return_counts=True)[1].max(initial=0)) if same else 0  # so many of the best may be the query's own
    small, room = bm.astype(np.float32), (bm.shape[1] + 8) * 2.0**-23 + 1e-11
    queries, neighbours, values = [], [], []
    for at in range(0, len(qi), ROWS):
        ids, x = qi[at : at + ROWS], qm[at : at + ROWS]
        x32, kth = x.astype(np.float32), np.full(len(ids), -np.inf)
        row, col, value = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for start in range(0, len(bi), BLOCK):
            s = x32 @ small[start : start + BLOCK].T
            if not start:
                most = min(k + own, s.shape[1])
                kth = np.where(most > k, np.partition(s, s.shape[1] - most, axis=1)[:, s.shape[1] - most] - room, -np.inf)
            least = (kth - room).astype(np.float32)
            width = RUN if s.shape[1] % RUN == 0 else s.shape[1]
            # Runs whose largest product is too small are left at that.
            run_row, run = np.nonzero(s.reshape(len(ids), -1, width).max(2) >= least[:, None])
            in_run, c = np.nonzero(s.reshape(len(ids), -1, width)[run_row, run] >= least[run_row][:, None])
            r, c = run_row[in_run], run[in_run] * width + c
            crowded = np.flatnonzero(np.bincount(r, minlength=len(ids)) > 16 * (k + own))
            if len(crowded):  # many are as near as the k-th: these rows are compared as a whole
                few = ~np.isin(r, crowded)
                r, c = r[few], c[few]
            v = np.einsum("ij,ij->i", x[r], bm[start + c])
            for i in range(0, len(crowded), 64):
                rows = crowded[i : i + 64]
                exact = x[rows] @ bm[start : start + BLOCK].T
                if same:
                    exact[ids[rows][:, None] == bi[start : start + BLOCK][None, :]] = -np.inf
                order = np.argsort(-np.round(exact, 12), axis=1, kind="stable")[:, :k]
                r, c, v = np.concatenate([r, np.repeat(rows, order.shape[1])]), np.concatenate([c, order.ravel()]), np.concatenate([v, np.take_along_axis(exact, order, 1).ravel()])
            keep = np.isfinite(v) & ~(same & (ids[r] == bi[start + c]))
            if not keep.any():
                continue
            row, col, value = np.concatenate([row, r[keep]]), np.concatenate([col, start + c[keep]]), np.concatenate([value, v[keep]])
            best = np.lexsort((col, -np.round(value, 12), row))
            row, col, value = row[best], col[best], value[best]
            place = np.arange(len(row)) - np.searchsorted(row, row)
            top = place < k
            row, col, value, place = row[top], col[top], value[top], place[top]
            last = place == k - 1
            kth[row[last]] = np.maximum(kth[row[last]], value[last])
        queries.append(ids[row])
        neighbours.append(bi[col])
        values.append(value)
    return tuple(np.concatenate(x) if x else np.zeros(0, kind) for x, kind in ((queries, np.int64), (neighbours, np.int64), (values, np.float64)))


def nearest(queries: DataFrame, base: DataFrame, key: str, k: int, same: bool = False, block: int = BLOCK) -> DataFrame:
    """``(query, rank, neighbour, similarity)``: the k most similar vectors of ``base`` for each query, exactly.

    Both sides are packed into blocks. Some blocks of queries meet many of the
    base in a task of bounded size, which sends k candidates a query; the best
    k are kept. So a vector of one side is sent once for each of the other
    side's many, not for each block. Ties go to the smaller id. ``same``: a
    vector is not its own neighbour. Work is the number of queries times that
    of the base: for large bases ask ``operators.index``.
    """
    n_base, n_queries = max(1, -(-base.count() // block)), max(1, -(-queries.count() // block))
    wide = -(-n_base // TOGETHER[1])
    n_right = -(-n_base // wide)
    # Few queries at a time as long as there would be too few tasks.
    n_left = max(1, min(TOGETHER[0], n_queries * wide // 24))
    high = -(-n_queries // n_left)
    left = cut(blocks(queries, key, n_queries)).withColumn("high", F.expr(f"CAST(block DIV {n_left} AS INT)")).withColumn("wide", F.explode(F.sequence(F.lit(0), F.lit(wide - 1))))
    right = cut(blocks(base, key, n_base)).withColumn("wide", F.expr(f"CAST(block DIV {n_right} AS INT)")).withColumn("high", F.explode(F.sequence(F.lit(0), F.lit(high - 1))))

    def run(q: pd.DataFrame, b: pd.DataFrame) -> pd.DataFrame:
        found = [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
        if len(q) and len(b):
            found = best_of(*unpacked(q), *unpacked(b), k, same)
        return pd.DataFrame(dict(zip(("query", "neighbour", "similarity"), found, strict=True)))

    parts = max(1, min(2 * wide * high, 10_000))
    sides = [x.select("high", "wide", "ids", "matrix").repartition(parts, "high", "wide").groupBy("high", "wide") for x in (left, right)]
    found = sides[0].cogroup(sides[1]).applyInPandas(run, "query long, neighbour long, similarity double")
    w = Window.partitionBy("query").orderBy(F.desc(F.round("similarity", 12)), "neighbour")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k).select("query", "rank", "neighbour", "similarity")


def unpacked(blocks_: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Ids and vectors of some blocks."""
    ids = np.frombuffer(b"".join(blocks_["ids"]), np.int64)
    return ids, np.frombuffer(b"".join(blocks_["matrix"]), np.float64).reshape(len(ids), -1)


def outliers(vectors: DataFrame, key: str, k: int, found: DataFrame | None = None) -> DataFrame:
    """``(key, nearest_sim, mean_sim, outlier)`` from the k nearest others; a vector without others has similarity 0.

    ``found``: the neighbours, where another search than the exact one has
    found them (``operators.index.search``).
    """
    near = nearest(vectors, vectors, key, k, same=True) if found is None else found
    near = near.groupBy(F.col("query").alias(key)).agg(F.max("similarity").alias("nearest_sim"), F.avg("similarity").alias("mean_sim"))
    out = vectors.select(key).join(near, key, "left").na.fill(0.0, ["nearest_sim", "mean_sim"])
    return out.withColumn("outlier", 1 - F.col("mean_sim"))


def keep_inliers(scores: DataFrame, threshold: float, needed: int) -> DataFrame:
    """Rows with an outlier score within the threshold; an error if fewer than needed are left."""
    kept = scores.where(F.col("outlier") <= threshold)
    if (n := kept.count()) < needed:
        raise ValueError(f"{n} rows are within {threshold}, {needed} are needed")
    return kept


def distance_to(candidates: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """``(key, distance)``: 1 less the largest similarity to an existing vector."""
    near = nearest(candidates, existing, key, 1)
    return near.select(F.col("query").alias(key), (1 - F.col("similarity")).alias("distance"))


def farthest_first(candidates: DataFrame, start: DataFrame, key: str, k: int) -> DataFrame:
    """``(selection_rank, key, distance)``: k times the candidate farthest from all that are chosen, the smallest id of equals.

    ``start(key, distance)`` has the distances to what exists already. Blocks
    of vectors stay on the executors; a step sends one vector to them and
    brings back the farthest candidate of each block. Every REFRESH steps the
    blocks are written anew with the distances to all that is chosen, so a step
    compares with REFRESH vectors at most, however many are chosen. Distances
    within 1e-6 below 0 count as 0; selection ends when nothing is left.
    """
    n = max(1, -(-candidates.count() // BLOCK))
    first = candidates.join(start, key).select(key, "embedding", F.pmod(F.xxhash64(key), F.lit(n)).cast("int").alias("block"), "distance")

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key)
        m = np.stack(pdf["embedding"].to_numpy()).astype(np.float64)
        norms = np.linalg.norm(m, axis=1, keepdims=True)
        m = m / np.where(norms == 0, 1, norms)
        return pd.DataFrame({"block": [pdf["block"].iloc[0]], "ids": [pdf[key].to_numpy(np.int64).tobytes()], "matrix": [m.tobytes()], "start": [pdf["distance"].to_numpy(np.float64).tobytes()]})

    def distances(ids: bytes, matrix: bytes, start_: bytes, centers: np.ndarray, done: list[int]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids, vectors and their distances; what has been chosen is at minus infinity."""
        i = np.frombuffer(ids, np.int64)
        m = np.frombuffer(matrix, np.float64).reshape(len(i), -1)
        d = np.frombuffer(start_, np.float64)
        if len(centers):
            d = np.minimum(d, 1 - (m @ centers.T).max(1))
        return i, m, np.where(np.isin(i, done), -np.inf, np.where(d > -1e-6, np.maximum(d, 0), d))

    packed = cut(first.groupBy("block").applyInPandas(pack, "block int, ids binary, matrix binary, start binary"))
    chosen: list[tuple[int, int, float]] = []
    centers: list[np.ndarray] = []
    done: list[int] = []
    for rank in range(k):

        def best(batches: Iterator[pd.DataFrame], centers=np.array(centers), done=tuple(done)) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                rows = []
                for ids, matrix, start_ in pdf[["ids", "matrix", "start"]].itertuples(index=False):
                    ids, m, d = distances(ids, matrix, start_, centers, done)
                    i = int(d.argmax())
                    if np.isfinite(d[i]) and d[i] >= 0:
                        rows.append((int(ids[i]), float(d[i]), m[i]))
                yield pd.DataFrame(rows, columns=["id", "distance", "vector"])

        top = packed.mapInPandas(best, "id long, distance double, vector array<double>").orderBy(F.desc(F.round("distance", 12)), "id").limit(1).collect()
        if not top:
            break
        chosen.append((rank, top[0]["id"], top[0]["distance"]))
        centers.append(np.array(top[0]["vector"]))
        done.append(top[0]["id"])
        if len(centers) == REFRESH and rank + 1 < k:

            def refresh(batches: Iterator[pd.DataFrame], centers=np.array(centers), done=tuple(done)) -> Iterator[pd.DataFrame]:
                for pdf in batches:
                    pdf["start"] = [distances(*x, centers, done)[2].tobytes() for x in pdf[["ids", "matrix", "start"]].itertuples(index=False)]
                    yield pdf

            packed = cut(packed.mapInPandas(refresh, packed.schema))
            centers, done = [], []
    return candidates.sparkSession.createDataFrame(chosen, f"selection_rank int, {key} long, distance double")
