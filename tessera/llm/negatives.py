"""Hard negatives by vantage-point trees over norm-augmented vectors.

A vector x gets one component more, the root of M^2 - |x|^2 for the largest
norm M, and an anchor a zero there: then the distance of the two falls as their
inner product rises, d^2 = |q|^2 + M^2 - 2 score. The best of a label are the
nearest, and a window of scores is an annulus around the anchor.

Vectors lie in shards of bounded size, each with a tree: a node parts its
vectors by their distance from a vantage point. What the distances from the
vantage points leave open bounds a leaf's distance from an anchor; leaves are
visited nearest first, from the inner rim of the annulus outwards, until as
many rows are found as are asked for and no further leaf can hold a better
one. Scores are whole numbers and decide; distances only say where to look.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import cut, scratch, session, table

#: Vectors of a shard, of a tree's leaf, and anchors of a block.
SHARD, LEAF, BLOCK = 8192, 256, 1024
#: Blocks that meet a shard in one task at most.
TOGETHER = 64
#: Positives of an anchor, negatives of a positive.
POSITIVES, NEGATIVES = 5, 3
#: Distances are compared with so much room, of the largest square at hand: rounding never hides a row.
ROOM = 1e-9


@dataclass
class Tree:
    """Leaves as runs of rows; nodes as (vantage row, two children), each child with the distances that its rows have.

    A child is a node's number, or -1 - leaf.
    """

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    leaves: list[tuple[int, int]]
    nodes: list[tuple[int, tuple[int, float, float], tuple[int, float, float]]]

    def leaf_bounds(self, queries: np.ndarray, square: np.ndarray, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Least and largest distance that each leaf's rows can have from each query."""
        low, high = np.zeros((len(queries), len(self.leaves))), np.full((len(queries), len(self.leaves)), np.inf)
        if not self.nodes:
            return low, high
        vantage = self.vectors[[v for v, _, _ in self.nodes]]
        away = np.sqrt(np.maximum(square[:, None] + most - 2 * (queries @ vantage.T), 0))
        todo = [(0, low[:, 0].copy(), high[:, 0].copy())]
        while todo:
            k, lo, hi = todo.pop()
            for child, least, largest in self.nodes[k][1:]:
                a = np.maximum(lo, np.maximum(away[:, k] - largest, least - away[:, k]))
                b = np.minimum(hi, away[:, k] + largest)
                if child < 0:
                    low[:, -1 - child], high[:, -1 - child] = a, b
                else:
                    todo.append((child, a, b))
        return low, high


def grow(ids: np.ndarray, labels: np.ndarray, vectors: np.ndarray, most: float) -> Tree:
    """A tree of rows whose largest squared norm in the whole table is ``most``."""
    extra = np.sqrt(np.maximum(most - (vectors * vectors).sum(1), 0))
    whole = np.column_stack([vectors, extra])
    order: list[np.ndarray] = []
    tree = Tree(ids, labels, vectors, [], [])

    def part(rows: np.ndarray) -> int:
        if len(rows) <= LEAF:
            start = sum(map(len, order))
            order.append(rows[np.argsort(ids[rows], kind="stable")])  # of equal scores the first is the one with the smallest id
            tree.leaves.append((start, start + len(rows)))
            return -len(tree.leaves)
        # The row farthest from the middle is a vantage point that parts well.
        middle = whole[rows].mean(0)
        vantage = rows[int(((whole[rows] - middle) ** 2).sum(1).argmax())]
        away = np.sqrt(((whole[rows] - whole[vantage]) ** 2).sum(1))
        half = np.argsort(away, kind="stable")
        sides = half[: len(half) // 2], half[len(half) // 2 :]
        k = len(tree.nodes)
        tree.nodes.append((0, (0, 0.0, 0.0), (0, 0.0, 0.0)))
        inner, outer = ((part(rows[side]), float(away[side].min()), float(away[side].max())) for side in sides)
        tree.nodes[k] = (int(vantage), inner, outer)
        return k

    part(np.arange(len(ids)))
    rows = np.concatenate(order)
    place = np.empty(len(rows), np.int64)
    place[rows] = np.arange(len(rows))
    tree.ids, tree.labels, tree.vectors = ids[rows], labels[rows], vectors[rows]
    tree.nodes = [(int(place[v]), a, b) for v, a, b in tree.nodes]
    return tree


@dataclass
class Asked:
    """Queries of a block: their anchors' rows, and the window of scores in which rows of the same or of other labels are sought."""

    ids: np.ndarray
    labels: np.ndarray
    vectors: np.ndarray
    least: np.ndarray
    most: np.ndarray
    same: bool


def first_rows(tree: Tree, asked: Asked, most: float, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Ids and scores of the first k rows of the tree in each query's window; what is missing has score -inf.

    The distances of a leaf's rows turn into the scores they can have. Leaves
    are taken in the order of the largest score that is both theirs and in the
    window, which is nearest first from the inner rim; all queries that are at
    the same leaf in a round are answered together.
    """
    queries = len(asked.ids)
    square = (asked.vectors * asked.vectors).sum(1)
    # A vantage point's own distance from a query: the augmented part is in most.
    low, high = tree.leaf_bounds(asked.vectors, square, most)
    total = square[:, None] + most
    room = ROOM * (total + 1)
    ceiling, floor = (total - low * low) / 2 + room, np.where(np.isfinite(high), (total - high * high) / 2 - room, -np.inf)
    reach = np.where((ceiling >= asked.least[:, None]) & (floor <= asked.most[:, None]), np.minimum(ceiling, asked.most[:, None]), -np.inf)
    order = np.argsort(-reach, axis=1, kind="stable")
    best_score, best_id = np.full((queries, k), -np.inf), np.zeros((queries, k), np.int64)
    active = np.arange(queries)
    for turn in range(len(tree.leaves)):
        leaf = order[active, turn]
        bound = reach[active, leaf]
        # A row of equal score and smaller id may still come, so only a larger k-th score ends a query.
        going = np.isfinite(bound) & (best_score[active, k - 1] <= bound)
        active, leaf = active[going], leaf[going]
        if not len(active):
            break
        by_leaf = np.argsort(leaf, kind="stable")
        for group in np.split(active[by_leaf], np.flatnonzero(np.diff(leaf[by_leaf])) + 1):
            start, end = tree.leaves[order[group[0], turn]]
            s = asked.vectors[group] @ tree.vectors[start:end].T
            fits = asked.labels[group][:, None] == tree.labels[start:end][None, :]
            if asked.same:
                fits &= asked.ids[group][:, None] != tree.ids[start:end][None, :]
            else:
                fits = ~fits
            s[~(fits & (s >= asked.least[group][:, None]) & (s <= asked.most[group][:, None]))] = -np.inf
            rows, at = np.arange(len(group)), np.empty((len(group), min(k, end - start)), np.int64)
            value = np.empty(at.shape)
            for i in range(at.shape[1]):
                at[:, i] = s.argmax(1)  # the first of equals: the smallest id
                value[:, i] = s[rows, at[:, i]]
                s[rows, at[:, i]] = -np.inf
            score = np.concatenate([best_score[group], value], 1)
            ids = np.concatenate([best_id[group], tree.ids[start:end][at]], 1)
            first = np.lexsort((ids, -score), axis=1)[:, :k]
            best_score[group], best_id[group] = np.take_along_axis(score, first, 1), np.take_along_axis(ids, first, 1)
    return best_id, best_score


def whole_numbers(rows: DataFrame) -> DataFrame:
    """``(vec_id, label, v)``: rows that take part, different ones, with components floor(256 x) as doubles.

    Rows with a null id, label, vector or component, or one that isn't finite,
    take no part.
    """
    x = F.col("embedding").cast("array<double>")
    finite = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) < float("inf")))
    named = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), x.alias("embedding"))
    kept = named.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull() & finite)
    return kept.select("vec_id", "label", F.transform("embedding", lambda e: F.floor(e * 256).cast("double")).alias("v")).distinct()


def relabelled(rows: DataFrame) -> DataFrame:
    """``rows`` with wrong labels on purpose: one more, mod 10, where vec_id is divisible by 7."""
    return rows.withColumn("label", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")))


def matrix(rows, width: int) -> np.ndarray:
    """Vectors as the rows of a matrix; shorter ones end with zeros."""
    out = np.zeros((len(rows), width))
    for i, r in enumerate(rows):
        out[i, : len(r)] = r
    return out


def packed(rows: DataFrame, name: str, n: int, width: int) -> DataFrame:
    """``(name, ids, labels, vectors)``: rows in n groups of bounded size by hash, each one row of packed arrays."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["vec_id", "label"])
        return pd.DataFrame({name: [pdf[name].iloc[0]], "ids": [pdf["vec_id"].to_numpy(np.int64).tobytes()], "labels": [pdf["label"].to_numpy(np.int64).tobytes()], "vectors": [matrix(pdf["v"], width).tobytes()]})

    # The whole row is hashed, so that rows which repeat an id don't meet in one group.
    dealt = rows.withColumn(name, F.pmod(F.xxhash64("vec_id", "label", "v"), F.lit(n)).cast("int"))
    return dealt.groupBy(name).applyInPandas(run, f"{name} int, ids binary, labels binary, vectors binary")


def unpacked(ids: bytes, labels: bytes, vectors: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    i = np.frombuffer(ids, np.int64)
    return i, np.frombuffer(labels, np.int64), np.frombuffer(vectors, np.float64).reshape(len(i), -1)


def search(shards: DataFrame, blocks: DataFrame, n_shards: int, n_blocks: int, most: float, k: int, same: bool) -> DataFrame:
    """``(block, query, other_id, score)``: from each shard the first k rows for each query of each block.

    A block is ``(block, ids, labels, vectors, at, query, least, most)``: its
    anchors, and for each query the anchor it is of, its number and its window.
    Each block meets each shard once; those that meet a shard in one task are
    TOGETHER at most. Both sides are many times as large as the tables they are
    made of, which Spark's estimates don't see: neither goes through the driver.
    """
    parts = max(1, -(-n_blocks // TOGETHER))
    named = ("ids", "labels", "vectors", "at", "query", "least", "most")
    sent = blocks.select("block", F.pmod("block", F.lit(parts)).alias("part"), *(F.col(c).alias(f"q_{c}") for c in named), F.explode(F.sequence(F.lit(0), F.lit(n_shards - 1))).alias("shard"))
    there = shards.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: tuple[bytes, Tree] | None = None
        for pdf in batches:
            for r in pdf.itertuples(index=False):
                if known is None or known[0] != r.ids:  # a shard's rows come one after another
                    known = r.ids, grow(*unpacked(r.ids, r.labels, r.vectors), most)
                ids, labels, vectors = unpacked(r.q_ids, r.q_labels, r.q_vectors)
                at, query = np.frombuffer(r.q_at, np.int64), np.frombuffer(r.q_query, np.int64)
                asked = Asked(ids[at], labels[at], vectors[at], np.frombuffer(r.q_least, np.float64), np.frombuffer(r.q_most, np.float64), same)
                found, score = first_rows(known[1], asked, most, k)
                hit = np.isfinite(score)
                yield pd.DataFrame({"block": np.int32(r.block), "query": np.repeat(query, hit.sum(1)), "other_id": found[hit], "score": score[hit].astype(np.int64)})

    met = there.join(sent.hint("merge"), ["shard", "part"]).select("ids", "labels", "vectors", "block", *(f"q_{c}" for c in named))
    return met.mapInPandas(run, "block int, query long, other_id long, score long")


def first(found: DataFrame, k: int) -> DataFrame:
    """Adds ``rank`` to the first k of each query: by score, then by id."""
    w = Window.partitionBy("block", "query").orderBy(F.desc("score"), "other_id")
    return found.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def hard_negatives(rows: DataFrame, anchors_every: int = 50, positives: int = POSITIVES, negatives: int = NEGATIVES, window: tuple[int, int] = (50, 95)) -> DataFrame:
    """``(anchor_id, positive_id, rank, negative_id, positive_score, negative_score)`` of ``rows(vec_id, embedding, label)``.

    Anchors are the rows whose id is divisible by ``anchors_every``. An
    anchor's positives are its first ``positives`` rows of the same label with
    another id, by inner product of floor(256 x), ties by id; a positive's
    negatives are the first rows of other labels whose score is between the
    window's percentages of the positive's. All if there are fewer. Every
    anchor is held against all rows: the result is exact.

    Rows with a null id, label, vector or component, or one that isn't finite,
    take no part; repeated rows count once; rows that repeat an id with
    another vector or label are rows of their own; shorter vectors end with
    zeros; other columns are ignored; an empty table, or one without anchors,
    gives an empty result. Scores are exact up to 2^53.
    """
    with scratch(session(rows)):
        base = cut(whole_numbers(rows))
        is_anchor = F.col("vec_id") % anchors_every == 0
        square = F.aggregate("v", F.lit(0.0), lambda a, e: a + e * e)
        size = base.agg(F.count(F.lit(1)).alias("n"), F.count_if(is_anchor).alias("anchors"), F.max(square).alias("most"), F.max(F.size("v")).alias("width")).head()
        n_shards, n_blocks, most, width = max(1, -(-size["n"] // SHARD)), max(1, -(-size["anchors"] // BLOCK)), float(size["most"] or 0), size["width"] or 0
        shards = cut(packed(base, "shard", n_shards, width))
        blocks = cut(packed(base.where(is_anchor), "block", n_blocks, width))
        kinds = "block int, ids binary, labels binary, vectors binary, at binary, query binary, least binary, most binary"

        def each_anchor(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                n = [len(i) // 8 for i in pdf["ids"]]
                numbers, least, upto = ([make(x).tobytes() for x in n] for make in (lambda x: np.arange(x, dtype=np.int64), lambda x: np.full(x, -np.inf), lambda x: np.full(x, np.inf)))
                yield pdf.assign(at=numbers, query=numbers, least=least, most=upto)

        near = search(shards, blocks.mapInPandas(each_anchor, kinds), n_shards, n_blocks, most, positives, True)
        chosen = cut(first(near, positives))

        def each_positive(block: pd.DataFrame, found: pd.DataFrame) -> pd.DataFrame:
            if found.empty or block.empty:
                return pd.DataFrame(columns=["block", "ids", "labels", "vectors", "at", "query", "least", "most"])
            at, score = found["query"].to_numpy(np.int64), found["score"].to_numpy(np.int64)
            # In whole numbers: 100 negatives from window[0] to window[1] times the positive.
            least, upto = -((-window[0] * score) // 100), (window[1] * score) // 100
            number, open_ = at * positives + found["rank"].to_numpy(np.int64) - 1, least <= upto
            return block.assign(at=[at[open_].tobytes()], query=[number[open_].tobytes()], least=[least[open_].astype(np.float64).tobytes()], most=[upto[open_].astype(np.float64).tobytes()])

        windows = cut(blocks.groupBy("block").cogroup(chosen.groupBy("block")).applyInPandas(each_positive, kinds))
        ranked = first(search(shards, windows, n_shards, n_blocks, most, negatives, False), negatives)

        def named(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for pdf in batches:
                for r in pdf.itertuples(index=False):
                    ids = np.frombuffer(r.ids, np.int64)
                    yield pd.DataFrame({"block": np.int32(r.block), "at": np.arange(len(ids)), "anchor_id": ids})

        anchor = blocks.select("block", "ids").mapInPandas(named, "block int, at long, anchor_id long")
        pairs = chosen.select("block", F.col("query").alias("at"), (F.col("query") * positives + F.col("rank") - 1).alias("query"), F.col("other_id").alias("positive_id"), F.col("score").alias("positive_score"))
        out = ranked.join(pairs.join(anchor, ["block", "at"]), ["block", "query"])
        out = out.select("anchor_id", "positive_id", "rank", F.col("other_id").alias("negative_id"), "positive_score", F.col("score").alias("negative_score"))
        return cut(out, outside=True)


def op12(spark, sf_dir: str) -> DataFrame:
    return hard_negatives(relabelled(table(spark, sf_dir, "embeddings")))


OP12_SQL = """
WITH base AS (
  SELECT DISTINCT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS MATERIALIZED (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_dot_product(a.v, b.v)::BIGINT AS score
  FROM base a JOIN base b ON a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM scores WHERE same AND other_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank, other_id AS negative_id, positive_score, score AS negative_score
FROM positives JOIN scores USING (anchor_id) WHERE NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 3
"""
