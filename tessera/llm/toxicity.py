"""Toxicity by FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

A text's features are the different hashed single words, pairs of neighbours
and pairs with one or two words between them; each counts once, so that a long
text is judged by what stands in it and not by how much else does. The learner
has a step size of its own for each coordinate and an L1 penalty that leaves
most weights at zero: the weights that remain are few and are broadcast.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import id_and_text, session, table, with_number

#: Hashed coordinates, and the distances between the two words of a pair: 1 is a bigram, more are skip-grams.
BITS, GAPS = 20, (1, 2, 3)
#: Bound of the training sample: UTF-8 bytes of text for each class, of the documents whose ids hash lowest.
CLASS_BYTES = 12_000_000
#: Step size, its smoothing, L1 and L2 penalties, and passes over the sample.
ALPHA, BETA, L1, L2, PASSES = 1.0, 1.0, 20.0, 0.1, 5
#: Texts of this score and more are toxic.
TOXIC = 0.7
#: Words that are hashed at once.
CHUNK = 1 << 16
WORD = re.compile(r"\w+")


def coordinates(text: str) -> Iterator[np.ndarray]:
    """Hashed coordinates of a text's words and pairs, chunk by chunk, with repeats; pairs span chunks."""
    words = (m.group().encode("utf-8", "surrogatepass") for m in WORD.finditer(text.lower()))
    before = np.zeros(0, np.uint64)
    while part := list(islice(words, CHUNK)):
        own = np.fromiter(map(zlib.crc32, part), np.uint64, len(part))
        yield placed(own, 0)
        h = np.concatenate([before, own])
        for gap in GAPS:
            # The second word of a pair is of this chunk, the first may be of the one before.
            second = np.arange(max(gap, len(before)), len(h))
            yield placed(h[second - gap] * np.uint64(0x9E3779B97F4A7C15) + h[second], gap)
        before = h[-max(GAPS) :]


def placed(h: np.ndarray, kind: int) -> np.ndarray:
    """Coordinates of hashes of one kind of feature."""
    mixed = (h ^ np.uint64(kind)) * np.uint64(0xD6E8FEB86659FD93)
    mixed ^= mixed >> np.uint64(32)
    return ((mixed * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(64 - BITS)).astype(np.int32)


def features(text: str) -> np.ndarray:
    """The different coordinates of a text, ascending."""
    parts = [np.unique(x) for x in coordinates(text)]
    return np.unique(np.concatenate(parts)) if parts else np.zeros(0, np.int32)


@dataclass
class Model:
    """Coordinates with a weight, ascending, their weights, and the bias."""

    index: np.ndarray
    weight: np.ndarray
    bias: float

    def dense(self) -> np.ndarray:
        out = np.zeros(1 << BITS, np.float32)
        out[self.index] = self.weight
        return out


def score(text: str | None, weights: np.ndarray, bias: float) -> float:
    """Likelihood of label 1 from the whole text; a text without words has the bias alone."""
    found = [x[weights[x] != 0] for x in coordinates(text or "")]
    known = np.unique(np.concatenate(found)) if found else []
    return float(1 / (1 + np.exp(-np.clip(bias + weights[known].sum(dtype=np.float64), -35, 35))))


class Ftrl:
    """FTRL-proximal: ``z`` and ``n`` of each coordinate, from which its weight follows when it is needed."""

    def __init__(self, size: int):
        self.z, self.n = np.zeros(size), np.zeros(size)

    def weights(self, at: np.ndarray | slice, l1: float) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= l1, 0.0, (np.sign(z) * l1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def learn(self, at: np.ndarray, w: np.ndarray, gradient: float) -> None:
        n = self.n[at]
        pace = (np.sqrt(n + gradient * gradient) - np.sqrt(n)) / ALPHA
        self.z[at] += gradient - pace * w
        self.n[at] = n + gradient * gradient


def train(rows: Iterable[tuple[np.ndarray, int]]) -> Model:
    """Weights from ``(features, label)``; both classes weigh the same in all, the bias has no penalty."""
    rows = list(rows)
    labels = np.array([y for _, y in rows], np.int64)
    counts = np.bincount(labels, minlength=2)
    if not counts.all():  # one class alone, or nothing: the share of label 1 is all that is known
        share = (counts[1] + 0.5) / (counts.sum() + 1)
        return Model(np.zeros(0, np.int32), np.zeros(0, np.float32), float(np.log(share / (1 - share))))
    each = counts.sum() / (2 * counts)
    ftrl, bias = Ftrl(1 << BITS), Ftrl(1)
    first, rng = np.zeros(1, np.int64), np.random.default_rng(5)
    for _ in range(PASSES):
        for i in rng.permutation(len(rows)):
            x, y = rows[i]
            w, b = ftrl.weights(x, L1), bias.weights(first, 0.0)
            p = 1 / (1 + np.exp(-np.clip(w.sum() + b[0], -35, 35)))
            gradient = (p - y) * each[y]
            ftrl.learn(x, w, gradient)
            bias.learn(first, b, gradient)
    w = ftrl.weights(slice(None), L1).astype(np.float32)
    index = np.flatnonzero(w).astype(np.int32)
    return Model(index, w[index], float(bias.weights(first, 0.0)[0]))


def held_out(doc_id: str = "doc_id") -> Column:
    """Whether a document is kept from training: crc32 of its id as text, mod 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def fit(docs: DataFrame, labels: DataFrame, class_bytes: int = CLASS_BYTES) -> Model:
    """A model from a bounded sample of labelled documents that are not held out.

    For each class whole texts of about ``class_bytes`` bytes are taken, those
    whose ids hash lowest, at least one document. Features are made on the
    executors. Rows without doc_id, text or label are never taken; a document
    with several labels counts once with each different one.
    """
    session(docs)
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic")).where("doc_id IS NOT NULL AND toxic IN (0, 1)").distinct()
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).where("doc_id IS NOT NULL AND text IS NOT NULL").where(~held_out())
    texts = texts.withColumn("draw", F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / (1 << 30))
    sizes = texts.select("doc_id", F.octet_length("text").alias("n"), "draw").join(known, "doc_id").groupBy("toxic").agg(F.sum("n").alias("n"), F.min("draw").alias("least"))
    upto = {r["toxic"]: max(class_bytes / max(1, r["n"]), r["least"]) for r in sizes.collect()}  # one row for each of the two classes
    if not upto:
        return train([])
    bound = F.create_map(*[F.lit(v) for k, b in sorted(upto.items()) for v in (k, float(b))])
    taken = texts.where(F.col("draw") <= max(upto.values())).join(known, "doc_id").where(F.col("draw") <= bound[F.col("toxic")])

    def run(batches):
        for pdf in batches:
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "toxic": pdf["toxic"], "crc": [zlib.crc32(t.encode("utf-8", "surrogatepass")) for t in pdf["text"]], "x": [features(t).tobytes() for t in pdf["text"]]})

    made = taken.select("doc_id", "toxic", "text").mapInPandas(run, "doc_id long, toxic int, crc long, x binary")
    rows = sorted(made.toLocalIterator(), key=lambda r: (r["doc_id"], r["toxic"], r["crc"]))
    return train((np.frombuffer(r["x"], np.int32), r["toxic"]) for r in rows)


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """``(doc_id, score, predicted)`` of every row, from the whole text alone.

    Null and empty texts and those without words have the score of the bias;
    repeated rows each give one; a null doc_id stays null; other columns are
    ignored; a very long text is hashed in chunks; equal texts have equal
    scores; an empty table gives an empty result.
    """
    session(docs)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        weights = shared.value.dense()
        for pdf in batches:
            s = np.array([score(t, weights, shared.value.bias) for t in pdf["text"]], np.float64)
            yield pd.DataFrame({"doc_id": pdf["doc_id"].to_numpy(), "score": s, "predicted": (s >= TOXIC).astype(np.int32)})

    return with_number(id_and_text(docs).mapInPandas(run, "doc_id string, score double, predicted int"))


def toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Scores of all documents, by a model that is fitted on those with labels."""
    return predict(docs, fit(docs, labels))


def op13(spark, sf_dir: str) -> DataFrame:
    said = toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return said.select("doc_id", held_out().alias("held_out"), "score", "predicted")
