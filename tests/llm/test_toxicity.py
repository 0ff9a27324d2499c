from __future__ import annotations

import random
import zlib

import numpy as np

from tessera.llm import toxicity
from tests.llm import fixtures

BAD = ["vile", "scab", "oaf", "dolt"]


def corpus(n=600, seed=2):
    """Documents of invented words, some with insults, and labels of most of them."""
    rng = random.Random(seed)
    rows, labels = [], []
    for i in range(n):
        words = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 4))) for _ in range(rng.choice([5, 40, 200]))]
        toxic = rng.random() < 0.3
        for _ in range(rng.randint(1, 3) if toxic else 0):
            words.insert(rng.randrange(len(words)), rng.choice(BAD))
        rows.append((i, " ".join(words), "en"))
        if rng.random() < 0.9:
            labels.append((i, 1, int(toxic)))
    return rows, labels, {i: any(w in BAD for w in t.split()) for i, t, _ in rows}


def test_held_out_texts(spark):
    rows, labels, toxic = corpus()
    docs, marks = fixtures.documents(spark, rows), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    got = [r for r in toxicity.toxicity(docs, marks).collect() if r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    said = {r.doc_id: r.predicted for r in got}
    assert np.mean([said[d] == 1 for d in said if toxic[d]]) > 0.9
    assert np.mean([said[d] == 1 for d in said if not toxic[d]]) < 0.02
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got)
    model = toxicity.fit(docs, marks)
    assert len(model.index) < 2000  # sparse: a text of 200 words has some 800 coordinates
    few = toxicity.fit(docs, marks, class_bytes=20_000)
    assert 0 < len(few.index) < len(model.index)


def test_labels_of_held_out_documents_and_other_columns_are_no_input(spark):
    rows, labels, _ = corpus(200)
    docs = fixtures.documents(spark, rows)
    turned = [(d, q, 1 - t if zlib.crc32(str(d).encode()) % 3 == 1 else t) for d, q, t in labels]
    a, b = (toxicity.fit(docs, spark.createDataFrame(x, "doc_id long, quality int, toxic int")) for x in (labels, turned))
    assert np.array_equal(a.index, b.index) and np.array_equal(a.weight, b.weight) and a.bias == b.bias
    moved = docs.selectExpr("doc_id + 1 AS doc_id", "text", "'xx' AS lang")
    assert {(r.doc_id, r.score) for r in toxicity.predict(docs, a).collect() if r.doc_id is not None} == {(r.doc_id - 1, r.score) for r in toxicity.predict(moved, a).collect() if r.doc_id is not None}


def slow_features(text):
    words, out = [zlib.crc32(w.encode()) for w in toxicity.WORD.findall(text.lower())], set()

    def put(h, kind):
        h = ((h ^ kind) * 0xD6E8FEB86659FD93) % 2**64
        out.add(((h ^ h >> 32) * 0xD6E8FEB86659FD93) % 2**64 >> 44)

    for i, w in enumerate(words):
        put(w, 0)
        for gap in toxicity.GAPS:
            if i >= gap:
                put((words[i - gap] * 0x9E3779B97F4A7C15 + w) % 2**64, gap)
    return sorted(out)


def test_features_by_brute_force_and_in_chunks(monkeypatch):
    texts = [t for _, t, _ in fixtures.texts() if t is not None] + ["", "one", "one two", "Über ÜBER straße"]
    whole = [toxicity.features(t).tolist() for t in texts]
    assert whole == [slow_features(t) for t in texts]
    for chunk in (1, 2, 5):
        monkeypatch.setattr(toxicity, "CHUNK", chunk)
        assert [toxicity.features(t).tolist() for t in texts] == whole


def test_learner_by_brute_force():
    """The recurrences of each coordinate, written out for dictionaries."""
    rng = np.random.default_rng(0)
    rows = [(np.unique(rng.integers(0, 40, 8)).astype(np.int32), int(rng.random() < 0.5)) for _ in range(30)]
    y = np.array([v for _, v in rows])
    each = len(y) / (2 * np.bincount(y))
    z, n = {}, {}

    def weight(i, l1):
        a = z.get(i, 0.0)
        if abs(a) <= l1:
            return 0.0
        return (np.sign(a) * l1 - a) / ((toxicity.BETA + n[i] ** 0.5) / toxicity.ALPHA + toxicity.L2)

    order = np.random.default_rng(5)
    for _ in range(toxicity.PASSES):
        for k in order.permutation(len(rows)):
            at = [*rows[k][0].tolist(), "bias"]
            w = {i: weight(i, 0 if i == "bias" else toxicity.L1) for i in at}
            g = (1 / (1 + np.exp(-sum(w.values()))) - rows[k][1]) * each[rows[k][1]]
            for i in at:
                pace = ((n.get(i, 0.0) + g * g) ** 0.5 - n.get(i, 0.0) ** 0.5) / toxicity.ALPHA
                z[i] = z.get(i, 0.0) + g - pace * w[i]
                n[i] = n.get(i, 0.0) + g * g
    model = toxicity.train(rows)
    dense = model.dense()
    assert abs(model.bias - weight("bias", 0)) < 1e-9
    assert all(abs(dense[i] - weight(i, toxicity.L1)) < 1e-5 for i in range(40))


def test_odd_rows_and_tables(spark):
    docs = fixtures.documents(spark)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    got = toxicity.toxicity(docs, none).collect()
    assert len(got) == docs.count() and {r.score for r in got} == {0.5}
    odd = spark.createDataFrame([(None, 1, 1), (3, 1, None), (3, 1, 1), (3, 1, 1), (5, 1, 0), (6, None, 7)], "doc_id long, quality int, toxic int").selectExpr("*", "1 AS text", "2 AS draw")
    got = toxicity.toxicity(docs, odd).collect()
    bias = {r.score for r in got if r.doc_id in (43, 44, 45, 46)}
    assert len(got) == docs.count() and len(bias) == 1
    assert toxicity.toxicity(fixtures.empty(spark), odd).count() == 0
