from __future__ import annotations

import hashlib

from pyspark.sql import functions as F

from tessera.llm import sketch
from tests.llm import fixtures


def shingles(text, n=5):
    w = (text or "").split()
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else {tuple(w)} if w else set()


def edited(rows):
    """doc_id -> (n_chars, edited text, next text) by brute force; a repeated id counts once."""
    ids = sorted(rows)
    out = {}
    for i, d in enumerate(ids):
        own, after = rows[d] or "", rows[ids[(i + 1) % len(ids)]] or ""
        half = len(own) // 2
        out[d] = (len(own), own[: len(own) - half] + after[:half], after)
    return out


def check(spark, rows, odd=True):
    df = fixtures.documents(spark, rows, odd)
    want = edited({d: t for d, t, _ in rows})
    got = sketch.compare_edited(df).collect()
    assert len(got) == df.count()
    prints = {}
    for r in got:
        if r.doc_id is None:
            assert r.near_next is None
            continue
        n, text, after = want[r.doc_id]
        own = dict((d, t) for d, t, _ in rows)[r.doc_id]
        assert r.n_chars == n and r.edited_sha256 == hashlib.sha256(text.encode()).hexdigest()
        for value, other in ((r.near_edited, text), (r.near_next, after)):
            a, b = shingles(own), shingles(other)
            true = len(a & b) / len(a | b) if a | b else 1.0
            assert abs(value - true) < 0.25 if len(a | b) > sketch.K else abs(value - true) < 1e-9
        assert prints.setdefault(own or "", r.fingerprint) == r.fingerprint


def test_against_brute_force(spark):
    check(spark, fixtures.texts())


def test_next_of_repeated_ids_is_the_smallest_text(spark):
    rows = [(1, "first of all", "en"), (1, "again", "en"), (2, "zzzz", "en"), (2, "bbbb", "en"), (2, "cccc", "en"), (2, "a", "en"), (3, "x y", "en"), (900, "q r", "en"), (900, "p", "en")]
    df = fixtures.documents(spark, rows, odd=False).repartition(5)
    after = {1: "a", 2: "x y", 3: "p", 900: "again"}
    got = sorted((r.doc_id, r.text, r.next_text) for r in sketch.with_next(df).collect())
    assert got == sorted((d, t, after[d]) for d, t, _ in rows)


def test_estimates_of_the_query_are_exact_for_short_texts(spark):
    rows = [r for r in fixtures.texts() if r[1] is None or len(r[1].split()) < 30]
    want = edited({d: t for d, t, _ in rows})
    for r in sketch.compare_edited(fixtures.documents(spark, rows, odd=False)).collect():
        a, b = shingles({d: t for d, t, _ in rows}[r.doc_id]), shingles(want[r.doc_id][1])
        assert (r.n_shingles, r.n_both) == (len(a), len(a | b))
        assert abs(r.kept - (len(a & b) / len(a) if a else 1.0)) < 1e-9


def test_scattered_ids(spark):
    rows = [(d, t, lang) for d, (_, t, lang) in zip([-(10**15), -5, 0, 1, 63, 64, 4096, 10**6, 10**6 + 1, 10**12, 2**62], fixtures.texts(), strict=False)]
    check(spark, rows, odd=False)
    check(spark, rows[:1], odd=False)


def test_only_null_ids_and_empty(spark):
    assert sketch.compare_edited(fixtures.empty(spark)).count() == 0
    df = fixtures.documents(spark, [(None, "a b", "en")], odd=False)
    assert sketch.compare_edited(df).collect()[0].near_next is None


def test_estimates_of_large_sets(spark):
    a = " ".join(f"w{i}" for i in range(3000))
    b = " ".join(f"w{i}" for i in range(1500, 4500))
    df = spark.createDataFrame([(a, b)], "a string, b string").select(sketch.sketch(F.col("a"), 256).alias("a"), sketch.sketch(F.col("b"), 256).alias("b"))
    r = df.select(sketch.resemblance(F.col("a"), F.col("b"), 256).alias("j"), sketch.containment(F.col("a"), F.col("b"), 256).alias("c"), sketch.distinct_count(F.col("a"), 256).alias("n")).head()
    assert abs(r.j - 1 / 3) < 0.1 and abs(r.c - 0.5) < 0.15 and abs(r.n - 2996) < 600


def test_merged_parts_are_the_whole(spark):
    words = [f"w{i % 700}" for i in range(2000)]
    parts = [(k % 3, " ".join(words[at : at + 54])) for k, at in enumerate(range(0, 1946, 50))]
    df = spark.createDataFrame(parts, "k int, text string").withColumn("sketch", sketch.sketch(F.col("text")))
    merged = {r.k: r.sketch for r in sketch.merge_groups(df, "k").collect()}
    for k in range(3):
        rows = df.where(F.col("k") == k).collect()
        assert merged[k] == sorted({h for r in rows for h in r.sketch})[: sketch.K]


def test_smallest_is_exact(spark):
    df = spark.range(6).select(F.transform(F.sequence(F.lit(1), (F.col("id") * 900 + 1).cast("int")), lambda i: F.xxhash64(i % 401)).alias("h"))
    for r in df.select("h", sketch.smallest(F.col("h")).alias("s")).collect():
        assert r.s == sorted(set(r.h))[: sketch.K]
