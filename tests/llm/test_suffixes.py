from __future__ import annotations

import hashlib
import random

import numpy as np

from tessera.llm import suffixes
from tests.llm import fixtures


def brute(rows):
    """For each row (n_bytes, n_removed, n_spans, sha, text left), rows that repeat an id being documents of their own."""
    first, out = {}, []
    for d, t in sorted(rows):
        data = t.encode()
        for i in range(len(data) - 49):
            first.setdefault(data[i : i + 50], d)
    for d, t in rows:
        data = t.encode()
        covered = bytearray(len(data))
        for i in range(len(data) - 49):
            if first[data[i : i + 50]] < d:
                covered[i : i + 50] = b"\1" * 50
        kept = bytes(b for b, c in zip(data, covered, strict=True) if not c)
        n_spans = sum(1 for i, c in enumerate(covered) if c and (i == 0 or not covered[i - 1]))
        at, text = 0, ""
        for ch in t:
            n = len(ch.encode())
            text += "" if any(covered[at : at + n]) else ch
            at += n
        out.append((len(data), sum(covered), n_spans, hashlib.sha256(kept).hexdigest(), text))
    return out


def check(spark, rows, again=True):
    df = fixtures.documents(spark, rows, again=again)
    given = [(r.doc_id, r.text or "") for r in df.collect() if r.doc_id is not None]
    want = brute(given)
    got = suffixes.remove_repeats(df).collect()
    assert len(got) == len(given) + 1
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got if r.doc_id is not None) == sorted((d, *w[:4]) for (d, _), w in zip(given, want, strict=True))
    left = suffixes.without_repeats(df)
    assert left.columns == df.columns
    assert sorted((r.doc_id, r.text or "") for r in left.collect() if r.doc_id is not None) == sorted((d, w[4]) for (d, _), w in zip(given, want, strict=True))


def test_against_brute_force(spark):
    check(spark, fixtures.texts())


def test_periodic_and_many_near_copies(spark):
    rng = random.Random(5)
    base = "".join(rng.choice("abcde ") for _ in range(900))
    rows = []
    for i in range(60):
        data = list(base)
        for _ in range(rng.randint(0, 6)):
            data[rng.randrange(len(data))] = "#"
        rows.append((i * 3, "".join(data)[rng.randint(0, 60) :], "en"))
    rows += [(500, "z" * 300, "en"), (501, "z" * 130 + base[:80], "en"), (502, "xyz" * 90, "en"), (503, "yzx" * 60, "en")]
    check(spark, rows, again=False)


def test_small_groups_and_arrays(spark, monkeypatch):
    for name, value in (("GROUP", 1500), ("SHARE", 2500), ("ARRAY", 400), ("CHUNK", 64)):
        monkeypatch.setattr(suffixes, name, value)
    assert len(list(suffixes.names(b"a" * 200))) > 1
    check(spark, fixtures.texts(8))


def test_suffix_array_and_prefixes():
    rng = np.random.default_rng(1)
    for n in (1, 2, 30, 400):
        symbols = rng.integers(1, 4, n).astype(np.int16)
        symbols[-1] = 0
        order = suffixes.suffix_array(symbols, n)
        assert order.tolist() == sorted(range(n), key=lambda i: symbols[i:].tolist())
        order, border = suffixes.equal_prefixes(symbols, 3)
        for a, b, cut in zip(order, order[1:], border[1:], strict=False):
            if min(n - a, n - b) > 3:
                assert cut == (symbols[a : a + 3].tolist() != symbols[b : b + 3].tolist())


def test_names_are_those_of_the_bytes():
    rng = random.Random(2)
    passage = bytes(rng.randrange(256) for _ in range(50))
    a, b = (b"".join([bytes(rng.randrange(256) for _ in range(k)), passage, b"tail" * 5]) for k in (17, 90))
    find = lambda data: next(v for v, first, n in zip(*suffixes.runs(data), strict=True) if first <= data.index(passage) < first + n)
    assert find(a) == find(b)


def test_cut_texts(spark):
    rows = [(1, "é" * 40 + "tail one", "en"), (2, "ü" * 10 + "é" * 40 + "\ufffd", "en"), (3, "x", "en")]
    docs = fixtures.documents(spark, rows, odd=False)
    got = {r.doc_id: (r.text, r.n_chars, r.lang) for r in suffixes.without_repeats(docs).collect()}
    assert got == {1: (rows[0][1], 48, "en"), 2: ("ü" * 10 + "\ufffd", 11, "en"), 3: ("x", 1, "en")}
    assert suffixes.without_repeats(fixtures.documents(spark)).columns == fixtures.documents(spark).columns


def test_empty_table(spark):
    assert suffixes.remove_repeats(fixtures.empty(spark)).count() == 0
    assert suffixes.without_repeats(fixtures.empty(spark)).count() == 0


def test_many_rows_without_an_id_or_with_one(spark, monkeypatch):
    """A third of the rows have no id, a third one id: they stay whole or are judged alone, in many groups."""
    monkeypatch.setattr(suffixes, "GROUP", 2000)
    passage = "a passage that stands in every one of these documents, again and again. "
    rows = [(None, passage * 2 + str(k)) for k in range(60)] + [(5, f"{k} " + passage + f"{k * k} own words") for k in range(60)] + [(100 + k, passage + f"text {k}") for k in range(60)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = suffixes.remove_repeats(df, keep_text=True).collect()
    assert len(got) == len(rows)
    by = {(r.doc_id, r.n_bytes, r.kept_sha256) for r in got}
    assert all((d, len(t), hashlib.sha256(t.encode()).hexdigest()) in by for d, t in rows[:120])
    assert all(r.n_removed >= len(passage) - 1 and r.n_spans == 1 for r in got if r.doc_id is not None and r.doc_id >= 100)
    assert df.where("doc_id = 5").select(suffixes._group(8)).distinct().count() > 1
