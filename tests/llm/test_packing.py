from __future__ import annotations

import zlib
from collections import defaultdict

import numpy as np
import pytest
from tokenizers import Tokenizer

from tessera.llm import packing
from tests.llm import fixtures


def check(rows, capacity):
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_pieces_and_places(spark):
    more = [(300, "foo <|endoftext|> bar", "en"), (301, "a<|StartOfText|>b", "en"), (302, "<|startoftext|> x <|endoftext|>", "en"), (303, "long words " * 20_000, "en")]
    df = fixtures.documents(spark, fixtures.texts() + more)
    rows = packing.pack_documents(df, capacity=256).collect()
    own, texts = Tokenizer.from_file(packing.default_path()), {r.doc_id: r.text or "" for r in df.collect()}
    used = check(rows, 256)
    total = sum(r.length for r in rows)
    assert used <= 1.05 * total / 256 + 2
    seen = defaultdict(list)
    for r in rows:
        seen[r.doc_id].append(r)
    assert seen.keys() == texts.keys()
    for d, got in seen.items():
        ids = np.array(own.encode(texts[d], add_special_tokens=False).ids + [1], "<u4")
        for r in got:
            part = ids[r.start : r.start + r.length]
            assert r.piece == r.start // 256 and zlib.crc32(part.tobytes()) == r.ids_crc32
            assert len(part) == r.length and (r.length == 256 or r.start + r.length == len(ids))


@pytest.mark.parametrize("each", [40, 1000])
def test_rounds_lose_nothing(spark, each):
    lengths = np.random.default_rng(1).integers(1, 101, 700)
    df = spark.createDataFrame([(i, int(n)) for i, n in enumerate(lengths)], "doc_id long, length long").repartition(7)
    rows = packing.pack(df, capacity=100, slack=1, each=each).collect()
    assert sorted(r.doc_id for r in rows) == list(range(700))
    assert check(rows, 100) <= 1.1 * lengths.sum() / 100 + 1


def test_what_fits_together_is_joined_across_tasks(spark):
    """Bins of 60 fill all tasks; each of the few small ones finds room in one of them."""
    df = spark.createDataFrame([(i, 60 if i < 400 else 35) for i in range(410)], "doc_id long, length long")
    rows = packing.pack(df, capacity=100, slack=1, each=20).collect()
    assert check(rows, 100) == 400
    small = [r.length for r in rows]
    assert len(small) == 410


def test_best_fit_prefers_the_fullest_bin():
    bins, offsets, used = packing.best_fit(np.array([6, 5, 4, 5, 10]), 10)
    assert used == [10, 10, 10] and bins.tolist() == [1, 2, 1, 2, 0] and offsets.tolist() == [0, 0, 6, 5, 0]


def test_empty_table(spark):
    assert packing.pack_documents(fixtures.empty(spark)).count() == 0
