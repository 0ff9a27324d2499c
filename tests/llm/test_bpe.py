from __future__ import annotations

import base64
import hashlib

import numpy as np
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import bpe, packing
from tests.llm import fixtures


@pytest.fixture(scope="module")
def both():
    path = bpe.default_path()
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return bpe.encoder(path), tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="ab \n\t'sreXY.,12é日́ 　\x1c\x85_-😀<|>", max_size=40))
def test_equals_the_library(both, text):
    own, library = both
    ids = own.encode(text)
    assert ids.tolist() == library.encode_ordinary(text)
    assert own.decode(ids) == text.encode()


def test_long_runs_and_forgetting(both, monkeypatch):
    own, library = both
    for text in ("a" * 5000, "ab" * 3000, "thequickbrownfox" * 200, " " * 500 + "x"):
        assert own.encode(text).tolist() == library.encode_ordinary(text)
    small = bpe.BytePairEncoder(own.ranks)
    small.runs.half = small.pieces.half = 5
    for _, text, _ in fixtures.texts():
        assert small.encode(text or "").tolist() == library.encode_ordinary(text or "")


def test_digests_and_round_trip(spark, both):
    library = both[1]
    df = fixtures.documents(spark)
    want = {r.doc_id: r.text or "" for r in df.collect()}
    got = bpe.digests(df).collect()
    assert len(got) == df.count()
    for r in got:
        ids = library.encode_ordinary(want[r.doc_id])
        assert r.n_tokens == len(ids)
        assert r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(want[r.doc_id].encode()).hexdigest()
    back = bpe.decode_documents(bpe.encode_documents(df)).collect()
    assert all(bytes(r.bytes).decode() == want[r.doc_id] for r in back)
    assert bpe.digests(fixtures.empty(spark)).count() == 0


@settings(max_examples=300, deadline=None)
@given(text=st.text(alphabet="ab \n'tsdmlrveABÉßµ²½.,12日Σς́\x1c\x85\xa0_-😀İ", max_size=40))
def test_words_equal_the_library(text):
    own = packing.tokenizer(packing.default_path())
    assert own.encode(text).tolist() == own.own.encode(text, add_special_tokens=False).ids
