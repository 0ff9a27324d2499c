"""A text of some hundred kilobytes among short ones, whole in every operator."""

from __future__ import annotations

import hashlib
import json
import random

import pytest

from tessera.llm import langid, licences, simhash, sketch, telephony, toolcalls
from tests.llm import fixtures


@pytest.fixture(scope="module")
def long():
    rng = random.Random(8)
    parts = ["the", "and", "er", "ing", "tion", "th", "of", "a", "ou", "ly"]
    words = ["".join(rng.choice(parts) for _ in range(rng.randint(1, 4))) for _ in range(60_000)]
    return " ".join(words) + " MIT License"


@pytest.fixture(scope="module")
def docs(spark, long):
    return fixtures.documents(spark, [*fixtures.texts(), (900, long, "en"), (901, long + " end", "en")]).cache()


def rows(df):
    return {r.doc_id: r for r in df.where("doc_id >= 900").collect()}


def test_language(docs):
    got = rows(langid.identify(docs))
    assert got[900].lang_pred == got[901].lang_pred == "en"


def test_licences(docs, long):
    got = rows(licences.scan(docs))
    assert got[900].n_words == len(long.split()) and got[900].last_word == len(long.split()) - 2 and got[900].base_labels == "mit"


def test_audio(docs, long):
    got = rows(telephony.inspect(telephony.store(docs)))
    full = telephony.payload(long)[0]
    assert got[900].payload_sha256 == hashlib.sha256(full).hexdigest() and got[900].n_bytes == len(long)


def test_sketches(docs, long):
    got = rows(sketch.compare_edited(docs))
    w = long.split()
    n = len({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    assert abs(got[900].n_shingles - n) < 0.5 * n and got[900].near_next > 0.9 and got[900].n_chars == len(long)


def test_near_copies(docs):
    assert {r.doc_id for r in simhash.near_dedup(docs).where("doc_id >= 900").collect()} == {900}


def test_tool_calls(spark, long):
    df = spark.createDataFrame([(1, 0, "user", long), (1, 1, "assistant", long)], "conv_id long, turn long, role string, text string")
    got = toolcalls.link(*toolcalls.from_conversations(df), toolcalls.REPLY).head()
    assert json.loads(got.json)["content"] == long == json.loads(got.json)["arguments"]["question"] and got.status == "linked"
