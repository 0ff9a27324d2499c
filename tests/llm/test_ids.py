"""Large ids beside a row without one stay exact in every operator."""

from __future__ import annotations

import pytest

from tessera.llm import bpe, langid, licences, packing, simhash, sketch, suffixes, telephony
from tests.llm import fixtures

IDS = [2**60 + 1, 2**60 + 3, -(2**61) - 1, 7]

OPERATORS = {
    "simhash": simhash.near_groups,
    "near_dedup": simhash.near_dedup,
    "langid": langid.identify,
    "known_language": langid.known_language,
    "suffixes": suffixes.remove_repeats,
    "without_repeats": suffixes.without_repeats,
    "licences": licences.scan,
    "bpe": bpe.digests,
    "encode": bpe.encode_documents,
    "decode": lambda d: bpe.decode_documents(bpe.encode_documents(d)),
    "packing": packing.pack_documents,
    "telephony": lambda d: telephony.inspect(telephony.store(d)),
    "expand": lambda d: telephony.expand(telephony.store(d)),
    "sketch": sketch.compare_edited,
}


@pytest.mark.parametrize("name", OPERATORS)
def test_ids_stay_exact(spark, name):
    texts = fixtures.texts(11, 8)
    rows = [(d, texts[k][1] + " and this passage is common to all of the documents of this small table", "en") for k, d in enumerate(IDS)]
    df = fixtures.documents(spark, [*rows, (None, "no id but some text", "en")], odd=False).coalesce(1)
    got = {r.doc_id for r in OPERATORS[name](df).select("doc_id").collect()}
    assert got == {*IDS, None}
