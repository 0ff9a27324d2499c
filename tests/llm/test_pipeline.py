from __future__ import annotations

from collections import defaultdict

import pytest

import corpus_pipeline
from tests.llm import fixtures


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    """What each stage returns, written and read again."""
    folder = tmp_path_factory.mktemp("pipeline")
    docs = fixtures.documents(spark, odd=False)
    docs.write.parquet(f"{folder}/documents.parquet")
    out, docs = [docs], spark.read.parquet(f"{folder}/documents.parquet")
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, str(folder)).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        out.append(docs)
    return str(folder), out


def test_columns_and_decisions(stages):
    _, (docs, told, single, cut, packed) = stages
    for df in (told, single, cut):
        assert df.dtypes == docs.dtypes
    ids = [{r.doc_id for r in df.select("doc_id").collect()} for df in (docs, told, single, cut, packed)]
    assert {43, 44, 45, 46, 50}.isdisjoint(ids[1]) and set(range(40)) <= ids[1]
    assert {40, 41, 42}.isdisjoint(ids[2]) and set(range(40)) <= ids[2]
    assert ids[3] == ids[2] and ids[4] == ids[3]


def test_repeats_against_brute_force(stages):
    _, (_, _, single, cut, _) = stages
    before = {r.doc_id: r.text.encode() for r in single.collect()}
    after = {r.doc_id: r for r in cut.collect()}
    first = {}
    for d in sorted(before):
        data = before[d]
        covered = bytearray(len(data))
        for i in range(len(data) - 49):
            if first.setdefault(data[i : i + 50], d) < d:
                covered[i : i + 50] = b"\1" * 50
        place, kept = 0, ""
        for c in data.decode():
            n = len(c.encode())
            kept += "" if any(covered[place : place + n]) else c
            place += n
        assert after[d].text == kept and after[d].n_chars == len(kept)


def test_packed_sequences_have_no_gaps(stages):
    by = defaultdict(list)
    for r in stages[1][-1].collect():
        by[r.sequence_id].append((r.offset, r.length))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 4096


def test_odd_rows_go_through_all_stages(spark, tmp_path):
    """Rows without an id, repeated rows, ids that come again with another text, clashing columns."""
    df = fixtures.documents(spark, again=True)
    docs, frames = df, []
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, docs, "").write.parquet(f"{tmp_path}/{k}")
        docs = spark.read.parquet(f"{tmp_path}/{k}")
        frames.append(docs)
    told, single, cut, packed = frames
    assert told.dtypes == single.dtypes == cut.dtypes == df.dtypes
    rows = lambda x: sorted((r.doc_id is None, r.doc_id or 0, r.text or "") for r in x.collect())
    before, after = rows(told), rows(single)
    long = [r for r in fixtures.texts() if r[1] and len(r[1]) > 300]
    copy = (False, long[1][0], long[0][1])
    assert copy in before and copy not in after and (False, long[1][0], long[1][1]) in after
    assert cut.count() == len(after)
    assert {r.doc_id for r in packed.collect()} == {r.doc_id for r in cut.collect()}


def test_run_gives_what_the_stages_give(spark, stages):
    folder, frames = stages
    key = lambda df: sorted((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in df.collect())
    assert key(corpus_pipeline.run(spark, folder)) == key(frames[-1])


def test_empty_table(spark, tmp_path):
    fixtures.empty(spark).write.parquet(f"{tmp_path}/documents.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
