from __future__ import annotations

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import components, simhash
from tessera.llm.common import cut
from tests.llm import fixtures


def slow_fingerprint(text, k=3):
    words = (text or "").encode().lower().split()
    parts = [b" ".join(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(p, 42) for p in parts]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def roots(nodes, edges):
    up = {x: x for x in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {x: find(x) for x in nodes}


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB c\t\n é1", max_size=60))
def test_fingerprint_follows_the_definition(text):
    assert int(simhash.fingerprint(text)[0]) == slow_fingerprint(text)


def test_long_text_in_chunks(monkeypatch):
    text = fixtures.texts()[-2][1]
    monkeypatch.setattr(simhash, "CHUNK", 7)
    assert int(simhash.fingerprint(text)[0]) == slow_fingerprint(text)


def test_groups_against_brute_force(spark):
    df = fixtures.documents(spark)
    rows = [(r.doc_id, r.text) for r in df.select("doc_id", "text").collect()]
    prints = {d: slow_fingerprint(t) for d, t in rows if d is not None}
    ids = sorted(prints)
    want = roots(ids, [(a, b) for a in ids for b in ids if a < b and (prints[a] ^ prints[b]).bit_count() <= 2])
    got = simhash.near_groups(df).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.doc_id is not None:
            assert r.f[0] & (1 << 64) - 1 == prints[r.doc_id]
            assert r.component_id == want[r.doc_id]


def test_links_connect_all_within_the_radius(spark):
    base = 0x0123456789ABCDEF
    values = [base, base ^ 1, base ^ 3, base ^ 7, base ^ (1 << 63), base ^ (3 << 62), base ^ 0xFF00, 0]
    signed = [v - (1 << 64) if v >= 1 << 63 else v for v in values]
    df = spark.createDataFrame([(i, [v]) for i, v in enumerate(signed)], "doc_id long, f array<long>")
    distinct = cut(simhash.distinct_fingerprints(df))
    ids_of = {r.node: r.rep for r in distinct.collect()}
    edges = [(ids_of[r.a], ids_of[r.b]) for r in simhash.links(distinct).collect()]
    ids, far = range(len(values)), lambda a, b: (values[a] ^ values[b]).bit_count()
    assert all(far(a, b) <= 2 for a, b in edges)
    assert roots(ids, edges) == roots(ids, [(a, b) for a in ids for b in ids if far(a, b) <= 2])


def test_components_of_a_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 101), (101, 100), (7, 7)], "a long, b long")
    got = {r.node: r.root for r in components.connected_components(edges).collect()}
    assert len(got) == 63
    assert len({got[i] for i in range(61)}) == 1 and got[100] == got[101] != got[0]


def test_near_dedup_keeps_one_of_each_group(spark):
    df = fixtures.documents(spark)
    kept = simhash.near_dedup(df)
    assert kept.columns == df.columns
    ids = {r.doc_id for r in kept.collect()}
    assert {40, 41, 42} & ids == set()
    assert set(range(40)) | {43, 44, 45, 46, None} <= ids


def kept_of(spark, texts):
    df = fixtures.documents(spark, [(i, t, "en") for i, t in enumerate(texts)], odd=False)
    return {r.doc_id for r in simhash.near_dedup(df).collect()}


def test_a_repeated_line_does_not_make_copies(spark):
    line = "name amount date place total tax sum "
    texts = [line * 200 + " ".join(f"own{i}x{j}" for j in range(60)) for i in range(20)]
    assert len({tuple(simhash.fingerprint(t, 5, 5)) for t in texts}) == 1
    assert kept_of(spark, [*texts, texts[3]]) == set(range(20))


@pytest.mark.parametrize("head", [280, 7])
def test_copies_among_documents_with_one_boilerplate(spark, head):
    """Boilerplate once, and a line so often that it decides all bits: every document is in one bucket."""
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(7))
    boilerplate = (" ".join(word() for _ in range(head)) + " ") * (200 if head == 7 else 1)
    texts = []
    for _ in range(30):
        own = [word() for _ in range(60)]
        changed = [*own[:30], "changed", *own[31:]]
        texts += [f"{boilerplate}{' '.join(own)}", f"{boilerplate}{' '.join(changed)}"]
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    ids = range(len(texts))
    edges = [(a, b) for a in ids for b in range(a) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
    want = roots(ids, edges)
    assert len(set(want.values())) == 30
    assert kept_of(spark, texts) == set(want.values())


def test_an_odd_radius_is_refused(spark):
    with pytest.raises(ValueError, match="even"):
        simhash.near_groups(fixtures.documents(spark), radius=3)


def test_rows_that_repeat_an_id_go_or_stay_by_their_own_text(spark):
    rng = random.Random(7)
    a, b, c = (" ".join(f"{x}{rng.randrange(10**6)}" for _ in range(80)) for x in "abc")
    rows = [(3, a, "en"), (5, a, "en"), (5, b, "en"), (5, b, "en"), (7, b, "en"), (9, c, "en"), (9, "", "en")]
    df = fixtures.documents(spark, rows, odd=False)
    found = sorted((r.doc_id, r.component_id) for r in simhash.near_groups(df, **simhash.NEAR, **WIDE).collect())
    assert found == [(3, 3), (5, 3), (5, 5), (5, 5), (7, 5), (9, 9), (9, 9)]
    kept = sorted((r.doc_id, r.text) for r in simhash.near_dedup(df).collect())
    assert kept == sorted([(3, a), (5, b), (5, b), (9, c), (9, "")])


WIDE = simhash.widths(10, 0.8, 2)


def test_widths_follow_the_number_of_documents():
    before = 0
    for n in (0, 1, 10**4, 10**6, 10**8, 10**10):
        w = simhash.widths(n, 0.8, 2)
        assert w["bits"] >= max(before, simhash.LEAST) and n * (w["bits"] + 1) <= 2 ** w["bits"]
        before = w["bits"]


def test_recall_at_the_similarity(spark):
    """Pairs of 0.8 and a little more are found with RECALL, those of 0.75 and less are not linked."""
    rng = random.Random(11)
    rows, true, false = [], [], []
    for i in range(600):
        words = [f"w{rng.randrange(10**7)}" for _ in range(200)]
        other = list(words)
        for at in rng.sample(range(4, 196), rng.choice([3, 4, 5, 8, 12])):
            other[at] = f"x{rng.randrange(10**7)}"
        a, b = (set(simhash.shingles(" ".join(x), 5)) for x in (words, other))
        j = len(a & b) / len(a | b)
        if 0.8 <= j < 0.87:
            true.append((2 * i, 2 * i + 1))
        elif j < 0.8:
            false.append((2 * i, 2 * i + 1))
        rows += [(2 * i, " ".join(words), "en"), (2 * i + 1, " ".join(other), "en")]
    got = {r.doc_id: r.component_id for r in simhash.near_groups(fixtures.documents(spark, rows, odd=False), **simhash.NEAR, **WIDE).collect()}
    assert len(true) > 150 and len(false) > 100
    assert sum(got[b] == a for a, b in true) >= simhash.RECALL * len(true)
    assert all(got[b] == b for _, b in false)


def test_empty_table(spark):
    assert simhash.near_groups(fixtures.empty(spark)).count() == 0
    assert simhash.near_dedup(fixtures.empty(spark)).count() == 0


def test_copies_whose_repeated_line_differs_in_number_are_found(spark):
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(6))
    line = " ".join(word() for _ in range(12))
    rows = []
    for i in range(60):
        own = " ".join(word() for _ in range(200))
        rows += [(2 * i, f"{own}\n{line}"), (2 * i + 1, f"{own}\n" + "\n".join([line] * 30))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    kept = {r.doc_id for r in simhash.near_dedup(df).collect()}
    found = sum(2 * i + 1 not in kept for i in range(60))
    assert all(2 * i in kept for i in range(60)) and found >= 0.95 * 60, found


def test_members_of_a_group_that_are_not_quite_alike_make_few_pairs(spark):
    """Each with three words of one text changed, so 0.66 alike; some of them in copies that have one more changed."""
    rng = random.Random(4)
    base = [f"w{rng.randrange(10**7)}" for _ in range(150)]
    texts = []
    for i in range(60):
        words = list(base)
        for at in rng.sample(range(5, 145), 3):
            words[at] = f"x{rng.randrange(10**7)}"
        texts.append(" ".join(words))
        if i % 10 == 0:
            words[2] = "copy"
            texts.append(" ".join(words))
    df = fixtures.documents(spark, [(i, t, "en") for i, t in enumerate(texts)], odd=False)
    distinct = cut(simhash.distinct_fingerprints(simhash.fingerprints(df, 5, WIDE["bits"], WIDE["tables"], sets=True)))
    ids = distinct.selectExpr("node AS a", "node AS c")
    rep = {r.node: r.rep for r in distinct.collect()}
    got = {tuple(sorted((rep[r.a], rep[r.b]))) for r in simhash.sharing(df, ids, distinct, 5, 0.8).collect()}
    sets = [set(simhash.shingles(t, 5)) for t in texts]
    want = {(a, b) for b in range(len(texts)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    assert len(want) >= 6 and want <= got
    assert len(got) <= 3 * len(want), len(got)


def joins_made(spark, since):
    """The most rows that a join made in the executions from number ``since`` on."""
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    store, most = spark._jsparkSession.sharedState().statusStore(), 0
    for k in range(since, store.executionsCount()):
        values, nodes = store.executionMetrics(k), store.planGraph(k).allNodes()
        for node in (nodes.apply(i) for i in range(nodes.size())):
            for m in (node.metrics().apply(i) for i in range(node.metrics().size())):
                if "Join" in node.name() and m.name() == "number of output rows" and values.contains(m.accumulatorId()):
                    most = max(most, int(values.apply(m.accumulatorId()).replace(",", "")))
    return most


@pytest.mark.parametrize("several", [1, 3])
def test_a_dense_groups_buckets_are_settled_by_few_rows(spark, several):
    """All values within two bits of one, in some of which ``several`` nodes lie, in two components and more."""
    bits, rng = 28, random.Random(9)
    values = sorted({1 << i ^ 1 << j for i in range(bits) for j in range(i)} | {1 << i for i in range(bits)} | {0, (1 << 20) - 1, (1 << 20) - 2})
    rng.shuffle(values)
    rows = [(i * 3 + j, 5, [v], i * 3 + j) for i, v in enumerate(values) for j in range(several if i % 50 == 0 else 1)]
    distinct = spark.createDataFrame(rows, "node long, t long, f array<long>, s long")
    members, near = (cut(x) for x in simhash.buckets(distinct, bits, 2, 0.8))
    near = cut(near.select("t", F.array_sort("m").alias("m")).distinct())
    top = {r[0]: 0 if r[2][0] % 3 else r[0] for r in rows}
    moved = spark.createDataFrame(list(top.items()), "node long, top long")
    nodes = defaultdict(list)
    for r in members.collect():
        nodes[r.hub].append(r.node)
    held = [[x for h in r.m for x in nodes[h]] for r in near.collect()]
    want = {x for b in [*held, *nodes.values()] if len(b) > 2 and len({top[x] for x in b}) > 1 for x in b}
    since = spark._jsparkSession.sharedState().statusStore().executionsCount()
    got = {r.a: r.c for r in simhash.unsettled(members, near, moved).collect()}
    assert len(want) > 300 and got == {x: top[x] for x in want}
    inside = near.select(F.sum(F.size("m"))).head()[0]
    assert inside > 5000 and joins_made(spark, since) < 0.7 * inside


def test_parities_differ_in_no_more_bits_than_sets_differ_in_hashes(spark):
    rng = random.Random(6)
    rows = []
    for i in range(200):
        both, a, b = ([rng.getrandbits(64) - (1 << 63) for _ in range(rng.choice([0, 1, 30, 400]))] for _ in range(3))
        rows.append((i, len(a) + len(b), both + a, b + both))
    df = spark.createDataFrame(rows, "i int, n int, a array<long>, b array<long>").select("n", simhash.parities(F.col("a")).alias("x"), simhash.parities(F.col("b")).alias("y"))
    found = df.select("n", simhash.turned("x", "y").alias("bits")).collect()
    assert all(r.bits <= r.n and r.bits % 2 == r.n % 2 for r in found)
    assert all(r.bits >= 0.8 * r.n for r in found if r.n <= 60)
