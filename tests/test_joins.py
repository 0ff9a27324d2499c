"""Similarity joins against all pairs, one by one."""

from __future__ import annotations

import itertools
import random
from collections import Counter

import pytest

from tessera.operators import joins


def slow(rows, least):
    bags = {}
    for key, text in rows:
        words = Counter(w for w in (text or "").split(" ") if w)
        if words:
            bags.setdefault(frozenset(words.items()), []).append(key)
    out = []
    for a, b in itertools.combinations(bags, 2):
        x, y = Counter(dict(a)), Counter(dict(b))
        shared = sum((x & y).values())
        similarity = shared / (sum(x.values()) + sum(y.values()) - shared)
        if similarity >= least:
            out.append((*sorted((min(bags[a]), min(bags[b]))), round(similarity, 9)))
    return sorted(out), {(k, min(v)) for v in bags.values() for k in v}


def corpus(seed, n=220):
    """Skeletons of few different words, a word that most have, long texts, near copies, odd texts."""
    rng = random.Random(seed)
    rare = [f"w{i}" for i in range(60)]
    rows = []
    for i in range(n):
        kind = rng.random()
        if kind < 0.4:
            text = " ".join(["select _ from _"] + [rng.choice(["where _", "and _", "group by _", "join _ on _", "limit _"]) for _ in range(rng.randint(0, 6))])
        elif kind < 0.6:
            text = " ".join(["hot"] + [rng.choice(rare) for _ in range(rng.randint(0, 12))])
        elif kind < 0.7:
            text = " ".join(rng.choice(rare) for _ in range(rng.randint(60, 150)))
        elif rows:
            words = rng.choice(rows)[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                words[rng.randrange(len(words))] = rng.choice([*rare, "hot", "_", ""])
            text = " ".join(words)
        else:
            text = "a"
        rows.append((i, text))
    return [*rows, (n, "a"), (n + 1, "b"), (n + 2, "a b"), (n + 3, ""), (n + 4, "  "), (n + 5, "_ from select  _"), (3, "another text of key three"), (4, rows[4][1])]


@pytest.mark.parametrize("least", [0.8, 0.6, 1.0])
def test_all_pairs(spark, least):
    rows = corpus(int(least * 10))
    df = spark.createDataFrame([*rows, (900, None)], "key long, text string").selectExpr("*", "1 AS rep", "2 AS n", "'x' AS sha")
    found = joins.bag_join(df, "key", "text", least)
    pairs, members = slow(rows, least)
    assert sorted((r.left, r.right, round(r.similarity, 9)) for r in found.pairs.collect()) == pairs
    assert {(r.key, r.rep) for r in found.members.collect()} == members
    assert least == 1.0 or len(pairs) > 50
    ends = Counter(k for left, right, _ in pairs for k in (left, right))
    assert {(r.key, r.rep, r.links) for r in joins.linked(found).collect()} == {(k, rep, ends[rep]) for k, rep in members}


def test_a_word_that_all_have_makes_no_meetings(spark):
    rows = [(i, f"hot very hot indeed a{i} b{i} c{i} d{i}") for i in range(400)] + [(500, "hot very hot indeed a7 b7 c7 d7 e")]
    found = joins.bag_join(spark.createDataFrame(rows, "key long, text string"), "key", "text")
    assert [(r.left, r.right) for r in found.pairs.collect()] == [(7, 500)]


def test_empty_tables_and_wrong_bounds(spark):
    none = spark.createDataFrame([], "key long, text string")
    found = joins.bag_join(none, "key", "text")
    assert found.pairs.count() == 0 and found.members.count() == 0
    with pytest.raises(ValueError):
        joins.bag_join(none, "key", "text", 0.5)


def test_classes_are_known_by_numbers(spark, monkeypatch):
    """What is shuffled for every word, token and meeting has a class in it: a number, not a hash of 64 letters."""
    kinds, own = [], joins.by_frequency
    monkeypatch.setattr(joins, "by_frequency", lambda bags: kinds.append(dict(bags.dtypes)["rep"]) or own(bags))
    rows = spark.createDataFrame([(1, "a b c d e f g h i j"), (2, "a b c d e f g h i k"), (3, "a a")], "id long, text string")
    assert [(p["left"], p["right"]) for p in joins.bag_join(rows, "id", "text", 0.8).pairs.collect()] == [(1, 2)]
    assert kinds == ["bigint"]


def test_what_is_written_follows_the_texts(spark, monkeypatch):
    """Texts that share a rare word and little else aren't written as pairs, and no list of tokens is written or shuffled."""
    rng = random.Random(3)
    often, rare = [f"w{i}" for i in range(400)], [f"r{i}" for i in range(120)]
    rows = [(i, " ".join([*rng.choices(often, k=60), *rng.sample(rare, 20), *(f"own{i}_{k}" for k in range(3))])) for i in range(300)]
    rows += [(1000 + i, rows[i][1].replace(f"own{i}_0", "other", 1)) for i in range(10)]
    written, own = [], joins.cut

    def cut(df, *args, **kwargs):
        out = own(df, *args, **kwargs)
        written.append((out.dtypes, out.count()))
        return out

    monkeypatch.setattr(joins, "cut", cut)
    found = joins.bag_join(spark.createDataFrame(rows, "key long, text string"), "key", "text")
    assert sorted((r.left, r.right) for r in found.pairs.collect()) == [(i, 1000 + i) for i in range(10)]
    assert written and not any(t.startswith("array") for kinds, _ in written for _, t in kinds)
    assert max(n for _, n in written) <= len(rows)


def test_large_bags_and_large_groups(spark, monkeypatch):
    """Parts of large bags, bags at the borders between two numbers of parts, and groups of more bags than a block."""
    monkeypatch.setattr(joins, "GROUP", 4, raising=False)
    monkeypatch.setattr(joins, "TOGETHER", 3000, raising=False)
    rng = random.Random(4)
    rows = []
    for size in (14, 17, 90, 96, 110, 700, 768, 900, 7000):
        base = [f"w{int(rng.paretovariate(0.4)) % 5000}" for _ in range(size)]
        for _ in range(9):
            gone = rng.randint(0, size // 6)
            words = rng.sample(base, size - gone) + [f"n{rng.random()}" for _ in range(rng.randint(0, size // 9))]
            rows.append((len(rows), " ".join(words)))
    found = joins.bag_join(spark.createDataFrame(rows, "key long, text string"), "key", "text")
    pairs, members = slow(rows, 0.8)
    assert len(pairs) > 100
    assert sorted((r.left, r.right, round(r.similarity, 9)) for r in found.pairs.collect()) == pairs
    assert {(r.key, r.rep) for r in found.members.collect()} == members
