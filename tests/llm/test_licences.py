from __future__ import annotations

import random
import re

from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.llm import licences
from tests.llm import fixtures

_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def slow(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    words = _WORD.findall(lower)
    at = [(i, label) for phrase, label in licences.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    return len(words), sorted(i for i, _ in at), sorted({label for _, label in at})


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["MIT", "license", "License,", "apache", "general", "Public", " ", "\n", "é", "x1"]), max_size=30).map(" ".join))
def test_base_places(text):
    words = licences.words(text)
    joined = b" " + b" ".join(words) + b" "
    n, at, _ = slow(text)
    assert len(words) == n
    assert sorted(i for p in licences.PHRASES for i in licences.places(joined, p.encode())) == at


def test_scan_against_brute_force(spark):
    key, text = licences.TEMPLATES["mit"]
    rows = fixtures.texts() + [(200, "x " + text + " y", "en"), (201, "Released. " + licences.TEMPLATES["gpl/note"][1].title() + ".", "en"), (202, key[:20], "en"), (203, "mit license MIT License", "en")]
    got = licences.scan(fixtures.documents(spark, rows)).collect()
    assert len(got) == len(rows) + 2
    by = {d: t for d, t, _ in rows}
    for r in got:
        if r.doc_id is None:
            continue
        n, at, base = slow(by[r.doc_id])
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (n, len(at), min(at, default=None), max(at, default=None), ",".join(base))
        assert set(base) <= set(filter(None, r.labels.split(","))) and 0 <= r.score <= 1
    said = {r.doc_id: r.labels for r in got}
    assert said[200] == "mit" and said[201] == "gpl" and said[202] == "" and said[203] == "mit"
    assert not any(said[d] for d in range(40))
    assert {r.doc_id: r.labels for r in licences.scan(fixtures.documents(spark, [(1, text, "en")], odd=False)).collect()} == {1: "mit"}


def test_search_equals_trying_every_place():
    index = licences.Index()
    index.weigh({}, 10)
    for label, (key, text) in index.templates.items():
        doc = b"some words before".split() + text[:-1] + b"changed and after".split()
        found = index.search(doc)
        name = label.split("/")[0]
        best = max(sum(1 for k, w in enumerate(text) if 0 <= s + k < len(doc) and doc[s + k] == w) / len(text) for s in range(-len(text), len(doc)))
        assert (name in found) == (b" ".join(key) in b" ".join(doc) and best >= licences.COVERAGE)
        if name in found:
            assert found[name] >= best or any(o != label and o.split("/")[0] == name for o in index.templates)


def test_a_notice_that_half_of_the_documents_carry(spark):
    labels = [x for x in licences.TEMPLATES if "/" not in x]
    rows = [(100 * k + i, "own text " + (licences.TEMPLATES[label][1] if i % 2 else "of something else"), "en") for k, label in enumerate(labels) for i in range(4)]
    rows += [(10_000 + i, licences.TEMPLATES["bsd"][1], "en") for i in range(len(rows))]
    got = {r.doc_id: r.labels for r in licences.scan(fixtures.documents(spark, rows, odd=False)).collect()}
    for k, label in enumerate(labels):
        for i in range(4):
            assert label in got[100 * k + i].split(",") if i % 2 else got[100 * k + i] == ""
    assert all(got[d] == "bsd" for d in got if d >= 10_000)


def test_labels_do_not_depend_on_other_documents():
    """The same text has the same labels whatever the words' weights are."""
    rng = random.Random(2)
    texts = [text.split() for _, text in licences.TEMPLATES.values()]
    index = licences.Index()
    for t in texts:
        doc = [w if rng.random() > 0.1 else "changed" for w in t]
        doc = " ".join(["x", *doc, *rng.choice(texts), "y"]).encode().split()
        found = set()
        for _ in range(5):
            index.weigh({w: rng.randint(0, 50) for w in index.vocabulary}, 50)
            found.add(str(sorted(index.search(doc).items())))
        assert len(found) == 1


def test_a_text_with_all_notices():
    index = licences.Index()
    index.weigh({}, 10)
    crowd = ["mozilla creative redistribution attribution gnu apache commons"]
    doc = " and ".join([*crowd, *(text for _, text in licences.TEMPLATES.values()), *crowd]).encode().split()
    found = index.search(doc)
    assert found == {label.split("/")[0]: 1.0 for label in licences.TEMPLATES}


def test_empty_table(spark):
    assert licences.scan(fixtures.empty(spark)).count() == 0


def slow_search(index, label, doc):
    """The definition: the most words in order of all bands of starts, around a key phrase."""
    key, template = index.templates[label]
    shift, best = index.shift[label], 0.0
    for low in range(-len(template), len(doc)):
        table = [[()] * (len(template) + 1) for _ in range(len(doc) + 1)]
        for i in range(len(doc)):
            for p in range(len(template)):
                fits = doc[i] == template[p] and low <= i - p <= low + shift
                table[i + 1][p + 1] = max(table[i][p] + (i,) if fits else (), table[i][p + 1], table[i + 1][p], key=len)
        chain = table[-1][-1]
        if chain and len(chain) >= licences.COVERAGE * len(template) and licences.has_phrase(doc[max(chain[0] - len(key), 0) : chain[-1] + len(key) + 1], key):
            best = max(best, len(chain) / len(template))
    return best


def test_search_equals_the_definition():
    rng = random.Random(4)
    index = licences.Index({"a": ("one two", "zero one two the three four the five six seven"), "b": ("the", "the of the and of the rare end")})
    words = [w for _, t in index.templates.values() for w in t] + [b"other"] * 4
    for _ in range(150):
        doc = [rng.choice(words) for _ in range(rng.randint(0, 8))]
        for _, t in index.templates.values():
            doc += [w for w in t for w in ([w] if rng.random() > 0.2 else rng.choice([[], [b"x"], [w, b"y"]]))] if rng.random() < 0.7 else [b"z"] * 3
        index.weigh({w: rng.randint(0, 9) for w in index.vocabulary}, 9)
        want = {label: share for label in index.templates if (share := slow_search(index, label, doc))}
        assert index.search(doc) == want


def test_a_word_put_in_left_out_or_filled_in_anywhere():
    index = licences.Index()
    index.weigh({}, 10)
    for label, (key, text) in index.templates.items():
        name = label.split("/")[0]
        for at in range(len(text) + 1):
            around = [b"before"] * 3, [b"after"] * 3
            put_in = around[0] + text[:at] + [b"jane"] + text[at:] + around[1]
            assert name in index.search(put_in), (label, at)
            filled = around[0] + text[:at] + b"2019 2021 jane and john doe".split() + text[at:] + around[1]
            if licences.has_phrase(filled, key):
                assert name in index.search(filled), (label, at)
            left_out = around[0] + text[:at] + text[at + 1 :] + around[1]
            if licences.has_phrase(left_out, key):  # the key phrase is mandatory
                assert name in index.search(left_out), (label, at)


def test_words_of_a_notice_without_its_order_are_none():
    rng, index = random.Random(1), licences.Index()
    index.weigh({}, 10)
    for label, (_, text) in index.templates.items():
        if len(text) >= 20:
            mixed = text * 3
            rng.shuffle(mixed)
            assert index.search(mixed) == {} and index.search(sorted(text)) == {}, label
