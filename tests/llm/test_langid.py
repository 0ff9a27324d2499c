from __future__ import annotations

import zlib

import numpy as np

from tessera.llm import langid
from tests.llm import fixtures


def test_held_out_accuracy(spark):
    df = fixtures.documents(spark, fixtures.texts(5, 120))
    got = langid.identify(df).collect()
    lang = {r.doc_id: r.lang for r in df.collect()}
    known = [r for r in got if r.doc_id is not None and r.doc_id < 120 and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    assert len(known) > 20
    assert np.mean([r.lang_pred == lang[r.doc_id] for r in known]) >= 0.95


def test_undetermined_and_bounds(spark):
    df = fixtures.documents(spark)
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(langid.identify(df).collect()) == df.count()
    for d in (43, 44, 45, 46, 50):
        assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
    assert all(0 <= r.score <= 1 and r.lang_pred in ("en", "de", "und") for r in got.values())
    kept = langid.known_language(df)
    assert kept.columns == df.columns and {43, 44, 45, 46, 50}.isdisjoint({r.doc_id for r in kept.collect()})


def test_labels_are_no_input(spark):
    df = fixtures.documents(spark)
    model = langid.fit(df)
    a = {r.doc_id: r.lang_pred for r in langid.predict(df, model).collect()}
    b = {r.doc_id: r.lang_pred for r in langid.predict(df.selectExpr("doc_id", "text", "'xx' AS lang"), model).collect()}
    assert a == b


def test_no_training_data(spark):
    assert langid.identify(fixtures.empty(spark)).count() == 0
    unlabelled = fixtures.documents(spark).selectExpr("doc_id", "text", "CAST(NULL AS STRING) AS lang")
    assert {r.lang_pred for r in langid.identify(unlabelled).collect()} == {"und"}


def test_codewords_are_far_apart():
    for n in (2, 4, 6, 9, 30):
        c = langid.codewords(n)
        differ = (c[:, None, :] != c[None]).sum(2) + 99 * np.eye(n)
        assert differ.min() >= (1 if n == 2 else 3)


def slow_features(text):
    """n-grams counted one by one, hashed by the same rule."""
    out, data = {}, ""
    for c in text.lower():
        blank = c.isspace() or c.isdecimal() or c == "_"
        if not (blank and data.endswith(" ")):
            data += " " if blank else c
    raw = f" {data} ".encode()
    for n in range(1, 5):
        for i in range(len(raw) - n + 1):
            code = 0
            for k, b in enumerate(raw[i : i + n]):
                code = (code * 257 + b + k + 1) % 2**32
            h = (code * 2654435761 % 2**32) >> (32 - 13)
            out[h] = out.get(h, 0) + 1
    return out


def test_features_and_decoding_by_brute_force(monkeypatch):
    for text in ("Hello World", "Schöne Straße 12 und 3_4", "a", "日本語 текст"):
        counts = slow_features(text)
        x = langid.features(text)
        norm = sum(counts.values()) ** 0.5
        assert {i for i in np.flatnonzero(x).tolist()} == set(counts)
        assert all(abs(x[i] - c**0.5 / norm) < 1e-5 for i, c in counts.items())
    whole = langid.features(fixtures.texts()[-2][1])
    monkeypatch.setattr(langid, "CHUNK", 97)
    assert np.allclose(langid.features(fixtures.texts()[-2][1]), whole)
    rows = [r for r in fixtures.texts(6, 60) if r[1] and r[2]]
    model = langid.train([r[1] for r in rows], [r[2] for r in rows])
    for _, t, _ in rows[:20]:
        if not any(c.isalpha() for c in t):
            continue
        x = langid.features(t)
        margins = [float(sum(a * w for a, w in zip(x.tolist(), model.weights[:, j].tolist(), strict=True))) + float(model.bias[j]) for j in range(model.codes.shape[1])]
        losses = [sum(float(model.trust[j]) * np.log1p(np.exp(-m * float(code[j]))) for j, m in enumerate(margins)) for code in model.codes]
        lang, score, _ = model.predict([t])[0]
        assert lang == model.languages[int(np.argmin(losses))]
        assert abs(score - 1 / sum(np.exp(min(losses) - loss) for loss in losses)) < 1e-4


def test_only_frequent_languages_are_learned(spark, monkeypatch):
    monkeypatch.setattr(langid, "LANGUAGES", 2)
    rows = fixtures.texts(5, 60) + [(500 + i, "some odd label", f"odd{i}") for i in range(9)]
    assert langid.fit(fixtures.documents(spark, rows)).languages == ["de", "en"]


def test_a_language_of_long_texts_only(spark):
    """It is learned from its shortest texts; rows of both languages are told apart."""
    english, german = "the cat and the dog went over the hill with their friends ", "der Hund und die Katze gingen über den Hügel mit ihren Freunden "
    rows = [(k, english * (3 + k % 4), "en") for k in range(40)] + [(100 + k, german * (400 + k), "de") for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    said = {r.doc_id: r.lang_pred for r in langid.identify(df).collect()}
    assert said == {d: lang for d, _, lang in rows}
    only = {r.lang_pred for r in langid.identify(df.where("lang = 'de'")).collect()}
    assert only == {"de"}
