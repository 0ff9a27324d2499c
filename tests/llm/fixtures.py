"""Small documents with the awkward cases that every operator must handle."""

from __future__ import annotations

import random

from pyspark.sql import DataFrame, SparkSession

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def texts(seed: int = 3, n: int = 40) -> list[tuple]:
    """(doc_id, text, lang): prose of two languages, copies, near copies, shared passages, odd texts."""
    rng = random.Random(seed)
    parts = {"en": ["the", "and", "er", "ing", "tion", "th", "of", "a", "ou", "ly"], "de": ["der", "ung", "sch", "ein", "ich", "ß", "ü", "zu", "ge", "en"]}

    def prose(lang: str, size: int) -> str:
        return " ".join("".join(rng.choice(parts[lang]) for _ in range(rng.randint(1, 4))) for _ in range(size))

    passage = prose("en", 40)
    rows: list[tuple] = []
    for i in range(n):
        lang = "en" if i % 2 else "de"
        text = prose(lang, rng.choice([3, 30, 120, 300]))
        if i % 5 == 0:
            text = f"{text}\n{passage}\n{prose(lang, 20)}"
        rows.append((i, text, lang))
    near = next(t for _, t, _ in rows if len(t) > 1200).split(" ")
    near[len(near) // 2] = "changed"
    rows += [(n, rows[4][1], "de"), (n + 1, rows[4][1], "de"), (n + 2, " ".join(near), "en"), (n + 3, None, None), (n + 4, "", "en"), (n + 5, " \t\n ", "en"), (n + 6, None, "de"), (n + 7, "é" * 200 + "日本語 текст", None)]
    rows += [(n + 8, "ab" * 400, "en"), (n + 9, "x" * 51, "en"), (n + 10, "123 456 ...", "en"), (n + 11, prose("en", 3000), "en"), (n + 12, "MIT License, mit license mit\nLICENSE", "en")]
    return rows


def documents(spark: SparkSession, rows: list[tuple] | None = None, odd: bool = True, again: bool = False) -> DataFrame:
    """The table documents; with ``odd`` also a row without an id, a repeated row and columns with clashing names.

    With ``again`` some ids come a second time with another text, one of equal length too, and one with the text of
    a smaller id.
    """
    rows = texts() if rows is None else rows
    full = [(d, t, lang, "src", None if t is None else len(t)) for d, t, lang in rows]
    if odd:
        full += [(None, "a row without an id " * 5, None, None, None), full[3]]
    if again:
        full += [(d, t, lang, "again", len(t)) for d, t, lang in repeated(rows)]
    df = spark.createDataFrame(full, SCHEMA)
    return df.selectExpr("*", "1 AS f", "'x' AS component_id", "2 AS grp", "3 AS sketch", "4 AS item", "5 AS node") if odd else df


def repeated(rows: list[tuple]) -> list[tuple]:
    """Rows whose ids ``rows`` has, with other texts."""
    long = [r for r in rows if r[1] and len(r[1]) > 300]
    (a, ta, _), (b, tb, _), (c, tc, _) = long[0], long[1], long[2]
    return [(b, ta, "en"), (b, tb[::-1], "en"), (c, "kept \ufffd here, and more than fifty bytes of other words \ufffd", "en"), (a, "zzzz", "en"), (a, "", "en")]


def empty(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], SCHEMA)
