"""Tokenised datasets against plain Python."""

from __future__ import annotations

import os
import random

import pytest
from pyspark.sql import functions as F

from tessera.operators import tokens as T

TEMPLATE = T.ChatTemplate()
STOCK = "/opt/tokenizers/word_bpe_49k.json"


class Pairs:
    """Tokens of two characters, so that they reach over the borders of messages."""

    def __call__(self, texts):
        return [[ord(t[i]) * 1000 + ord((t + "\0")[i + 1]) for i in range(0, len(t), 2)] for t in texts]


def written(role, content):
    return f"<|im_start|>{role or ''}\n{content or ''}<|im_end|>\n"


def plain(messages, tokenizer, n, truncation):
    """The definition: masks by the lengths of all beginnings."""
    ids = tokenizer(["".join(written(r, c) for _, r, c in messages)])[0]
    loss = [0] * len(ids)
    for i, (_, role, _) in enumerate(messages):
        before, now = (len(tokenizer(["".join(written(r, c) for _, r, c in messages[:k])])[0]) for k in (i, i + 1))
        if role == "assistant":
            loss[before:now] = [1] * (now - before)
    cut = slice(-n, None) if truncation == "left" else slice(0, n)
    ids, loss = ids[cut], loss[cut]
    mask = [1] * len(ids) + [0] * (n - len(ids))
    return ids + [9] * (n - len(ids)), mask, [i * m for i, m in enumerate(mask)], loss + [0] * (n - len(loss))


@pytest.mark.parametrize("make,apart", [(T.Words, True), (T.Words, False), (Pairs, False)])
@pytest.mark.parametrize("truncation", ["left", "right"])
def test_training_rows(spark, make, apart, truncation):
    rng = random.Random(3)
    rows = [(c, t, rng.choice(["user", "assistant", "system", None]), " ".join(rng.choice(["a", "bb", "é\t", "longer"]) for _ in range(rng.randint(0, 9))) or None) for c in [None, *range(12)] for t in range(rng.randint(1, 7))]
    rows += [(3, 1, "assistant", "again")] * 2 + [(4, None, "system", "first")]
    df = spark.createDataFrame(rows, "conv long, turn long, role string, content string").withColumn("ids", F.lit(0)).withColumn("key", F.lit(1))
    out = T.training_rows(df, "conv", "turn", "role", "content", TEMPLATE, make, 24, 9, truncation, apart)
    got = {r[0]: tuple(map(list, r[1:])) for r in out.collect()}
    by: dict = {}
    for r in sorted(rows, key=lambda r: [(x is not None, x) for x in r[1:]]):
        by.setdefault(r[0], []).append(r[1:])
    assert got == {c: plain(m, make(), 24, truncation) for c, m in by.items()}


def test_a_long_conversation_is_gathered_only_within_its_length(spark):
    df = spark.range(20_000).select(F.lit(1).alias("c"), "id", F.when(F.col("id") % 2 == 1, "assistant").otherwise("user").alias("r"), F.concat(F.lit("word "), "id").alias("t"))
    for truncation, first in (("right", "<|im_start|>user"), ("left", "word")):
        row = T.training_rows(df, "c", "id", "r", "t", TEMPLATE, T.Words, 10, 0, truncation).head()
        assert row.attention_mask == [1] * 10 and row.input_ids[0 if truncation == "right" else 2] == T.Words()([first])[0][0]
    with pytest.raises(Exception, match="sequence of 60000 is longer than 10"):
        T.training_rows(df, "c", "id", "r", "t", TEMPLATE, T.Words, 10).collect()
    with pytest.raises(ValueError):
        T.training_rows(df, "c", "id", "r", "t", TEMPLATE, T.Words, 10, truncation="middle")


@pytest.mark.parametrize("truncation", ["left", "right", "middle"])
def test_prompts(spark, truncation):
    rows = [(1, [("system", "be kind"), ("user", "one two three four five six seven eight")]), (2, [("user", "hi")]), (3, []), (4, None), (5, [(None, None)])]
    df = spark.createDataFrame(rows, "id long, messages array<struct<role:string,content:string>>").withColumn("raw", F.lit(7))
    n, words = 8, T.Words()
    got = T.prompts(df, "messages", TEMPLATE, T.Words, n, 5, truncation).collect()
    assert all(r.raw == 7 for r in got)
    for r in got:
        full = words(["".join(written(a, b) for a, b in rows[r.id - 1][1] or []) + "<|im_start|>assistant\n"])[0]
        ids = full if len(full) <= n else {"left": full[-n:], "right": full[:n], "middle": full[: n // 2] + full[-(n - n // 2) :]}[truncation]
        mask = [0] * (n - len(ids)) + [1] * len(ids)
        assert r.raw_prompt_ids == ids and r.input_ids == [5] * (n - len(ids)) + ids and r.attention_mask == mask
        assert r.position_ids == [max(sum(mask[: i + 1]) - 1, 0) for i in range(n)]
    assert {r.id for r in T.short_prompts(df, "messages", TEMPLATE, T.Words, n).collect()} == {2, 3, 4, 5}
    with pytest.raises(Exception, match="longer than 8"):
        T.prompts(df, "messages", TEMPLATE, T.Words, n).collect()


def test_positions_of_any_side(spark):
    df = spark.createDataFrame([([0, 0, 1, 1],), ([1, 1, 0],), ([0, 0],), ([],), ([1],)], "m array<bigint>")
    assert [r[0] for r in df.select(T.positions(F.col("m"))).collect()] == [[0, 0, 0, 1], [0, 1, 1], [0, 0], [], [0]]


@pytest.mark.skipif(not os.path.exists(STOCK), reason="the tokenizer's file isn't here")
def test_a_stock_tokenizer(spark):
    from tokenizers import Tokenizer

    texts = ["Hello world", "", None, "déjà vu " * 50]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    whole = Tokenizer.from_file(STOCK)
    assert [r[0] for r in df.select(T.encode(F.col("t"), T.Stock(STOCK))).collect()] == [whole.encode(t or "", add_special_tokens=False).ids for t in texts]


def test_empty(spark):
    df = spark.createDataFrame([], "c long, t long, r string, x string")
    assert T.training_rows(df, "c", "t", "r", "x", TEMPLATE, T.Words, 4).count() == 0
