"""Tokenised datasets: tokenizers as plug-ins, chat templates, padded prompts and training rows with their masks."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import lru_cache
from typing import Protocol

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays
from tessera.sources.shared import free

TRUNCATIONS = ("left", "right", "error")


class Tokenizer(Protocol):
    """Token ids of texts, without special tokens of its own."""

    def __call__(self, texts: list[str]) -> list[list[int]]: ...


#: Makes a tokenizer; called once for a task, so that what it loads isn't sent around.
Maker = Callable[[], Tokenizer]


class Words:
    """A stand-in for a model's tokenizer: a token for each word between ASCII blanks, with 28 bits of its MD5 as id."""

    def __init__(self):
        self.id = lru_cache(1 << 16)(lambda w: int(hashlib.md5(w.encode("utf-8", "surrogatepass")).hexdigest()[:7], 16))

    def __call__(self, texts: list[str]) -> list[list[int]]:
        return [[self.id(w) for w in re.split(r"[ \t-\r]+", t) if w] for t in texts]


@dataclass(frozen=True)
class Stock:
    """Makes the tokenizer of a ``tokenizers`` file, which every machine must reach under this path."""

    path: str

    def __call__(self) -> Tokenizer:
        from tokenizers import Tokenizer as Loaded

        loaded = Loaded.from_file(self.path)
        return lambda texts: [e.ids for e in loaded.encode_batch(texts, add_special_tokens=False)]


@dataclass(frozen=True)
class ChatTemplate:
    """How a message is written: ``start role middle content stop``; ``ask`` invites the answer."""

    start: str = "<|im_start|>"
    middle: str = "\n"
    stop: str = "<|im_end|>\n"
    ask: str = "<|im_start|>assistant\n"

    def message(self, role: Column, content: Column) -> Column:
        """One message as text; a null role or content is empty."""
        return F.concat(F.lit(self.start), F.coalesce(role, F.lit("")), F.lit(self.middle), F.coalesce(content, F.lit("")), F.lit(self.stop))

    def prompt(self, messages: Column) -> Column:
        """An ``array<struct<role, content>>`` as text that ends with the invitation; null messages are none."""
        written = F.transform(F.coalesce(messages, F.array().cast("array<struct<role:string,content:string>>")), lambda m: self.message(m["role"], m["content"]))
        return F.concat(F.array_join(written, ""), F.lit(self.ask))


def encode(text: Column, make: Maker) -> Column:
    """Token ids of a text column in Arrow batches, as ``array<bigint>``; null has none."""

    @F.pandas_udf("array<bigint>")
    def ids(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        tokenizer = make()
        for texts in batches:
            yield pd.Series(tokenizer(["" if t is None else t for t in texts]), index=texts.index, dtype=object)

    return ids(text)


def positions(mask: Column) -> Column:
    """Running sums of a 0/1 mask whose ones stand together, less one, but at least 0: places of tokens in padded rows."""
    first, n = F.array_position(mask, F.lit(1).cast("bigint")) - 1, arrays.total(mask).cast("bigint")
    return F.transform(mask, lambda _, i: F.when(n == 0, F.lit(0).cast("bigint")).otherwise(F.greatest(F.least(i - first, n - 1), F.lit(0).cast("bigint"))))


def short_prompts(rows: DataFrame, messages: str, template: ChatTemplate, make: Maker, n: int) -> DataFrame:
    """Rows whose prompt, written by the template, has n tokens at most."""
    return rows.where(F.size(encode(template.prompt(F.col(messages)), make)) <= n)


def prompts(rows: DataFrame, messages: str, template: ChatTemplate, make: Maker, n: int, pad: int = 0, truncation: str = "error") -> DataFrame:
    """Adds ``input_ids``, ``attention_mask``, ``position_ids`` (n long, padded left) and ``raw_prompt_ids`` to rows with messages.

    Longer prompts are cut ``left``, ``right`` or in the ``middle``;
    ``error`` raises. Columns of these names are replaced.
    """
    (raw,) = free(rows, "raw")
    ids = rows.withColumn(raw, encode(template.prompt(F.col(messages)), make))
    length, padded = F.least(F.size(raw), F.lit(n)), arrays.fit(F.col(raw), n, pad, True, truncation)
    mask = F.concat(F.array_repeat(F.lit(0).cast("bigint"), F.lit(n) - length), F.array_repeat(F.lit(1).cast("bigint"), length))
    cut = F.when(F.size(raw) > n, padded).otherwise(F.col(raw))
    out = ids.withColumns({"input_ids": padded, "attention_mask": mask, "raw_prompt_ids": cut})
    return out.withColumn("position_ids", positions(F.col("attention_mask"))).drop(raw)


def training_rows(
    turns: DataFrame, conversation: str, turn: str, role: str, content: str, template: ChatTemplate, make: Maker, n: int, pad: int = 0, truncation: str = "error", apart: bool = True
) -> DataFrame:
    """``(conversation, input_ids, attention_mask, position_ids, loss_mask)``, each n long and padded right.

    The loss counts on the tokens of assistants' messages: those between the
    lengths of the conversation's tokens up to the message before and up to
    this one. Longer conversations are cut ``left`` or ``right``; ``error``
    raises.

    ``apart`` says that no token reaches over from one message into the next,
    as where messages begin with a special token: each is then encoded once,
    its place is a running sum, and only messages within the n tokens are
    gathered, however long the conversation is. Otherwise each conversation is
    written as a whole, and all its beginnings are encoded: it must fit a row.

    Messages stand by turn, nulls first, then role and content; a null role or
    content is empty; a null conversation is one too; repeated rows are
    messages of their own.
    """
    if truncation not in TRUNCATIONS:
        raise ValueError(f"no such truncation: {truncation}")
    text = template.message(F.col(role), F.col(content))
    rows = turns.select(F.col(conversation).alias("key"), F.struct(F.col(turn), F.col(role), F.col(content)).alias("at"), F.coalesce(F.col(role) == "assistant", F.lit(False)).cast("bigint").alias("loss"), text.alias("text"))
    spans = (_apart if apart else _prefixes)(rows, make, n, truncation)
    ids, loss, size = F.flatten("parts.ids"), F.flatten(F.transform("parts", lambda p: F.array_repeat(p["loss"], F.size(p["ids"])))), F.size(F.flatten("parts.ids"))
    mask = arrays.pad_right(F.array_repeat(F.lit(1).cast("bigint"), size), n, 0)
    out = spans.select("key", "length", arrays.pad_right(ids, n, pad).alias("input_ids"), mask.alias("attention_mask"), arrays.pad_right(loss, n, 0).alias("loss_mask"))
    if truncation == "error":
        too_long = F.raise_error(F.concat(F.lit("sequence of "), F.col("length").cast("string"), F.lit(f" is longer than {n}"))).cast("array<bigint>")
        out = out.withColumn("input_ids", F.when(F.col("length") > n, too_long).otherwise(F.col("input_ids")))
    place = F.transform("attention_mask", lambda m, i: m * i)
    return out.select(F.col("key").alias(conversation), "input_ids", "attention_mask", place.alias("position_ids"), "loss_mask")


def _apart(rows: DataFrame, make: Maker, n: int, truncation: str) -> DataFrame:
    """``(key, length, parts)`` of messages that are encoded one by one."""
    w = Window.partitionBy("key").orderBy(F.col("at").asc_nulls_first())
    if truncation == "left":  # what stands after a message, so that running sums do here too
        w = Window.partitionBy("key").orderBy(F.col("at").desc_nulls_last())
    coded = rows.select("key", "at", "loss", encode(F.col("text"), make).alias("ids"))
    # Equal messages stand one after the other in any order: rows, not ranges.
    placed = coded.withColumn("done", F.sum(F.size("ids").cast("bigint")).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    room = (F.lit(n) - (F.col("done") - F.size("ids"))).cast("int")
    k = F.greatest(F.least(room, F.size("ids")), F.lit(0))
    kept = F.slice("ids", F.size("ids") - k + 1, k) if truncation == "left" else F.slice("ids", F.lit(1), k)
    # A message without a token within n keeps nothing of its own in the list.
    part = F.when(k > 0, F.struct(F.col("done"), kept.alias("ids"), F.col("loss")))
    order = F.array_sort(F.collect_list(part))
    grouped = placed.groupBy("key").agg(F.max("done").alias("length"), order.alias("parts"))
    return grouped.withColumn("parts", F.reverse("parts")) if truncation == "left" else grouped


def _prefixes(rows: DataFrame, make: Maker, n: int, truncation: str) -> DataFrame:
    """``(key, length, parts)`` of conversations of which every beginning is encoded."""
    gathered = rows.groupBy("key").agg(F.array_sort(F.collect_list(F.struct("at", "loss", "text"))).alias("m"))

    @F.pandas_udf("struct<length:bigint,parts:array<struct<ids:array<bigint>,loss:bigint>>>")
    def spans(batches: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.DataFrame]:
        tokenizer = make()
        for texts, losses in batches:
            out = []
            for messages, loss in zip(texts, losses):
                beginnings, so_far = [], ""
                for m in messages:
                    beginnings.append(so_far := so_far + m)
                coded = tokenizer(beginnings)
                ids, ends = coded[-1], [len(c) for c in coded]
                counts = [0] * len(ids)
                for start, end, x in zip([0, *ends], ends, loss):
                    if x:
                        counts[start:end] = [1] * (min(end, len(ids)) - min(start, len(ids)))
                keep = slice(max(len(ids) - n, 0), None) if truncation == "left" else slice(0, n)
                out.append((len(ids), [{"ids": [i], "loss": c} for i, c in zip(ids[keep], counts[keep])]))
            yield pd.DataFrame(out, columns=["length", "parts"])

    return gathered.select("key", spans("m.text", "m.loss").alias("s")).select("key", "s.length", "s.parts")
