"""Preparation of datasets: canonical records, targets, segments, loss spans."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def record(source: str, content: Column, truth: Column, split: str, index: Column, style: str = "rule", ability: str = "math") -> Column:
    """A training record: source, prompt messages, ability, how it is rewarded, and where it comes from."""
    return F.struct(
        F.lit(source).alias("data_source"),
        F.array(F.struct(F.lit("user").alias("role"), content.alias("content"))).alias("prompt"),
        F.lit(ability).alias("ability"),
        F.struct(F.lit(style).alias("style"), truth.alias("ground_truth")).alias("reward_model"),
        F.struct(F.lit(split).alias("split"), index.alias("index")).alias("extra_info"),
    )


def segments(content: Column) -> Column:
    """Typed segments of a content string: text between the marks <image> and <video>, empty text left out."""
    marked = F.regexp_replace(content, "(<image>|<video>)", "\u0000$1\u0000")
    typed = F.transform(
        F.split(marked, "\u0000"),
        lambda s: F.struct(
            F.when(s == "<image>", "image").when(s == "<video>", "video").otherwise("text").alias("type"),
            F.when(s.isin("<image>", "<video>"), F.lit(None)).otherwise(s).alias("value"),
        ),
    )
    return F.filter(typed, lambda s: (s["type"] != "text") | (s["value"] != ""))


def with_prefix(target: Column, prefix: str, prompted: Column) -> Column:
    """The target with the prefix; without it, if the prompt ends with it already."""
    has = F.startswith(target, F.lit(prefix))
    bare = F.when(has, F.substr(target, F.lit(len(prefix) + 1))).otherwise(target)
    full = F.when(has, target).otherwise(F.concat(F.lit(prefix), target))
    return F.when(prompted, bare).otherwise(full)


def loss_spans(turns: DataFrame, conversation: str, turn: str, role: str, length: str) -> DataFrame:
    """``(conversation, turn, start, stop, loss)``: where each turn's tokens stand, and whether they count."""
    w = Window.partitionBy(conversation).orderBy(turn).rowsBetween(Window.unboundedPreceding, 0)
    stop = F.sum(length).over(w)
    return turns.select(conversation, turn, (stop - F.col(length)).alias("start"), stop.alias("stop"), F.when(F.col(role) == "assistant", 1).otherwise(0).alias("loss"))


def shuffle_choices(rows: DataFrame, key: str, choices: str, seed: int) -> DataFrame:
    """Choices in an order by hash of key and choice, and the place of the one that was first (from 0)."""
    keyed = F.transform(F.col(choices), lambda c, i: F.struct(F.xxhash64(F.col(key), c, F.lit(seed)).alias("h"), i.alias("i"), c.alias("c")))
    mixed = F.array_sort(keyed)
    out = rows.withColumn("__m", mixed)
    return out.select(key, F.transform("__m", lambda x: x["c"]).alias("choices"), (F.array_position(F.transform("__m", lambda x: x["i"]), F.lit(0)) - 1).alias("gold"))


def split_by_place(numbered: DataFrame, n: int, share: float, place: str = "k") -> DataFrame:
    """Adds ``split``: the first share of the rows is for training."""
    return numbered.withColumn("split", F.when(F.col(place) < int(n * share), "train").otherwise("test"))


def first_known(fields: dict[str, Column], default: str) -> Column:
    """``struct<value, origin>``: the first field that is known, and its name; else the default."""
    value = F.coalesce(*fields.values(), F.lit(default))
    origin = F.coalesce(*[F.when(x.isNotNull(), F.lit(n)) for n, x in fields.items()], F.lit("default"))
    return F.struct(value.alias("value"), origin.alias("origin"))


def loss_mask(prompt: Column, response: Column) -> Column:
    """0 for each token of the prompt, 1 for each of the response."""
    return F.concat(F.array_repeat(F.lit(0), prompt), F.array_repeat(F.lit(1), response))


def choice_record(query: Column, choices: list[Column], label: Column) -> Column:
    """``struct<query, choices, label>`` of a question with choices."""
    return F.struct(query.alias("query"), F.array(*choices).alias("choices"), label.alias("label"))


def both_answers(pairs: DataFrame, keys: list[str], chosen: str, rejected: str) -> DataFrame:
    """``(keys, kind, response)``: the chosen and the rejected answer of each pair as rows."""
    return pairs.unpivot(keys, [chosen, rejected], "kind", "response").withColumn("kind", F.when(F.col("kind") == chosen, "chosen").otherwise("rejected"))


def within_dates(rows: DataFrame, column: str, first: str, last: str) -> DataFrame:
    """Rows whose time is from the first day's to the last day's start, which reaches the scan as a filter."""
    kind = dict(rows.dtypes)[column]
    return rows.where(F.col(column).between(F.lit(first).cast(kind), F.lit(last).cast(kind)))


def last_turns(turns: DataFrame, conversation: str, turn: str, role: str) -> DataFrame:
    """``(conversation, last_turn, last_role, turns)``."""
    return turns.groupBy(conversation).agg(F.max(turn).alias("last_turn"), F.max_by(role, turn).alias("last_role"), F.count(F.lit(1)).alias("turns"))
