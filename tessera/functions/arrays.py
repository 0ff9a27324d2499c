"""Array functions as columns: masks, padding, reductions, softmax, folds."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Elements of the padded rows that are summed up at once.
CELLS = 1 << 20


def let(x: Column, body) -> Column:
    """``body(x)`` with x computed once."""
    return F.transform(F.array(x), body)[0]


def total(a: Column) -> Column:
    """Sum of an array as a double; 0 for an empty one."""
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision."""
    return total(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")))


def normalise(v: Column) -> Column:
    """The vector scaled to length 1; a zero vector stays."""
    return let(F.sqrt(dot(v, v)), lambda n: F.when(n == 0, v.cast("array<double>")).otherwise(F.transform(v, lambda x: x.cast("double") / n)))


def masked_sum(v: Column, mask: Column) -> Column:
    return total(F.zip_with(v, mask, lambda x, m: x * m))


def masked_mean(v: Column, mask: Column, eps: float = 1e-8) -> Column:
    return masked_sum(v, mask) / (total(mask) + eps)


def lengths(mask: Column) -> tuple[Column, Column]:
    """(positions that the mask has, all others)."""
    n = total(mask)
    return n, F.size(mask) - n


def positions(a: Column) -> Column:
    """0, 1, ... for each element; empty for an empty array."""
    return F.transform(a, lambda _, i: i)


def until_first(ids: Column, end: int) -> Column:
    """1 up to and with the first ``end``, then 0; all 1 without it."""
    at = F.array_position(ids, F.lit(end))
    return F.transform(ids, lambda _, i: F.when((at == 0) | (i < at), 1).otherwise(0))


def pad_right(a: Column, n: Column | int, with_: int) -> Column:
    """At least n elements, filled up at the right."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(a, F.array_repeat(F.lit(with_).cast("long"), F.greatest(n - F.size(a), F.lit(0))))


def pad_left(a: Column, n: Column | int, with_: int) -> Column:
    """At least n elements, filled up at the left."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.concat(F.array_repeat(F.lit(with_).cast("long"), F.greatest(n - F.size(a), F.lit(0))), a)


def fit(a: Column, n: int, with_: int, left_pad: bool = True, truncation: str = "error") -> Column:
    """Exactly n elements: padded, or cut ``left``, ``right`` or in the ``middle``; ``error`` raises for longer ones."""
    padded = (pad_left if left_pad else pad_right)(a, n, with_)
    if truncation == "left":
        cut = F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))
    elif truncation == "right":
        cut = F.slice(a, 1, n)
    elif truncation == "middle":
        head = n // 2
        cut = F.concat(F.slice(a, 1, head), F.slice(a, F.greatest(F.size(a) - (n - head) + 1, F.lit(1)), F.lit(n - head)))
    elif truncation == "error":
        cut = F.raise_error(F.concat(F.lit("sequence of "), F.size(a).cast("string"), F.lit(f" is longer than {n}"))).cast("array<bigint>")
    else:
        raise ValueError(f"no such truncation: {truncation}")
    return F.when(F.size(a) <= n, padded).otherwise(cut)


def without_left_pad(ids: Column, mask: Column) -> Column:
    """The last elements, as many as the mask has ones."""
    n = total(mask).cast("int")
    return F.when(n == 0, F.slice(ids, 1, 0)).otherwise(F.slice(ids, F.size(ids) - n + 1, n))


def suffix(a: Column, n: int) -> Column:
    """The last n elements, or all."""
    return F.slice(a, F.greatest(F.size(a) - n + 1, F.lit(1)), F.lit(n))


def at_last_valid(score: Column, mask: Column) -> Column:
    """The score at the last position that the mask has, 0 elsewhere."""
    last = F.array_max(F.transform(mask, lambda m, i: F.when(m > 0, i).otherwise(-1)))
    return F.transform(mask, lambda _, i: F.when(i == last, score).otherwise(F.lit(0.0)))


def log_sum_exp(a: Column) -> Column:
    return let(F.array_max(a), lambda m: m + F.log(total(F.transform(a, lambda x: F.exp(x - m)))))


def log_softmax(a: Column) -> Column:
    return let(log_sum_exp(a), lambda z: F.transform(a, lambda x: x - z))


def entropy(logits: Column) -> Column:
    """Entropy of the softmax of an array of logits."""
    return let(log_sum_exp(logits), lambda z: z - total(F.transform(logits, lambda x: F.exp(x - z) * x)))


def pick(a: Column, index: Column) -> Column:
    """Element by place from 0."""
    return F.get(a, index.cast("int"))


def by_length(rows: list[np.ndarray]) -> Iterator[list[int]]:
    """Numbers of rows in groups of like length, so that a padded group has at most CELLS elements or is one row."""
    part: list[int] = []
    for i in sorted(range(len(rows)), key=lambda i: len(rows[i])):
        if part and (len(part) + 1) * len(rows[i]) > CELLS:
            yield part
            part = []
        part.append(i)
    if part:
        yield part


def scan_back(values: list[np.ndarray], factor: float, keep: list[np.ndarray] | None = None) -> list[np.ndarray]:
    """For each row the sums out[t] = value[t] + factor * keep[t + 1] * out[t + 1], all rows of a group at once.

    ``keep`` defaults to ones. The work is linear in the elements.
    """
    out: list[np.ndarray] = [np.zeros(0)] * len(values)
    for part in by_length(values):
        n = max(len(values[i]) for i in part)
        x, k = np.zeros((n + 1, len(part))), np.ones((n + 1, len(part)))
        for j, i in enumerate(part):  # rows end together, as they are summed up from their ends
            x[n - len(values[i]) : n, j] = values[i]
            if keep is not None:
                k[n - len(values[i]) : n, j] = keep[i]
        for t in range(n - 1, -1, -1):
            x[t] += factor * k[t + 1] * x[t + 1]
        for j, i in enumerate(part):
            out[i] = x[n - len(values[i]) : n, j]
    return out


def numbers(column: pd.Series) -> list[np.ndarray]:
    """Arrays of a column as doubles; a null one is empty."""
    return [np.zeros(0) if v is None else np.asarray(v, np.float64) for v in column]


def discounted(rewards: Column, gamma: float, mask: Column | None = None) -> Column:
    """Reverse discounted sums; where a mask is given, the sum starts anew at positions that it lacks. Null stays null."""

    def sums(r: pd.Series, m: pd.Series | None) -> pd.Series:
        found = scan_back(numbers(r), gamma, None if m is None else numbers(m))
        return pd.Series([None if v is None else x for v, x in zip(r, found, strict=True)], dtype=object)

    if mask is None:

        @F.pandas_udf("array<double>")
        def run(r: pd.Series) -> pd.Series:
            return sums(r, None)

        return run(rewards)

    @F.pandas_udf("array<double>")
    def masked(r: pd.Series, m: pd.Series) -> pd.Series:
        return sums(r, m)

    return masked(rewards, mask)


def gae(rewards: Column, values: Column, gamma: float, lam: float) -> Column:
    """Generalised advantage estimates of a sequence; the value after the end is 0. Null stays null."""

    @F.pandas_udf("array<double>")
    def run(r: pd.Series, v: pd.Series) -> pd.Series:
        deltas = [a + gamma * np.append(b[1:], 0.0)[: len(a)] - b for a, b in zip(numbers(r), numbers(v), strict=True)]
        found = scan_back(deltas, gamma * lam)
        return pd.Series([None if a is None or b is None else x for a, b, x in zip(r, v, found, strict=True)], dtype=object)

    return run(rewards, values)


def distinct_first(a: Column, n: int) -> Column:
    """The first n different elements in their order."""
    return F.slice(F.array_distinct(a), 1, n)


# Learning rates by step -------------------------------------------------------


def warm_up(step: Column, steps: int) -> Column:
    """Share of the rate that the first steps have."""
    return F.least(F.lit(1.0), step / float(max(1, steps)))


def cosine_rate(step: Column, warmup: int, total: int, least: float = 0.0, cycles: float = 0.5) -> Column:
    """Rises from the least rate over the warm-up, then falls along a cosine to it."""
    share = (step - warmup) / float(max(1, total - warmup))
    wave = (1 + F.cos(F.lit(math.pi * 2 * cycles) * share)) / 2
    return least + (1 - least) * F.when(step < warmup, warm_up(step, warmup)).otherwise(wave)


def constant_rate(step: Column, warmup: int) -> Column:
    """Rises over the warm-up, then stays."""
    return warm_up(step, warmup)


def stable_rate(step: Column, warmup: int, total: int, least: float = 0.0, cycles: float = 0.5, stable: float = 0.9) -> Column:
    """Rises over the warm-up, stays for a share of the other steps, then falls along a cosine; the least rate after the end."""
    level = int((total - warmup) * stable)
    fall = total - warmup - level
    share = (step - warmup - level) / float(max(1, fall))
    wave = F.greatest(F.lit(0.0), 0.5 * (1 + F.cos(F.lit(math.pi * cycles * 2) * share)))
    return F.when(step < warmup, warm_up(step, warmup)).when(step < warmup + level, 1.0).when(step < total, (1 - least) * wave + least).otherwise(F.lit(float(least)))
