"""Quantiles of columns of any size: mergeable sketches, and exact values by narrowing ranges.

A KLL sketch of size k tells the value at a share within a rank error of about
2.3 / k^0.9 of all rows with 99 % confidence; sketches of parts merge. Exact
quantiles start there: a range around each wanted rank is counted and
sketched anew, all ranges in one pass, until few different values lie in each.
No task and no driver ever holds many more than WITHIN values for a range.
"""

from __future__ import annotations

import math
import sys
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import cut

#: Size of a sketch, and about how many different values of a range are brought together at most.
SIZE, WITHIN = 800, 4096


def rank_error(size: int) -> float:
    """The share of all rows that a sketch's ranks may be off, with 99 % confidence."""
    return 2.296 / size**0.9021


def sketched(rows: DataFrame, group: list[str], value: str, size: int = SIZE) -> DataFrame:
    """``(group, sketch, n)`` of the rows' values; nulls and NaNs don't count."""
    x = F.col(value).cast("double")
    return rows.groupBy(*group).agg(F.kll_sketch_agg_double(F.when(~F.isnan(x), x), F.lit(size)).alias("sketch"), F.count(F.when(~F.isnan(x), x)).alias("n"))


def merged(sketches: DataFrame, group: list[str], size: int = SIZE) -> DataFrame:
    """``(group, sketch, n)`` of finer sketches: of days from hours, of all from parts."""
    return sketches.groupBy(*group).agg(F.kll_merge_agg_double("sketch", F.lit(size)).alias("sketch"), F.sum("n").alias("n"))


def about(sketch: Column, share: float) -> Column:
    """The value at a share of the rows, within the rank error."""
    return F.kll_sketch_get_quantile_double(sketch, F.lit(share))


@dataclass
class Range:
    """A wanted place among all values, from 0: it is known to lie from ``low`` to ``high``, and is looked for in ``inner``."""

    place: int
    low: float
    high: float
    inner: tuple[float, float]

    def told(self, below: int, n: int, different: int, ends: tuple[float, float]) -> int | None:
        """Narrows the range by what was counted of its inner part; how many values are below it, once few are in it."""
        low, high = self.inner
        if self.place < below:  # a sketch is wrong for one rank of a hundred
            self.high = math.nextafter(low, -math.inf)
        elif self.place >= below + n:
            self.low = math.nextafter(high, math.inf)
        else:
            self.low, self.high = low, high
            if different <= WITHIN or low == high:
                return below
            ends = max(low, ends[0]), min(high, ends[1])
            # Values that a sketch doesn't part are halved.
            self.inner = ends if low <= ends[0] <= ends[1] <= high and ends != (low, high) else (low, middle(low, high))
            return None
        self.inner = self.low, self.high
        return None


def middle(low: float, high: float) -> float:
    half = max(low, -sys.float_info.max) / 2 + min(high, sys.float_info.max) / 2
    return half if low <= half < high else low


def counts(known: DataFrame, ranges: list[Range], size: int) -> list[tuple[int, int, int, tuple[float, float]]]:
    """One pass over ``known(x)``: for each inner range the values below and in it, how many differ, and between which values its place is about."""
    aggregates = []
    for i, r in enumerate(ranges):
        inside = F.when(F.col("x").between(*r.inner), F.col("x"))
        aggregates += [F.count_if(F.col("x") < r.inner[0]).alias(f"below{i}"), F.count(inside).alias(f"n{i}"), F.approx_count_distinct(inside).alias(f"d{i}"), F.kll_sketch_agg_double(inside, F.lit(size)).alias(f"s{i}")]
    one = cut(known.agg(*aggregates))  # sketches are asked for shares that must be known before
    said = one.select(*[f"{c}{i}" for i in range(len(ranges)) for c in ("below", "n", "d")]).head()
    error, columns, out = 2 * rank_error(size), [], []
    for i, r in enumerate(ranges):
        share = (r.place - said[f"below{i}"]) / max(1, said[f"n{i}"])
        for name, end, outside, s in (("low", r.inner[0], share <= error, share - error), ("high", r.inner[1], share + error >= 1, share + error)):
            known_end = outside or not said[f"n{i}"] or not 0 <= s <= 1
            columns.append((F.lit(end) if known_end else F.kll_sketch_get_quantile_double(F.col(f"s{i}"), F.lit(s))).alias(f"{name}{i}"))
    ends = one.select(*columns).head()
    for i in range(len(ranges)):
        out.append((said[f"below{i}"], said[f"n{i}"], said[f"d{i}"], (ends[f"low{i}"], ends[f"high{i}"])))
    return out


def exact(rows: DataFrame, value: str, shares: list[float], size: int = SIZE) -> list[float | None]:
    """The exact quantiles of a column, in the order of ``shares``; between two values they are interpolated.

    Nulls and NaNs don't count; null if nothing is left.
    """
    x = F.col(value).cast("double")
    known = cut(rows.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x")))
    whole = known.agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).head()
    if not whole["n"]:
        return [None] * len(shares)
    places = sorted({p for s in shares for p in (math.floor(s * (whole["n"] - 1)), math.ceil(s * (whole["n"] - 1)))})
    found: dict[int, float] = {}
    left = [Range(p, whole["low"], whole["high"], (whole["low"], whole["high"])) for p in places]
    while left:
        ready: dict[tuple[float, float, int], list[int]] = {}
        for r, said in zip(left, counts(known, left, size), strict=True):
            below = r.told(*said)
            if below is not None:
                ready.setdefault((r.low, r.high, below), []).append(r.place)
        for (low, high, below), wanted in ready.items():
            for row in known.where(F.col("x").between(low, high)).groupBy("x").agg(F.count(F.lit(1)).alias("n")).orderBy("x").toLocalIterator():
                found |= {p: row["x"] for p in wanted if below <= p < below + row["n"]}
                below += row["n"]
        left = [r for r in left if r.place not in found]
    out: list[float | None] = []
    for s in shares:
        at = s * (whole["n"] - 1)
        a, b = found[math.floor(at)], found[math.ceil(at)]
        out.append(a if a == b else a + (at - math.floor(at)) * (b - a))
    return out
