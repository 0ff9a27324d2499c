"""A sampler that is resumed from its position: a keyed permutation computed for each row, without a sort.

Numbers 0 to n - 1 are pairs of a high and a low part; rounds add a keyed hash
of one part to the other, each of which can be undone, so that pairs are
permuted. The grid of pairs is a little larger than n: what falls outside goes
through the rounds again until it is inside, which permutes the inside.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 4
#: Walks at most: a walk meets fewer numbers outside than the grid is wide, and for more than WALKS^2 numbers hardly one.
WALKS = 64


@dataclass(frozen=True)
class Sampler:
    """The state: numbers 0 to n - 1 in the order of a seed and an epoch, of which ``position`` have been taken."""

    n: int
    seed: int
    epoch: int = 0
    position: int = 0

    def __post_init__(self):
        if not 1 <= self.n < 1 << 52 or not 0 <= self.position <= self.n:
            raise ValueError(f"position {self.position} of {self.n}")

    @property
    def grid(self) -> tuple[int, int]:
        high = math.isqrt(self.n - 1) + 1
        return high, -(-self.n // high)

    def hashed(self, x: Column, turn: int, within: int) -> Column:
        return F.pmod(F.xxhash64(F.lit(self.seed).cast("long"), F.lit(self.epoch).cast("long"), F.lit(turn), x), F.lit(within).cast("long"))

    def once(self, x: Column, back: bool) -> Column:
        """One pass through all rounds, or back through them."""
        a, b = self.grid
        low = F.pmod(x, F.lit(b).cast("long"))
        pair = F.struct(((x - low) / b).cast("long").alias("high"), low.alias("low"))

        def turned(t: int, p: Column) -> Column:
            high, low = p["high"], p["low"]
            if t % 2:
                h = self.hashed(high, t, b)
                return F.struct(high.alias("high"), F.pmod(low - h if back else low + h, F.lit(b).cast("long")).alias("low"))
            h = self.hashed(low, t, a)
            return F.struct(F.pmod(high - h if back else high + h, F.lit(a).cast("long")).alias("high"), low.alias("low"))

        def bound(t: int):
            return lambda p: turned(t, p)

        # Each round is bound as the variable of a transform: written out, the expression would double with it.
        folded = pair
        for t in reversed(range(2 * ROUNDS)) if back else range(2 * ROUNDS):
            folded = F.transform(F.array(folded), bound(t))[0]
        return F.transform(F.array(folded), lambda p: p["high"] * b + p["low"])[0]

    def walked(self, x: Column, back: bool) -> Column:
        a, b = self.grid
        outside = a * b - self.n
        first = self.once(x, back)
        if not outside:
            return first
        again = F.sequence(F.lit(1), F.lit(min(WALKS, outside)))
        return F.aggregate(again, first, lambda y, _: F.when(y < self.n, y).otherwise(self.once(y, back)))

    def position_of(self, row: Column) -> Column:
        """Where in the epoch a row number comes."""
        return self.walked(row.cast("long"), False)

    def row_at(self, position: Column) -> Column:
        """The row number at a position of the epoch."""
        return self.walked(position.cast("long"), True)

    def take(self, m: int) -> Sampler:
        """The state after m more rows, in later epochs if this one ends."""
        epochs, position = divmod(self.position + m, self.n)
        return replace(self, epoch=self.epoch + epochs, position=position)

    def state(self) -> dict[str, int]:
        return {"n": self.n, "seed": self.seed, "epoch": self.epoch, "position": self.position}


def rest_of_epoch(rows: DataFrame, row: str, sampler: Sampler, name: str = "position") -> DataFrame:
    """The rows of the epoch that haven't been taken, each with its position: a filter over ``rows``, whose numbers are in ``row``."""
    return rows.withColumn(name, sampler.position_of(F.col(row))).where(F.col(name) >= sampler.position)


def next_rows(spark: SparkSession, sampler: Sampler, m: int) -> DataFrame:
    """``(epoch, position, row)`` of the next m draws, over the ends of epochs, without looking at any table."""
    out, left = None, m
    while left:
        here = min(left, sampler.n - sampler.position)
        if here:
            part = spark.range(sampler.position, sampler.position + here).select(F.lit(sampler.epoch).alias("epoch"), F.col("id").alias("position"), sampler.row_at(F.col("id")).alias("row"))
            out = part if out is None else out.unionByName(part)
        sampler, left = sampler.take(here) if here else replace(sampler, epoch=sampler.epoch + 1, position=0), left - here
    return out if out is not None else spark.createDataFrame([], "epoch int, position long, row long")
