"""Statistics of samples drawn with replacement, in closed form: best, worst and majority of n.

What a bootstrap estimates by drawing is computed: the expectation and the
deviation over all draws of n from a prompt's responses. A prompt is known by
its histogram of values or votes; no list of a source's responses is made.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def averaged(each: DataFrame, source: str) -> DataFrame:
    """``(source, stat, mean, std)``: each prompt's expectation and deviation, averaged over the prompts of a source."""
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("second") - F.col("first") * F.col("first")))
    return each.groupBy(source, "stat").agg(F.avg("first").alias("mean"), F.avg(std).alias("std"))


def best_and_worst(rows: DataFrame, source: str, prompt: str, value: str, sizes: tuple[int, ...]) -> DataFrame:
    """``(source, stat, mean, std)`` of the best and the worst of n draws, for each n.

    The best is at most v if all n draws are: its distribution is the n-th
    power of the share of values up to v. Rows without a value are left out.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(source, prompt, F.col(value).cast("double").alias("v")).agg(F.count(F.lit(1)).alias("c"))
    w = Window.partitionBy(source, prompt)
    upto = F.sum("c").over(w.orderBy("v").rowsBetween(Window.unboundedPreceding, 0))
    shares = counts.withColumn("upto", upto).withColumn("n", F.sum("c").over(w))
    high, low = F.col("upto") / F.col("n"), (F.col("upto") - F.col("c")) / F.col("n")
    stats = F.array(*[x for k in sizes for x in (F.struct(F.lit(f"best@{k}").alias("stat"), (F.pow(high, k) - F.pow(low, k)).alias("p")), F.struct(F.lit(f"worst@{k}").alias("stat"), (F.pow(1 - low, k) - F.pow(1 - high, k)).alias("p")))])
    parts = shares.select(source, prompt, "v", F.inline(stats))
    # About the prompt's middle, so that far values with small differences keep their deviation.
    middle = F.avg("v").over(w)
    parts = parts.withColumn("mid", middle).withColumn("d", F.col("v") - F.col("mid"))
    each = parts.groupBy(source, prompt, "stat").agg(F.first("mid").alias("mid"), F.sum(F.col("p") * F.col("d")).alias("first"), F.sum(F.col("p") * F.col("d") * F.col("d")).alias("second"))
    std = F.sqrt(F.greatest(F.lit(0.0), F.col("second") - F.col("first") * F.col("first")))
    return each.groupBy(source, "stat").agg(F.avg(F.col("mid") + F.col("first")).alias("mean"), F.avg(std).alias("std"))


def winning(counts: np.ndarray, n: int) -> np.ndarray:
    """The chance of each vote to have the majority of n draws; of tied votes each comes first as often.

    For a winner with k of n draws every other vote has fewer, or as many and
    is tied: products of polynomials in the number of draws, with a weight t
    on each tie. The integral of t^(m - 1) over 0 to 1 is the winner's share
    1 / m, exactly by quadrature.
    """
    p = counts / counts.sum()
    nodes, weights = np.polynomial.legendre.leggauss(n // 2 + 1)
    t, weights = (nodes + 1) / 2, weights / 2
    term = np.array([p**j / math.factorial(j) for j in range(n + 1)]).T  # votes x draws
    out = np.zeros(len(p))
    for k in range(1, n + 1):
        others = np.zeros((len(p), len(t), n - k + 1))
        upto = min(k, n - k + 1)
        others[:, :, :upto] = term[:, None, :upto]
        if k <= n - k:
            others[:, :, k] = term[:, None, k] * t
        for v, rest in enumerate(products_of_others(others)):
            out[v] += term[v, k] * (weights * rest[:, n - k]).sum()
    return out * math.factorial(n)


def products_of_others(x: np.ndarray) -> Iterator[np.ndarray]:
    """For each row of polynomials the product of all other rows, cut to their length."""
    one = np.zeros(x.shape[1:])
    one[:, 0] = 1
    after = [one]
    for row in x[:0:-1]:
        after.append(product(after[-1], row))
    before = one
    for row, rest in zip(x, after[::-1], strict=True):
        yield product(before, rest)
        before = product(before, row)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    out = np.zeros_like(a)
    for i in range(a.shape[1]):
        out[:, i:] += a[:, i : i + 1] * b[:, : a.shape[1] - i]
    return out


def majority(rows: DataFrame, source: str, prompt: str, vote: str, value: str, sizes: tuple[int, ...]) -> DataFrame:
    """``(source, stat, mean, std)`` of the value that the most frequent vote of n draws has, for each n.

    The first drawn of equally frequent votes counts, with the value of its
    first response. A null vote is a vote; rows without a value are left out.
    A prompt's different votes are as many as the responses drawn for it.
    """
    v = F.col(value).cast("double")
    votes = rows.where(F.col(value).isNotNull()).groupBy(source, prompt, vote).agg(F.count(F.lit(1)).alias("c"), F.avg(v).alias("m"), F.avg(v * v).alias("s"))
    listed = votes.groupBy(source, prompt).agg(F.sort_array(F.collect_list(F.struct("c", "m", "s"))).alias("h")).select(source, "h")
    kind = dict(rows.dtypes)[source]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known: dict[tuple, np.ndarray] = {}
        for pdf in batches:
            out = []
            for name, h in pdf.itertuples(index=False):
                c, m, s = np.array([[x["c"], x["m"], x["s"]] for x in h], np.float64).T
                for k in sizes:
                    if len(known) > 10_000:
                        known.clear()
                    # Prompts with equal counts have equal chances.
                    p = known.get(at := (k, c.tobytes()))
                    if p is None:
                        p = known[at] = winning(c, k)
                    out.append((name, f"maj@{k}", float(p @ m), float(p @ s)))
            yield pd.DataFrame(out, columns=[source, "stat", "first", "second"])

    return averaged(listed.mapInPandas(run, f"{source} {kind}, stat string, first double, second double"), source)
