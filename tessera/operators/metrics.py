"""Metrics of runs: reductions by name, statistics, votes, bootstraps."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.operators import batches
from tessera.operators.pool import first_n_by_group


def reduce_metrics(metrics: DataFrame) -> DataFrame:
    """``(key, value)`` rows to one for each key: the maximum if its name has "max", else the minimum if "min", else the mean."""
    k = F.col("key")
    value = F.when(k.contains("max"), F.max("value")).when(k.contains("min"), F.min("value")).otherwise(F.avg("value"))
    return metrics.groupBy("key").agg(value.alias("value"))


def data_metrics(rows: DataFrame, columns: list[str], length: str, longest: int) -> DataFrame:
    """One row: mean, maximum and minimum of each column, share of rows of full length, explained variance of ``ret`` by ``val``."""
    stats = [f(c).alias(f"{c}_{n}") for c in columns for f, n in ((F.avg, "mean"), (F.max, "max"), (F.min, "min"))]
    clipped = F.avg((F.col(length) == longest).cast("double")).alias("clip_ratio")
    explained = (1 - F.var_samp(F.col("ret") - F.col("val")) / (F.var_samp("ret") + 1e-5)).alias("explained_variance")
    return rows.agg(*stats, clipped, explained)


def timing(stages: DataFrame, tokens: DataFrame, generation: str) -> DataFrame:
    """Adds ``ms`` a token to ``stages(stage, s)``; generation counts response tokens only. ``tokens`` has one row ``(response, total)``."""
    n = F.when(F.col("stage") == generation, F.col("response")).otherwise(F.col("total"))
    return stages.join(F.broadcast(tokens)).withColumn("ms", F.col("s") * 1000 / n)


def majority(rows: DataFrame, group: str, vote: str, value: str, order: str) -> DataFrame:
    """``(group, vote, val)``: the most frequent vote, the first seen of equals, with the value of its first row."""
    votes = rows.groupBy(group, F.col(vote).alias("vote")).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"), F.min_by(value, order).alias("val"))
    best = F.max_by(F.struct("vote", "val"), F.struct("n", -F.col("first")))
    return votes.groupBy(group).agg(best.alias("b")).select(group, "b.*")


def validation(rows: DataFrame, source: str, prompt: str, value: str) -> DataFrame:
    """``(source, mean, std, n)``: mean, population deviation and number of each prompt's values, averaged over prompts."""
    each = rows.groupBy(F.col(source).alias("source"), prompt).agg(F.avg(value).alias("m"), F.stddev_pop(value).alias("s"), F.count(F.lit(1)).alias("c"))
    return each.groupBy("source").agg(F.avg("m").alias("mean"), F.avg("s").alias("std"), F.avg("c").alias("n"))


def bootstrap(rows: DataFrame, group: str, value: str, order: str, sizes: tuple[int, ...], times: int, seed: int) -> DataFrame:
    """``(group, stat, mean, std)`` of the best and worst of samples with replacement from each group's values.

    The generator starts anew for each group and size, so that results don't
    depend on partitions.
    """

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(order)[value].to_numpy()
        out = []
        for k in sizes:
            drawn = x[np.random.RandomState(seed).randint(0, len(x), (times, k))]
            for name, reduced in (("best", drawn.max(1)), ("worst", drawn.min(1))):
                out.append((pdf[group].iloc[0], f"{name}@{k}", float(reduced.mean()), float(reduced.std())))
        return pd.DataFrame(out, columns=[group, "stat", "mean", "std"])

    kind = dict(rows.dtypes)[group]
    return rows.select(group, order, value).groupBy(group).applyInPandas(run, f"{group} {kind}, stat string, mean double, std double")


def named(stats: DataFrame, core: str, n: int) -> DataFrame:
    """Adds ``key`` to ``(source, var, stat)``: mean, majority and best of all n samples of the core variable are core metrics."""
    main = (F.col("var") == core) & F.col("stat").contains(f"@{n}") & F.col("stat").rlike("^(mean|maj|best)")
    group = F.when(main, "val-core").otherwise("val-aux")
    return stats.withColumn("key", F.concat_ws("/", group, "source", "var", "stat"))


def flops(rows: DataFrame, group: str, length: str, params: int, head_dim: int, heads: int, layers: int) -> DataFrame:
    """``(group, tflops)`` of training on sequences: 6 a parameter and token, and the attention's share."""
    dense = F.lit(float(6 * params)) * F.sum(length)
    attention = F.lit(12.0 * head_dim * heads * layers) * F.sum(F.col(length) * F.col(length))
    return rows.groupBy(group).agg(((dense + attention) / 1e12).alias("tflops"))


def running_best(rows: DataFrame, step: str, value: str) -> DataFrame:
    """Adds ``best``, the largest value up to each step, and ``saves``: the step reaches it. Steps tell rows apart."""
    return batches.running(rows, [step], F.col(value), "best", largest=True).withColumn("saves", F.col(value) >= F.col("best"))


def record(metrics: DataFrame, path: str) -> None:
    """Appends ``metrics(step, key, value)`` to the table of a run: what watches a run reads it as a stream or a table."""
    metrics.select(F.col("step").cast("long"), F.col("key").cast("string"), F.col("value").cast("double")).write.mode("append").parquet(path)


def recorded(spark: SparkSession, path: str) -> DataFrame:
    """``(step, key, value)`` of a run: of repeated records of a step and key the largest value counts."""
    return spark.read.parquet(path).groupBy("step", "key").agg(F.max("value").alias("value"))


def by_source(rows: DataFrame, source: str, prompt: str, reward: str, length: str) -> DataFrame:
    """``(source, score, length, prompts)``: means of each prompt's rows, averaged over the prompts of a source."""
    each = rows.groupBy(prompt, F.col(source).alias("source")).agg(F.avg(reward).alias("mean"), F.avg(length).alias("len"))
    return each.groupBy("source").agg(F.avg("mean").alias("score"), F.avg("len").alias("length"), F.count(F.lit(1)).alias("prompts"))


def throughput(rows: DataFrame, length: str, seconds: float, workers: int) -> DataFrame:
    """One row ``(tokens, per_second)``: all tokens, and those of one worker in a second."""
    return rows.agg(F.sum(length).cast("long").alias("tokens"), (F.sum(length) / (seconds * workers)).alias("per_second"))


def balance(rows: DataFrame, part: str, length: str) -> DataFrame:
    """One row ``(min, max, diff, mean)`` of the parts' total lengths."""
    totals = rows.groupBy(part).agg(F.sum(length).alias("n"))
    return totals.agg(F.min("n").alias("min"), F.max("n").alias("max"), (F.max("n") - F.min("n")).alias("diff"), F.avg("n").alias("mean"))


def moments(rows: DataFrame, value: str) -> DataFrame:
    """One row ``(mean, max, min, std)`` over all partitions."""
    return rows.agg(F.avg(value).alias("mean"), F.max(value).alias("max"), F.min(value).alias("min"), F.stddev_samp(value).alias("std"))


def pass_rates(rows: DataFrame, group: str, order: str, passed: Column, n: int) -> DataFrame:
    """``(group, rate)``: the share that passes of each group's first n rows."""
    return first_n_by_group(rows, group, [order], n).groupBy(group).agg(F.avg(passed.cast("double")).alias("rate"))
