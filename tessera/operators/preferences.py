"""Rewards less divergence, preference losses and sequence log-probabilities, as columns over token arrays or rollouts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A


def divergence(logps: Column, refs: Column, mask: Column) -> Column:
    """Differences of log-probabilities at the positions that the mask has, 0 elsewhere."""
    return F.zip_with(F.zip_with(logps, refs, lambda a, b: a - b), mask, lambda k, m: k * m)


def kl_penalised(rewards: Column, kls: Column, beta: float) -> Column:
    """Token rewards less ``beta`` times the divergence."""
    return F.zip_with(rewards, kls, lambda x, k: x - beta * k)


def mean_divergence(kls: Column, mask: Column) -> Column:
    return A.total(kls) / (A.total(mask) + 1e-8)


def sequence_logps(logps: Column, skip: int = 1) -> tuple[Column, Column]:
    """(sum, mean) of a sequence's log-probabilities without its first ``skip``, whose labels are ignored; null if none is left."""
    x = F.slice(logps, skip + 1, F.greatest(F.size(logps), F.lit(1)))
    total = F.when(F.size(x) > 0, A.total(x))
    return total, total / F.size(x)


def normalised(rows: DataFrame, scores: str) -> DataFrame:
    """Adds ``scale``: the largest absolute reverse sum of the scores over all rows, by which they are divided."""
    top = rows.agg(F.max(F.array_max(F.transform(A.discounted(F.col(scores), 1.0), F.abs))).alias("scale"))
    return rows.join(F.broadcast(top))  # one row


def sign_agreement(score: Column, good: Column) -> Column:
    """Share of rollouts whose score is positive just where they are good."""
    return F.avg(((score > 0) == good).cast("double"))


def log_sigmoid(x: Column) -> Column:
    """Logarithm of the logistic function, without overflow."""
    return F.least(x, F.lit(0.0)) - F.log1p(F.exp(-F.abs(x)))


def cross_entropy(score: Column, good: Column, beta: float) -> Column:
    """Mean cross-entropy of a score's logistic value against good and bad."""
    z = beta * score
    return F.avg(-F.when(good, log_sigmoid(z)).otherwise(log_sigmoid(-z)))


def detached_loss(rollouts: DataFrame, group: str, score: str, good: Column, beta: float) -> DataFrame:
    """One row ``loss``: each rollout against the mean score of its group's opposite kind, 0 where there is none."""
    w, s = Window.partitionBy(group), F.col(score)
    x = rollouts.withColumn("__good", good)
    x = x.withColumns({"__g": F.avg(F.when(F.col("__good"), s)).over(w), "__b": F.avg(F.when(~F.col("__good"), s)).over(w)})
    lead = F.when(F.col("__good"), s - F.coalesce("__b", F.lit(0.0))).otherwise(F.coalesce("__g", F.lit(0.0)) - s)
    return x.agg(F.avg(-log_sigmoid(beta * lead)).alias("loss"))


def preference_loss(margin: Column, kind: str = "sigmoid", beta: float = 0.1, smoothing: float = 0.0) -> Column:
    """Loss of a pair whose log-ratio of the chosen is ahead by ``margin``: ``sigmoid`` with label smoothing, or ``ipo``."""
    if kind == "sigmoid":
        z = beta * margin
        return -(1 - smoothing) * log_sigmoid(z) - smoothing * log_sigmoid(-z)
    if kind == "ipo":
        off = margin - 1 / (2 * beta)
        return off * off
    raise ValueError(f"no such loss: {kind}")


def preferred_in_pairs(rollouts: DataFrame, group: str, sample: str, reward: str) -> DataFrame:
    """Adds ``preferred``: of each two neighbours in a group the one with the higher reward, the first of equals; samples count from 1."""
    pair = rollouts.withColumn("__pair", F.floor((F.col(sample) - 1) / 2))
    w = Window.partitionBy(group, "__pair").orderBy(F.desc(reward), sample)
    return pair.withColumn("preferred", F.row_number().over(w) == 1).drop("__pair")


def self_play_loss(kls: Column, advantage: Column, beta: float) -> Column:
    """Squared distance of a sequence's log-ratio from its advantage over ``beta``."""
    off = A.total(kls) - advantage / beta
    return off * off


def replaced(ids: Column, keep: int, target: Column, end: int) -> Column:
    """``struct<ids, mask, positions>``: the first ids, then a target and the end id, all of them valid."""
    new = F.concat(F.slice(ids, 1, keep), target, F.array(F.lit(end).cast("long")))
    return F.struct(new.alias("ids"), F.transform(new, lambda _: F.lit(1)).alias("mask"), F.transform(new, lambda _, i: i.cast("long")).alias("positions"))
