"""Groups of rollouts: solve status, advantages, filters, preferences.

Rollouts are rows ``(uid, sample, reward, ...)``. Group statistics are
window functions over ``uid``; what concerns the whole batch is a one-row
aggregate.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import batches
from tessera.operators.losses import masked_moments

#: Reward of a rollout that is right in format and result.
SOLVED = 4.0
EPSILON = 1e-6


def by(*keys: str) -> Window:
    return Window.partitionBy(*keys)


def solve_status(rollouts: DataFrame, solved: float = SOLVED) -> DataFrame:
    """``(uid, solve_none, solve_all, total)``: no rollout reaches ``solved``; all have just that."""
    r = F.col("reward")
    out = rollouts.groupBy("uid").agg((F.max(r) < solved).alias("solve_none"), ((F.min(r) == solved) & (F.max(r) == solved)).alias("solve_all"), F.sum(r).alias("total"))
    return out


def solve_ratios(rollouts: DataFrame, solved: float = SOLVED) -> DataFrame:
    """One row: number of groups of which none or all are solved, shares of solved and failed rollouts."""
    groups = solve_status(rollouts, solved).agg(F.count_if("solve_none").alias("solve_none"), F.count_if("solve_all").alias("solve_all"))
    rows = rollouts.agg(F.avg((F.col("reward") == solved).cast("double")).alias("solved"), F.avg((F.col("reward") != solved).cast("double")).alias("failed"))
    return groups.join(F.broadcast(rows))  # one row each


def first_failed(rollouts: DataFrame, solved: float = SOLVED) -> DataFrame:
    """The rollout with the smallest sample of each group that has no solved one."""
    firsts = rollouts.groupBy("uid").agg(F.max("reward").alias("best"), F.min_by(F.struct("sample", "reward"), F.struct("sample", "reward")).alias("f"))
    return firsts.where(F.col("best") < solved).select("uid", "f.sample", "f.reward")


def take_buffer(buffer: DataFrame, n: int, order: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the first n rows of a first-in-first-out buffer, the rest)."""
    head = buffer.orderBy(*order).limit(n)
    return head, buffer.join(head.select(*order), order, "left_anti")


def grpo(rollouts: DataFrame, with_std: bool = True, eps: float = EPSILON) -> DataFrame:
    """Adds ``advantage``: reward less the group's mean, over its sample deviation; alone: mean 0, deviation 1."""
    w, r = by("uid"), F.col("reward")
    one = F.count(F.lit(1)).over(w) == 1
    mean = F.when(one, 0.0).otherwise(F.avg(r).over(w))
    std = F.when(one, 1.0).otherwise(F.stddev_samp(r).over(w))
    return rollouts.withColumn("advantage", (r - mean) / (std + eps) if with_std else r - mean)


def pass_at_k(rollouts: DataFrame, with_std: bool = False, eps: float = EPSILON) -> DataFrame:
    """Adds ``advantage``: for a group's best rollout (first of equals) its lead over the second, else 0.

    Groups of one raise.
    """
    w, r = by("uid"), F.col("reward")
    order = w.orderBy(F.desc("reward"), "sample")
    ranked = rollouts.withColumns({"__n": F.count(F.lit(1)).over(w), "__k": F.row_number().over(order), "__second": F.lead("reward").over(order), "__std": F.stddev_samp(r).over(w)})
    lead = r - F.col("__second")
    lead = lead / (F.col("__std") + eps) if with_std else lead
    checked = F.when(F.col("__n") < 2, F.raise_error(F.lit("a group has fewer than two rollouts")).cast("double")).otherwise(lead)
    return ranked.withColumn("advantage", F.when(F.col("__k") == 1, checked).otherwise(0.0)).drop("__n", "__k", "__second", "__std")


def rloo(rollouts: DataFrame) -> DataFrame:
    """Adds ``advantage``: reward less the mean of the group's other rollouts; alone: the reward."""
    w, r = by("uid"), F.col("reward")
    n = F.count(F.lit(1)).over(w)
    return rollouts.withColumn("advantage", F.when(n == 1, r).otherwise((r - F.avg(r).over(w)) * n / (n - 1)))


def opo(rollouts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Adds ``advantage``: reward less the group's mean weighted by length; alone: the reward."""
    w, r, n = by("uid"), F.col("reward"), F.col(length)
    base = F.when(F.count(F.lit(1)).over(w) == 1, 0.0).otherwise(F.sum(r * n).over(w) / F.sum(n).over(w))
    return rollouts.withColumn("advantage", r - base)


def reinforce_baseline(rollouts: DataFrame, length: str = "n_tokens") -> DataFrame:
    """Adds ``advantage``: reward less the group's mean, whitened over all tokens of the batch; null for a batch of one token."""
    centred = rollouts.withColumn("__c", F.col("reward") - F.when(F.count(F.lit(1)).over(by("uid")) == 1, 0.0).otherwise(F.avg("reward").over(by("uid"))))
    m = masked_moments(centred, F.col("__c"), F.col(length))
    return centred.join(F.broadcast(m)).withColumn("advantage", (F.col("__c") - F.col("mean")) / F.sqrt(F.col("var") + 1e-8)).drop("__c", "mean", "var")


def returns(tokens: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``ret`` to rows ``(keys, pos, reward)``: the sum of rewards from there to the end."""
    w = by(*keys).orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, 0)
    return tokens.withColumn("ret", F.sum("reward").over(w))


def remax(tokens: DataFrame, keys: list[str], baseline: str) -> DataFrame:
    """Adds ``advantage``: the return less a baseline of the row."""
    return returns(tokens, keys).withColumn("advantage", F.col("ret") - F.col(baseline))


def dynamic_sampling(rollouts: DataFrame) -> DataFrame:
    """Rollouts of groups whose rewards differ, and of groups of one."""
    w = by("uid")
    out = rollouts.withColumns({"__s": F.stddev_pop("reward").over(w), "__n": F.count(F.lit(1)).over(w)})
    return out.where((F.col("__s") > 0) | (F.col("__n") == 1)).drop("__s", "__n")


def first_groups(rollouts: DataFrame, n: int) -> DataFrame:
    """All rollouts of the n groups with the smallest uid."""
    return rollouts.join(rollouts.select("uid").distinct().orderBy("uid").limit(n), "uid", "left_semi")


def accuracy_band(rollouts: DataFrame, low: float, high: float, max_tokens: int, oversample: float, solved: float = SOLVED) -> DataFrame:
    """``(uid, acc, passes)`` of the groups kept: those within the accuracy band and not too long first, 1/oversample of all."""
    groups = rollouts.groupBy("uid").agg(F.avg((F.col("reward") == solved).cast("double")).alias("acc"), F.max("n_tokens").alias("longest"))
    passes = (F.col("acc") >= low) & (F.col("acc") <= high) & (F.col("longest") < max_tokens)
    ranked = groups.withColumn("passes", passes)
    n = ranked.count()
    return ranked.orderBy(F.desc("passes"), "uid").limit(int(n / oversample)).select("uid", "acc", "passes")


def pair_accuracy(rollouts: DataFrame, score: str, acc: str) -> DataFrame:
    """``(uid, accuracy)``: share of pairs that the score orders as the accuracy does, weighted by its difference; 0.5 if there is none.

    Groups of one have no pairs and no row. Rollouts of a group with equal
    accuracy and score are one, with their number, before pairs are made.
    """
    cells = rollouts.groupBy("uid", F.col(acc).alias("a"), F.col(score).alias("s")).agg(F.count(F.lit(1)).alias("n"))
    low, high = (cells.select("uid", F.col("a").alias(f"a{k}"), F.col("s").alias(f"s{k}"), F.col("n").alias(f"n{k}")) for k in (0, 1))
    weight = F.col("n0") * F.col("n1") * (F.col("a1") - F.col("a0"))
    pairs = low.join(high, "uid").where("a0 < a1").groupBy("uid").agg(F.sum(F.when(F.col("s1") > F.col("s0"), weight).otherwise(0.0)).alias("x"), F.sum(weight).alias("y"))
    groups = rollouts.groupBy("uid").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("uid")
    return groups.join(pairs, "uid", "left").select("uid", F.when(F.col("y") > 0, F.col("x") / F.col("y")).otherwise(0.5).alias("accuracy"))


def prefer(rollouts: DataFrame, order: str) -> DataFrame:
    """Adds ``preferred``: of each two neighbours in ``order`` the one with the higher reward, the first of equals."""
    pair = rollouts.withColumn("__pair", F.floor(F.col(order) / 2))
    w = by("__pair").orderBy(F.desc("reward"), order)
    return pair.withColumn("preferred", F.row_number().over(w) == 1).drop("__pair")


def soft_mean(df: DataFrame, value: str, beta: float) -> DataFrame:
    """One row ``softmean``: log of the mean of exp(beta x), over beta; the mean if beta is 0."""
    x = F.col(value)
    if beta == 0:
        return df.agg(F.avg(x).alias("softmean"))
    top = df.agg(F.max(x * beta).alias("m"))
    return df.join(F.broadcast(top)).agg((F.first("m") / beta + F.log(F.avg(F.exp(x * beta - F.col("m")))) / beta).alias("softmean"))


def soft_advantage(rollouts: DataFrame, beta: float = 1.0) -> DataFrame:
    """Adds ``advantage``: reward less the soft mean of the whole batch."""
    return rollouts.join(F.broadcast(soft_mean(rollouts, "reward", beta))).withColumn("advantage", F.col("reward") - F.col("softmean")).drop("softmean")


def kl_estimate(logp: Column, ref: Column, kind: str) -> Column:
    """Estimates of the divergence from two log-probabilities: kl (k1), abs, mse (k2), low_var_kl (k3, within 10)."""
    d = logp - ref
    if kind == "kl":
        return d
    if kind == "abs":
        return F.abs(d)
    if kind == "mse":
        return 0.5 * d * d
    if kind == "low_var_kl":
        k = F.exp(-d) + d - 1
        return F.greatest(F.least(k, F.lit(10.0)), F.lit(-10.0))
    raise ValueError(f"no such estimate: {kind}")


def adaptive_kl(steps: DataFrame, order: list[str], kl: str, n: str, start: float, target: float, horizon: float) -> DataFrame:
    """Adds ``beta``, the coefficient of an adaptive controller after each step.

    A step multiplies the coefficient by 1 plus its clipped error, which does
    not depend on the coefficient: the product up to a step is a running sum
    of logarithms, counts of negative factors and of zeros.
    """
    error = F.greatest(F.least(F.col(kl) / target - 1, F.lit(0.2)), F.lit(-0.2))
    factor = 1 + error * F.col(n) / horizon
    parts = {"__log": F.when(factor != 0, F.log(F.abs(factor))).otherwise(0.0), "__odd": (factor < 0).cast("long"), "__zero": (factor == 0).cast("long")}
    out = steps
    for name, part in parts.items():
        out = batches.running(out, order, part, name)
    sign = F.when(F.col("__zero") > 0, 0.0).when(F.col("__odd") % 2 == 1, -1.0).otherwise(1.0)
    return out.withColumn("beta", sign * start * F.exp("__log")).drop(*parts)


def kl_controller(kind: str, steps: DataFrame, order: list[str], kl: str, n: str, start: float, target: float = 0.1, horizon: float = 10_000.0) -> DataFrame:
    """Adds ``beta`` by the controller's name: ``fixed`` or ``adaptive``."""
    if kind == "fixed":
        return steps.withColumn("beta", F.lit(float(start)))
    if kind == "adaptive":
        if horizon <= 0:
            raise ValueError("the horizon must be larger than 0")
        return adaptive_kl(steps, order, kl, n, start, target, horizon)
    raise ValueError(f"no such controller: {kind}")


#: Estimators of advantages of whole rollouts, by name.
ESTIMATORS = {
    "grpo": lambda df: grpo(df),
    "grpo_no_std": lambda df: grpo(df, with_std=False),
    "grpo_passk": lambda df: pass_at_k(df),
    "rloo": lambda df: rloo(df),
    "opo": lambda df: opo(df),
    "reinforce_plus_plus_baseline": lambda df: reinforce_baseline(df),
    "soft": lambda df: soft_advantage(df),
}


def advantage(rollouts: DataFrame, estimator: str, allowed: tuple[str, ...] = tuple(ESTIMATORS)) -> DataFrame:
    """Adds ``advantage`` by an estimator's name; raises for others than the allowed ones."""
    if estimator not in allowed or estimator not in ESTIMATORS:
        raise ValueError(f"no such estimator: {estimator}; there are {', '.join(x for x in ESTIMATORS if x in allowed)}")
    return ESTIMATORS[estimator](rollouts)
