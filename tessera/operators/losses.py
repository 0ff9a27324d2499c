"""Losses as masked reductions over token rows or arrays."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.functions import arrays as A

#: Keeps a mean over nothing from dividing by zero.
EPSILON = 1e-8
#: Bins of a histogram that an order statistic is looked for in.
BINS = 4096


def masked_mean(value: Column, mask: Column) -> Column:
    return F.sum(value * mask) / (F.sum(mask) + EPSILON)


def weighted_mean(value: Column, weight: Column) -> Column:
    """The mean of values that count by their weights; null if nothing counts."""
    return F.try_divide(F.sum(value * weight), F.sum(weight))


def clip(value: Column, low: Column, high: Column) -> Column:
    """The value within its bounds, which may be columns."""
    return F.greatest(F.least(value, high), low)


def aggregate_loss(rows: DataFrame, loss: str, mask: str, mode: str, width: int | None = None) -> DataFrame:
    """One row ``loss`` of rows with arrays of token losses and a mask.

    ``token-mean``: over all tokens; ``seq-mean-token-sum`` and
    ``seq-mean-token-mean``: mean over rows of their sums or means;
    ``seq-mean-token-sum-norm``: sum over all, over ``width``.
    """
    x = rows.select(A.masked_sum(F.col(loss), F.col(mask)).alias("v"), A.total(F.col(mask)).alias("n"))
    out = {
        "token-mean": F.sum("v") / (F.sum("n") + EPSILON),
        "seq-mean-token-sum": F.avg("v"),
        "seq-mean-token-mean": F.avg(F.when(F.col("n") == 0, 0.0).otherwise(F.col("v") / F.col("n"))),
        "seq-mean-token-sum-norm": F.sum("v") / F.lit(width),
    }
    return x.agg(out[mode].alias("loss"))


def policy_loss(tokens: DataFrame, old: Column, new: Column, advantage: Column, mask: Column, low: float = 0.2, high: float = 0.2, dual: float = 3.0) -> DataFrame:
    """Clipped policy loss with a second bound for negative advantages, clip fractions and the mean divergence.

    ``old`` and ``new`` stand for the log-probabilities whose ratio is
    exp(old - new) here: the caller names them by the direction wanted.
    """
    ratio = F.exp(old - new)
    plain = -advantage * ratio
    clipped = -advantage * F.greatest(F.least(ratio, F.lit(1 + high)), F.lit(1 - low))
    first = F.greatest(plain, clipped)
    bound = -advantage * dual
    loss = F.when(advantage < 0, F.least(first, bound)).otherwise(first)
    return tokens.agg(
        masked_mean(loss, mask).alias("loss"),
        masked_mean((clipped > plain).cast("double"), mask).alias("clip_fraction"),
        masked_mean(new - old, mask).alias("kl"),
        masked_mean(((first > bound) & (advantage < 0)).cast("double"), mask).alias("lower_clip_fraction"),
    )


def value_loss(tokens: DataFrame, predicted: Column, target: Column, old: Column, mask: Column, clip: float) -> DataFrame:
    """Clipped squared error of values, and how often the clipped one counts."""
    near = F.greatest(F.least(predicted, old + clip), old - clip)
    plain, clipped = (predicted - target) ** 2, (near - target) ** 2
    return tokens.agg(masked_mean(F.greatest(plain, clipped), mask).alias("loss"), masked_mean((clipped > plain).cast("double"), mask).alias("clip_fraction"))


def masked_moments(tokens: DataFrame, value: Column, mask: Column) -> DataFrame:
    """One row ``(mean, var)`` of values that count as often as the mask says, with Bessel's correction.

    ``var`` is null for fewer than two. The data is read twice: squares are
    those of deviations from the mean, so that large means do no harm.
    """
    first = tokens.agg(F.sum(mask).cast("double").alias("__n"), (F.sum(mask * value) / (F.sum(mask) + EPSILON)).alias("__mean"))
    off = value - F.col("__mean")
    both = tokens.join(F.broadcast(first)).agg(F.first("__n").alias("n"), F.first("__mean").alias("mean"), F.sum(mask * off * off).alias("q"))
    var = F.col("q") / (F.col("n") + EPSILON) * F.try_divide(F.col("n"), F.col("n") - 1)
    return both.select("mean", F.when(F.col("n") > 1, var).alias("var"))


def whiten(tokens: DataFrame, value: str, mask: str) -> DataFrame:
    """Adds ``white``, the value with mean 0 and variance 1 over what the mask has, and the ``mean``."""
    m = masked_moments(tokens, F.col(value), F.col(mask))
    return tokens.join(F.broadcast(m)).withColumn("white", (F.col(value) - F.col("mean")) / F.sqrt(F.col("var") + EPSILON))


def sft_loss(tokens: DataFrame, version: str) -> DataFrame:
    """One row ``loss`` of tokens with log-probability ``logp``, entropy ``ent`` and mask ``m``.

    v0: negative log-likelihood; v1 and v3: weighted by half the exponential of
    the negative or positive entropy; v2: -p / (p + 0.1); v7 and v8: weighted
    by p and p (1 - p).
    """
    p, h, nll = F.exp("logp"), F.col("ent"), -F.col("logp")
    loss = {"v0": nll, "v1": nll * 0.5 * F.exp(-h), "v2": -p / (p + 0.1), "v3": nll * 0.5 * F.exp(h), "v7": nll * p, "v8": nll * p * (1 - p)}[version]
    return tokens.agg(masked_mean(loss, F.col("m")).alias("loss"))


def order_statistic(values: DataFrame, column: str, k: int) -> float | None:
    """The k-th smallest value (from 1); null if there are fewer. Nulls and NaNs don't count.

    A histogram of BINS equal bins tells which bin has it, the next one parts
    that bin, until it holds one value: a few passes, and no task or driver
    ever has more than BINS counts.
    """
    x = F.col(column).cast("double")
    known = values.select(x.alias("x")).where(F.col("x").isNotNull() & ~F.isnan("x"))
    ends = known.agg(F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("n")).head()
    low, high, below = ends["low"], ends["high"], 0
    if ends["n"] < k:
        return None
    while low < high:
        width = (high - low) / BINS
        inside = known.where(F.col("x").between(low, high))
        if low + width > low and high - width < high:
            bin_ = F.least(F.floor((F.col("x") - low) / width), F.lit(BINS - 1))
        else:  # so few numbers lie between that each is a bin
            bin_ = F.col("x")
        for r in inside.groupBy(bin_.alias("b")).agg(F.count("x").alias("n"), F.min("x").alias("low"), F.max("x").alias("high")).orderBy("b").toLocalIterator():
            if below + r["n"] >= k:
                low, high = r["low"], r["high"]
                break
            below += r["n"]
    return low


def entropy_band_loss(tokens: DataFrame, low: float, high: float) -> DataFrame:
    """``(loss, tokens)``: mean negative log-likelihood of the tokens whose entropy is in a band of order statistics.

    A bound of 0 or 1 is none; values equal to a bound are in the band.
    """
    valid = tokens.where("m > 0")
    n = valid.count()
    kept = valid
    if high < 1 and (edge := order_statistic(valid, "ent", max(1, int(n * high)))) is not None:
        kept = kept.where(F.col("ent") <= edge)
    if low > 0:
        k = n - max(1, int(n * round(1 - low, 9))) + 1 if high == 1 else max(1, int(n * low))
        if (edge := order_statistic(valid, "ent", k)) is not None:
            kept = kept.where(F.col("ent") >= edge)
    return kept.agg((F.sum(-F.col("logp")) / (F.count(F.lit(1)) + EPSILON)).alias("loss"), F.count(F.lit(1)).alias("tokens"))


def entropy_loss_by_row(tokens: DataFrame, keys: list[str], ratio: float, lowest: bool) -> DataFrame:
    """As :func:`entropy_band_loss` with a bound for each row: its lowest or highest share of entropies."""
    w = Window.partitionBy(*keys)
    order = w.orderBy("ent" if lowest else F.desc("ent"))
    x = tokens.where("m > 0").withColumns({"__k": F.row_number().over(order), "__n": F.count(F.lit(1)).over(w)})
    inside = F.when(F.col("__k") <= F.greatest(F.lit(1), F.floor(F.col("__n") * ratio)), F.col("ent"))
    edge = (F.max(inside) if lowest else F.min(inside)).over(w)
    x = x.withColumn("__e", edge).where(F.col("ent") <= F.col("__e") if lowest else F.col("ent") >= F.col("__e"))
    return x.agg((F.sum(-F.col("logp")) / (F.count(F.lit(1)) + EPSILON)).alias("loss"), F.count(F.lit(1)).alias("tokens"))


def overlong_penalty(length: Column, limit: int, buffer: int, factor: float) -> Column:
    """0 up to ``limit - buffer``, then falling by ``factor`` over the buffer."""
    return F.least(-(length - (limit - buffer)) / buffer * factor, F.lit(0.0))
