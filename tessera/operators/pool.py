"""Skeleton pools: grouping of equal skeletons, profiles, demonstrations, budgets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.operators import batches, quantiles
from tessera.sources.shared import cut

#: Pieces of a line of weights, at most: what draws are dealt out by is no larger, whatever the number of rows.
PIECES = 8192
#: Sources that a pool entry lists at most.
SOURCES = 20


def split_by_success(rows: DataFrame, skeleton: str = "skeleton", error: str = "error") -> tuple[DataFrame, DataFrame]:
    """(rows with a skeleton and no error, the others)."""
    good = F.col(error).isNull() & (F.coalesce(F.col(skeleton), F.lit("")) != "")
    return rows.where(good), rows.where(~good)


def pool(rows: DataFrame, skeleton: str, index: str, firsts: list[str], sources: int = SOURCES) -> DataFrame:
    """``(pool_id, skeleton, count, first_<index>, first_<c>..., source_indices)`` for each skeleton.

    pool_id is the place by first occurrence, from 0. Of a group's indexes only
    the smallest are gathered: ranks are cut before and after the shuffle, so
    that a skeleton with a third of all rows is no burden.
    """
    some = F.min(F.struct(index, *firsts)).alias("f")
    groups = rows.groupBy(F.col(skeleton).alias("skeleton")).agg(F.count(F.lit(1)).alias("count"), some)
    low = rows.select(F.col(skeleton).alias("skeleton"), index).withColumn("r", F.row_number().over(Window.partitionBy("skeleton").orderBy(index))).where(F.col("r") <= sources)
    lists = low.groupBy("skeleton").agg(F.array_sort(F.collect_list(index)).alias("source_indices"))
    out = groups.join(lists, "skeleton").select("skeleton", "count", F.col(f"f.{index}").alias(f"first_{index}"), *[F.col(f"f.{c}").alias(f"first_{c}") for c in firsts], "source_indices")
    return batches.number(out, [f"first_{index}"], "pool_id")


def entries(rows: DataFrame, skeleton: str, fields: list[str], order: str) -> DataFrame:
    """``(fid, skeleton, count, place, order, fields...)``: the entries of the skeletons that aren't blank, one row each.

    Skeletons have ids in their order, and a skeleton's entries places by
    ``order``, which tells rows apart: a skeleton that most rows have is no
    list in one place.
    """
    kept = rows.where(F.trim(F.col(skeleton)) != "").select(F.col(skeleton).alias("skeleton"), order, *fields)
    groups = batches.number(kept.groupBy("skeleton").agg(F.count(F.lit(1)).alias("count")), ["skeleton"], "fid")
    placed = batches.place_in_group(kept, "skeleton", [order])
    return placed.join(groups, "skeleton").select("fid", "skeleton", "count", "place", order, *fields)


def demonstrations(rows: DataFrame, group: str, order: str, failed: str) -> DataFrame:
    """Adds ``demos`` and the number of ``failed`` ones of the row's group, and its ``place`` in it; ``order`` tells rows apart."""
    counts = rows.groupBy(F.col(group).alias("__group")).agg(F.count(F.lit(1)).alias("demos"), F.count_if(F.col(failed)).alias("__failed"))
    placed = batches.place_in_group(rows.drop(failed), group, [order])
    return placed.join(counts, F.col(group).eqNullSafe(F.col("__group"))).withColumnRenamed("__failed", failed).drop("__group")


def frequency_profile(pool_: DataFrame, digits: int = 4) -> DataFrame:
    """One row: rows used, different skeletons, mean and largest count, and how many have 1, 2-5, 6-10 and more."""
    c = F.col("count")
    return pool_.agg(
        F.sum(c).alias("used"),
        F.count(F.lit(1)).alias("unique"),
        F.round(F.sum(c) / F.count(F.lit(1)), digits).alias("mean"),
        F.max(c).alias("most"),
        F.count_if(c == 1).alias("once"),
        F.count_if(c.between(2, 5)).alias("few"),
        F.count_if(c.between(6, 10)).alias("some"),
        F.count_if(c >= 11).alias("many"),
    )


def most_frequent(pool_: DataFrame, n: int, tie: str) -> DataFrame:
    """The n entries with the largest counts; of equals the first by ``tie``."""
    return pool_.orderBy(F.desc("count"), tie).limit(n)


def reason_counts(failures: DataFrame, reason: str) -> DataFrame:
    return failures.groupBy(F.coalesce(reason, F.lit("unknown")).alias("reason")).agg(F.count(F.lit(1)).alias("n"))


def last_by_rank(records: DataFrame, rank: str, place: str, status: str, wanted: str) -> DataFrame:
    """For each rank the last record with the wanted status."""
    kept = records.where((F.col(status) == wanted) & F.col(rank).isNotNull())
    rest = [c for c in records.columns if c not in (rank, place)]
    return kept.groupBy(rank).agg(F.max(F.struct(place, *rest)).alias("m")).select(rank, "m.*")


def first_n_by_group(rows: DataFrame, group: str, order: list[Column | str], n: int) -> DataFrame:
    """The first n rows of each group; cut before the shuffle as well."""
    return rows.withColumn("__r", F.row_number().over(Window.partitionBy(group).orderBy(*order))).where(F.col("__r") <= n).drop("__r")


def type_budgets(counts: DataFrame, cap: int) -> DataFrame:
    """Adds ``budget`` to ``(kind, n)``: in proportion to n within ``cap``, one at least; scaled down once if the sum is over it."""
    total = F.sum("n").over(Window.partitionBy())
    first = F.greatest(F.lit(1), F.floor(F.col("n") / total * cap)).cast("long")
    some = counts.withColumn("__b", first).withColumn("__s", F.sum("__b").over(Window.partitionBy()))
    scaled = F.greatest(F.lit(1), F.floor(F.col("__b") / F.col("__s") * cap)).cast("long")
    return some.withColumn("budget", F.when(F.col("__s") > cap, scaled).otherwise(F.col("__b"))).drop("__b", "__s")


def sample_exact(rows: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows without replacement, those whose keys hash lowest; all, if there are no more."""
    return rows.orderBy(F.xxhash64(F.col(key), F.lit(seed)), key).limit(n)


def resample_weighted(rows: DataFrame, key: str, weight: Column, n: int, seed: int) -> DataFrame:
    """n draws with replacement, by weight: ``(draw, key)``.

    Rows lie end to end on a line by their weights; each draw is a point of it
    by hash. Points and rows meet by pieces of the line, so that no row is
    held against all draws.
    """
    weighed = batches.number(rows.select(F.col(key), (F.abs(weight).cast("double") + 1e-8).alias("w")), [key], "__k")
    piece = F.floor(F.col("__k") / max(1024, -(-weighed.count() // PIECES)))
    sums = weighed.groupBy(piece.alias("__p")).agg(F.sum("w").alias("__w"))
    order = Window.orderBy("__p")
    sums = sums.withColumn("__to", F.sum("__w").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    sums = sums.withColumn("__from", F.coalesce(F.lag("__to").over(order), F.lit(0.0)))
    total = sums.agg(F.max("__to").alias("t")).head()["t"]
    draws = rows.sparkSession.range(n).select(F.col("id").alias("draw"), (F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 40)) / float(1 << 40) * total).alias("u"))
    hit = draws.join(F.broadcast(sums), (F.col("u") >= F.col("__from")) & (F.col("u") < F.col("__to"))).select("draw", "u", "__p", "__from")
    within = weighed.withColumn("__p", piece)
    w = Window.partitionBy("__p").orderBy("__k")
    within = within.withColumn("__hi", F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0))).withColumn("__lo", F.coalesce(F.lag("__hi").over(w), F.lit(0.0)))
    at = F.col("u") - F.col("__from")
    last = F.max("__hi").over(Window.partitionBy("__p"))
    within = within.withColumn("__hi", F.when(F.col("__hi") == last, F.col("__hi") + 1.0).otherwise(F.col("__hi")))
    return hit.join(within, "__p").where((at >= F.col("__lo")) & (at < F.col("__hi"))).select("draw", key)


def stratified_quota(candidates: DataFrame, weights: list[float], budget: int, seed: int) -> DataFrame:
    """``(idx, rank)`` drawn from ``candidates(rank, idx)`` by quotas of ranks, then from what is left over.

    Rank r gets int(weight * budget) of its candidates that no earlier rank
    took; quotas that aren't used are not handed on, but one last fill takes
    the rest of the budget from all that is left. Ranks are few; candidates
    stay distributed.
    """
    spark = candidates.sparkSession
    taken = None
    order = [F.xxhash64("idx", F.lit(seed)), "idx"]
    for rank, weight in enumerate(weights):
        own = candidates.where(F.col("rank") == rank).select("idx").distinct()
        if taken is not None:
            own = own.join(taken, "idx", "left_anti")
        got = own.orderBy(*order).limit(int(weight * budget)).withColumn("rank", F.lit(rank))
        taken = cut(got if taken is None else taken.unionByName(got))  # at most the budget; else the plan doubles with each rank
    if taken is None:
        return spark.createDataFrame([], "idx long, rank int")
    left = budget - taken.count()
    rest = candidates.select("idx").distinct().join(taken, "idx", "left_anti")
    return taken.unionByName(rest.orderBy(*order).limit(max(0, left)).withColumn("rank", F.lit(-1)))


def sample_rest(rows: DataFrame, taken: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """n rows of those whose key isn't taken yet."""
    return sample_exact(rows.join(taken.select(key).distinct(), key, "left_anti"), key, n, seed)


def budget_split(used: Column, budget: int, share: float) -> tuple[Column, Column]:
    """(what is left of a budget, how much of that is drawn at random)."""
    left = F.greatest(F.lit(0), F.lit(budget) - used)
    return left, F.floor(left * share)


def output_stats(rows: DataFrame, kind: str, key: str) -> DataFrame:
    """``(kind, n, distinct)``: rows and different keys of each kind."""
    return rows.groupBy(kind).agg(F.count(F.lit(1)).alias("n"), F.countDistinct(key).alias("distinct"))


def percentiles(rows: DataFrame, value: str, at: list[float]) -> DataFrame:
    """``(p, value)`` for each percentile, exactly, by ranges that are narrowed: see ``operators.quantiles``."""
    found = quantiles.exact(rows, value, [p / 100 for p in at])
    return rows.sparkSession.createDataFrame(list(zip(at, found, strict=True)), "p double, value double")


def above_edges(rows: DataFrame, edges: DataFrame, value: str, key: str, n: int) -> DataFrame:
    """For each of a few ``edges(p, edge)`` the n rows with the largest values at or above it."""
    return first_n_by_group(rows.join(F.broadcast(edges), F.col(value) >= F.col("edge")), "p", [F.desc(F.round(value, 12)), key], n)


def compact(rows: DataFrame, keys: list[str], texts: dict[str, tuple[Column, int]]) -> DataFrame:
    """Keys, and texts cut to their first characters, for a report."""
    return rows.select(*keys, *[F.substring(x, 1, n).alias(name) for name, (x, n) in texts.items()])
