"""Failure-driven retrieval: joins of failed prompts, neighbours, entries and what was added before."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.operators import batches


def distinct_failures(failed: DataFrame) -> DataFrame:
    """``(split, index, seen)``: each failed prompt once, with its first place."""
    return failed.groupBy("split", "index").agg(F.min("seen").alias("seen"))


def resolve(failures: DataFrame, embeddings: DataFrame) -> DataFrame:
    """Failures with their embeddings by ``index``; null where there is none."""
    return failures.join(embeddings, "index", "left")


def rank_candidates(knn: DataFrame, entries: DataFrame, added: DataFrame) -> DataFrame:
    """``(rank, idx)`` of the entries of matched skeletons, without what was added before."""
    return knn.join(entries, "fid").join(added.distinct(), "idx", "left_anti").select("rank", "idx").distinct()


def candidate_entries(candidates: DataFrame, bank: DataFrame) -> DataFrame:
    """Candidates with their SQL; those without any go."""
    return candidates.join(bank, "idx").where("sql IS NOT NULL AND sql <> ''").select("idx", "sql")


def stats(added: DataFrame, bank: DataFrame) -> DataFrame:
    """One row: how many rows of the bank were added, how many are left, and their share."""
    flagged = bank.join(added.select("idx", F.lit(1).alias("a")).distinct(), "idx", "left")
    return flagged.agg(F.count("a").alias("added"), (F.count(F.lit(1)) - F.count("a")).alias("remaining"), (F.count("a") / F.count(F.lit(1))).alias("utilization"))


def first_category(json: Column, ids: list[int]) -> Column:
    """The id of the first listed category that is among the ids; null without one or for what isn't JSON."""
    listed = F.from_json(json, "categories array<struct<id: int>>")["categories"]
    return F.get(F.filter(F.transform(listed, lambda c: c["id"]), lambda i: i.isin(*ids)), F.lit(0))


def by_place(candidates: Column, places: Column, n: int) -> Column:
    """Candidates by the places (from 1) that an answer lists: first mention counts, what doesn't exist goes, n at most."""
    valid = F.filter(places, lambda p: (p >= 1) & (p <= F.size(candidates)))
    return F.slice(F.transform(F.array_distinct(valid), lambda p: F.element_at(candidates, p)), 1, n)


def numbered_list(items: Column) -> Column:
    return F.array_join(F.transform(items, lambda x, i: F.concat((i + 1).cast("string"), F.lit(". "), x)), "\n")


def augment(rows: DataFrame, new: DataFrame, key: str, order: list[str]) -> DataFrame:
    """Rows and new ones, whose keys go on from the largest."""
    top = rows.agg(F.max(key).alias("__top"))
    numbered = batches.number(new, order, "__k").join(F.broadcast(top)).withColumn(key, F.coalesce("__top", F.lit(-1)) + 1 + F.col("__k"))
    return rows.unionByName(numbered.drop("__k", "__top", *order), allowMissingColumns=True)


def full_batches(rows: DataFrame, order: list[str], size: int) -> DataFrame:
    """Adds ``batch``; rows beyond the last full one go."""
    n = rows.count() // size
    return batches.number(rows, order).withColumn("batch", F.floor(F.col("k") / size)).where(F.col("batch") < n).drop("k")


def structural(categories: DataFrame, id_: str, wanted: range) -> DataFrame:
    """The categories of errors that concern a query's structure."""
    return categories.where(F.col(id_).between(wanted.start, wanted.stop - 1))


def diagnosis_stats(diagnoses: DataFrame, category: str, wanted: range) -> DataFrame:
    """One row: diagnoses, those of structural errors, and the others."""
    s = F.col(category).between(wanted.start, wanted.stop - 1)
    return diagnoses.agg(F.count(F.lit(1)).alias("diagnosed"), F.count_if(s).alias("structural"), F.count_if(~s).alias("other"))


def first_epochs(rows: DataFrame, key: str, epoch: str) -> DataFrame:
    """``(key, epoch)``: each row in the first epoch that has it; later ones exclude it."""
    return rows.groupBy(key).agg(F.min(epoch).alias(epoch))
