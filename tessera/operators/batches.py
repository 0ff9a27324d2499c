"""Batch algebra: rows with an explicit order, chunked, repeated, padded, folded."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessera.sources.shared import cut, free


def ranged(df: DataFrame, order: list[str], id_: str) -> DataFrame:
    """``df`` in range partitions by columns that tell all rows apart, with the partition and the place in it in ``id_``.

    The partitions are written once, as ranges are drawn from samples and
    would not be the same a second time.
    """
    parts = max(1, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    # The id holds the partition in its upper bits and the row's place in the lower 33.
    return cut(df.repartitionByRange(parts, *order).sortWithinPartitions(*order).withColumn(id_, F.monotonically_increasing_id()))


def number(df: DataFrame, order: list[str], name: str = "k") -> DataFrame:
    """Adds the place of each row, from 0, by columns that tell all rows apart.

    Rows are range-partitioned and numbered within their partitions; what
    stands before a partition is added up, so that no task gets all rows.
    """
    id_, part, n, before = free(df, "id", "part", "n", "before")
    marked = ranged(df, order, id_).withColumn(part, F.shiftright(id_, 33))
    counts = marked.groupBy(part).agg(F.count(F.lit(1)).alias(n))
    upto = counts.select(part, F.coalesce(F.sum(n).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias(before))
    place = F.col(before) + F.col(id_).bitwiseAND(F.lit((1 << 33) - 1))
    return marked.join(F.broadcast(upto), part).withColumn(name, place).select(*df.columns, name)


def running(df: DataFrame, order: list[str], value: Column, name: str, largest: bool = False) -> DataFrame:
    """Adds the sum, or the largest, of ``value`` up to each row by columns that tell all rows apart.

    As in :func:`number` partitions are reduced by themselves and only their
    results, one row each, are put in one place.
    """
    reduce = F.max if largest else F.sum
    id_, part, x, before = free(df, "id", "part", "x", "before")
    marked = ranged(df.withColumn(x, value), order, id_).withColumn(part, F.shiftright(id_, 33))
    totals = marked.groupBy(part).agg(reduce(x).alias(before))
    upto = totals.select(part, reduce(before).over(Window.orderBy(part).rowsBetween(Window.unboundedPreceding, -1)).alias(before))
    own = reduce(x).over(Window.partitionBy(part).orderBy(id_).rowsBetween(Window.unboundedPreceding, 0))
    full = F.greatest(own, before) if largest else F.coalesce(F.col(before), F.lit(0)) + own
    return marked.join(F.broadcast(upto), part).withColumn(name, full).select(*df.columns, name)


def place_in_group(df: DataFrame, group: str, order: list[str], name: str = "place") -> DataFrame:
    """Adds the place of each row in its group, from 0; a group may hold most of all rows."""
    (first,) = free(df, "first")
    numbered = number(df, [group, *order], name)
    starts = numbered.groupBy(F.col(group).alias(f"{first}_group")).agg(F.min(name).alias(first))
    joined = numbered.join(starts, F.col(group).eqNullSafe(F.col(f"{first}_group")))
    return joined.select(*df.columns, (F.col(name) - F.col(first)).alias(name))


def take(df: DataFrame, key: str, wanted: DataFrame) -> DataFrame:
    """Rows by ``wanted(key, pos)``: repeats and their order are kept in ``pos``."""
    return wanted.join(df, key)


def slice_rows(numbered: DataFrame, start: int, stop: int, step: int = 1, name: str = "k") -> DataFrame:
    """Rows start, start + step, ... below stop."""
    k = F.col(name)
    return numbered.where((k >= start) & (k < stop) & ((k - start) % step == 0))


def chunk_of(place: Column, n: Column | int, chunks: int) -> Column:
    """The equal, contiguous chunk of a place; raises if the rows can't be parted evenly."""
    n = F.lit(n) if isinstance(n, int) else n
    return F.when(n % chunks != 0, F.raise_error(F.lit(f"rows can't be parted into {chunks} equal chunks")).cast("long")).otherwise(F.floor(place * chunks / n))


def repeat(numbered: DataFrame, times: int, interleave: bool = True, name: str = "k") -> DataFrame:
    """Each row ``times`` times; ``pos`` is the place in the result: copies side by side, or the whole batch over and over."""
    copies = numbered.withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(times - 1))))
    if interleave:
        return copies.withColumn("pos", F.col(name) * times + F.col("copy"))
    n = numbered.agg((F.max(name) + 1).alias("__n"))
    return copies.join(F.broadcast(n)).withColumn("pos", F.col("copy") * F.col("__n") + F.col(name)).drop("__n")


def repeat_each(df: DataFrame, times: Column) -> DataFrame:
    """Each row as often as ``times`` says; 0 drops it."""
    return df.withColumn("copy", F.explode(F.when(times > 0, F.sequence(F.lit(0), times.cast("int") - 1)).otherwise(F.array().cast("array<int>"))))


def unfold(df: DataFrame, arrays: list[str], parts: int) -> DataFrame:
    """Arrays cut into ``parts`` equal pieces, one row each; other columns are repeated."""
    rest = [c for c in df.columns if c not in arrays]
    at = F.sequence(F.lit(0), F.lit(parts - 1))
    pieces = F.transform(at, lambda i: F.struct(i.alias("part"), *[F.slice(F.col(a), (i * F.size(a) / parts).cast("int") + 1, (F.size(a) / parts).cast("int")).alias(a) for a in arrays]))
    return df.select(*rest, F.explode(pieces).alias("x")).select(*rest, "x.*")


def pad_with_copies(df: DataFrame, numbered_by: str, n: int, first: bool = True) -> DataFrame:
    """Appends n copies of the first or last row; ``pad`` numbers them, 0 for own rows."""
    edge = df.orderBy(numbered_by if first else F.desc(numbered_by)).limit(1)
    return df.withColumn("pad", F.lit(0)).unionByName(edge.withColumn("pad", F.explode(F.sequence(F.lit(1), F.lit(n)))))


def pad_to_divisor(numbered: DataFrame, n: int, divisor: int, name: str = "k") -> DataFrame:
    """Rows appended from the head, over and over, until their number can be divided; places go on."""
    lack = -n % divisor
    rounds = -(-lack // max(n, 1))
    if not lack:
        return numbered
    more = numbered.withColumn("__r", F.explode(F.sequence(F.lit(1), F.lit(rounds)))).withColumn(name, F.col(name) + F.col("__r") * n).where(F.col(name) < n + lack)
    return numbered.unionByName(more.drop("__r"))


def fold(numbered: DataFrame, width: int, columns: list[str], name: str = "k") -> DataFrame:
    """Every ``width`` rows as one, with arrays in their order."""
    got = F.array_sort(F.collect_list(F.struct(name, *columns)))
    out = numbered.groupBy(F.floor(F.col(name) / width).alias("row")).agg(got.alias("x"))
    return out.select("row", *[F.col(f"x.{c}").alias(c) for c in columns])


def unite(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    """Columns of both by a key; columns that both have must be equal, else it raises."""
    shared = [c for c in b.columns if c in a.columns and c != key]
    right = b.select(key, *[F.col(c).alias(f"__{c}") for c in shared], *[c for c in b.columns if c not in a.columns])
    joined = a.join(right, key)
    for c in shared:
        joined = joined.withColumn(c, F.when(F.col(c).eqNullSafe(F.col(f"__{c}")), F.col(c)).otherwise(F.raise_error(F.lit(f"{c} differs"))))
    return joined.drop(*[f"__{c}" for c in shared])


def from_columns(spark: SparkSession, columns: dict[str, list], schema: str) -> DataFrame:
    """Rows of lists of equal length, numbered by ``k``; raises if lengths differ or columns aren't those of the schema."""
    lengths = {c: len(v) for c, v in columns.items()}
    if len(set(lengths.values())) > 1:
        raise ValueError(f"columns differ in length: {lengths}")
    names = [part.split()[0] for part in schema.split(", ")]
    if set(names) != set(columns):
        raise ValueError(f"columns are {sorted(columns)}, the schema has {names}")
    rows = [(k, *row) for k, row in enumerate(zip(*(columns[c] for c in names), strict=True))]
    return spark.createDataFrame(rows, f"k long, {schema}")


def check_lengths(df: DataFrame, arrays: list[str]) -> DataFrame:
    """``df``, raising at the first row whose arrays differ in length."""
    same = reduce_and([F.size(arrays[0]) == F.size(a) for a in arrays[1:]])
    first = F.when(same, F.col(arrays[0])).otherwise(F.raise_error(F.lit(f"{', '.join(arrays)} differ in length")))
    return df.withColumn(arrays[0], first)


def reduce_and(conditions: list[Column]) -> Column:
    out = F.lit(True)
    for c in conditions:
        out = out & c
    return out


def collate(numbered: DataFrame, size: int, columns: list[str], name: str = "k") -> DataFrame:
    """Batches of ``size`` rows as one row each with a list for each column, in order: ``(batch, n, columns)``.

    Lists have ``size`` elements at most.
    """
    out = fold(numbered, size, columns, name)
    return out.select(F.col("row").alias("batch"), F.size(columns[0]).alias("n"), *columns)


def save(df: DataFrame, path: str, meta: dict[str, str] | None = None) -> None:
    """Writes a batch as Parquet, with its meta information beside it."""
    df.write.mode("overwrite").parquet(f"{path}/rows")
    pairs = [(k, v) for k, v in sorted((meta or {}).items())]
    df.sparkSession.createDataFrame(pairs, "key string, value string").coalesce(1).write.mode("overwrite").parquet(f"{path}/meta")


def load(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, str]]:
    """What :func:`save` has written: rows and meta information."""
    return spark.read.parquet(f"{path}/rows"), {r["key"]: r["value"] for r in spark.read.parquet(f"{path}/meta").toLocalIterator()}


def pop(df: DataFrame, columns: list[str]) -> tuple[DataFrame, DataFrame]:
    """(the named columns, all others); raises for a name that isn't there."""
    lacking = [c for c in columns if c not in df.columns]
    if lacking:
        raise ValueError(f"there is no {', '.join(lacking)}")
    return df.select(*columns), df.drop(*columns)


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Columns under new names; raises for a name that isn't there."""
    lacking = [c for c in names if c not in df.columns]
    if lacking:
        raise ValueError(f"there is no {', '.join(lacking)}")
    return df.withColumnsRenamed(names)


def concat(parts: list[DataFrame], name: str | None = None) -> DataFrame:
    """All rows, columns by name; ``name`` numbers the parts."""
    numbered = [p if name is None else p.withColumn(name, F.lit(i)) for i, p in enumerate(parts)]
    out = numbered[0]
    for p in numbered[1:]:
        out = out.unionByName(p)
    return out


def reverse(numbered: DataFrame, n: int, name: str = "k") -> Column:
    """Places from the end."""
    return F.lit(n) - 1 - F.col(name)


def inverse(permutation: DataFrame, target: str, source: str) -> DataFrame:
    """The permutation that undoes ``(source -> target)``."""
    return permutation.select(F.col(target).alias(source), F.col(source).alias(target))


def mini_batches(numbered: DataFrame, size: int, epochs: int, name: str = "k") -> DataFrame:
    """Each row once for each epoch, with ``epoch`` and ``batch``."""
    each = numbered.withColumn("epoch", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))))
    return each.withColumn("batch", F.floor(F.col(name) / size))


def differing(df: DataFrame, a: Column, b: Column) -> DataFrame:
    """One row: rows, and how many of them have different values; nulls and NaNs are equal to their like."""
    return df.agg(F.count(F.lit(1)).alias("rows"), F.count_if(~a.eqNullSafe(b)).alias("different"))
