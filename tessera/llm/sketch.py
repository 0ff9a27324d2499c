"""Bottom-k sketches of shingle hashes, with built-in functions only.

A sketch is the sorted array of the k smallest different hashes of a text's
shingles. Sketches of parts merge into the sketch of the whole; two sketches
give estimates of resemblance and containment, one gives the number of
different shingles.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import table

#: Hashes of a sketch, and words of a shingle.
K, WORDS = 64, 5
#: Hashes below a limit that about REACH * k of them are under are sorted; all, if too few are.
REACH = 3
#: Neighbouring ids in a group of the pass that looks for the next document: 2**NEAR and 2**FAR.
NEAR, FAR = 6, 10


def let(x: Column, body) -> Column:
    """``body(x)`` with x computed once: a transform over an array of one."""
    return F.transform(F.array(x), body)[0]


def words(text: Column) -> Column:
    """Words between space and \\x09-\\x0D; none for a null text."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+"), "")


def hashes(w: Column, n: int = WORDS) -> Column:
    """Hash of each n-word shingle, repeats included; of the whole sequence if it is shorter; none without words."""
    one = lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(n)])
    many = F.transform(F.sequence(F.lit(0), F.size(w) - n), one)
    return F.when(F.size(w) >= n, many).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))


def smallest(h: Column, k: int = K) -> Column:
    """The k smallest different values of an array, sorted."""
    every = lambda a: F.slice(F.sort_array(F.array_distinct(a)), 1, k)
    limit = (F.lit(float(REACH * k)) / F.size(h) - 0.5) * float(1 << 64)
    low = let(limit.cast("bigint"), lambda t: F.filter(h, lambda x: x < t))
    picked = let(low, lambda a: let(every(a), lambda s: F.when(F.size(s) >= k, s).otherwise(every(h))))
    return F.when(F.size(h) <= 2 * REACH * k, every(h)).otherwise(picked)


def sketch(text: Column, k: int = K, n: int = WORDS) -> Column:
    """Bottom-k sketch of a text; empty for a null or wordless one."""
    return let(words(text), lambda w: let(hashes(w, n), lambda h: smallest(h, k)))


def merge(a: Column, b: Column, k: int = K) -> Column:
    """The sketch of two parts' union."""
    return F.slice(F.sort_array(F.array_union(a, b)), 1, k)


def resemblance(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of shared over all shingles, 0 to 1; two empty sketches are alike, and so are a null and an empty one."""
    none = F.array().cast("array<bigint>")
    return let(F.struct(F.coalesce(a, none).alias("a"), F.coalesce(b, none).alias("b")), lambda x: let(
        merge(x["a"], x["b"], k),
        lambda u: F.when(F.size(u) == 0, 1.0).otherwise(F.size(F.array_intersect(F.array_intersect(u, x["a"]), x["b"])) / F.size(u)),
    ))


def distinct_count(a: Column, k: int = K) -> Column:
    """Estimate of the number of different shingles: exact below k."""
    largest = F.try_element_at(a, F.lit(-1)).cast("double") / float(1 << 64) + 0.5
    return F.when(F.size(a) < k, F.size(a).cast("double")).otherwise((k - 1) / largest)


def containment(a: Column, b: Column, k: int = K) -> Column:
    """Estimate of the share of a's shingles that b has; 1 for an empty a."""
    both = resemblance(a, b, k) * distinct_count(merge(a, b, k), k)
    return F.when(F.size(a) == 0, 1.0).otherwise(F.least(F.lit(1.0), F.try_divide(both, distinct_count(a, k))))


def merge_groups(sketches: DataFrame, key: str, column: str = "sketch", k: int = K) -> DataFrame:
    """``(key, sketch)`` of all rows of each key.

    Rows are cut to the k smallest hashes of a key before the shuffle and
    after it, so that a hot key sends k hashes from each task.
    """
    one = sketches.select(F.col(key), F.explode(column).alias("h")).distinct()
    low = one.withColumn("r", F.row_number().over(Window.partitionBy(key).orderBy("h"))).where(F.col("r") <= k)
    merged = low.groupBy(key).agg(F.sort_array(F.collect_list("h")).alias(column))
    keys = sketches.select(F.col(key).alias("__key")).distinct()
    none = F.array().cast("array<bigint>")
    return keys.join(merged, F.col("__key").eqNullSafe(F.col(key)), "left").select(F.col("__key").alias(key), F.coalesce(column, none).alias(column))


def as_text(a: Column) -> Column:
    """A sketch as a string: 16 hex digits for each hash."""
    return F.array_join(F.transform(a, lambda h: F.lpad(F.lower(F.hex(h)), 16, "0")), "")


def successors(ids: DataFrame, lowest: int, highest: int) -> DataFrame:
    """``ids(id)``, different numbers -> ``(id, next)``: the next larger one, null after the largest.

    Numbers that share all but their last bits are ordered together; the last
    of such a group gets the first of the next group, found in the same way.
    No task gets more than 2**FAR of them.
    """
    if highest - lowest < 1 << FAR:
        return ids.withColumn("next", F.lead("id").over(Window.orderBy("id")))
    grouped = ids.withColumn("g", F.shiftright("id", FAR))
    within = grouped.withColumn("n", F.lead("id").over(Window.partitionBy("g").orderBy("id")))
    first = grouped.groupBy("g").agg(F.min("id").alias("first"))
    after = successors(first.select(F.col("g").alias("id")), lowest >> FAR, highest >> FAR)
    start = after.select(F.col("id").alias("g"), F.col("next").alias("g2")).join(first.select(F.col("g").alias("g2"), "first"), "g2").select("g", "first")
    ends = within.where("n IS NULL").join(start, "g", "left").select("id", F.col("first").alias("next"))
    return within.where("n IS NOT NULL").select("id", F.col("n").alias("next")).unionByName(ends)


def with_next(docs: DataFrame) -> DataFrame:
    """``docs(doc_id, text)`` -> ``(doc_id, text, sketch, next_text, next_sketch)``.

    Next is the document with the next larger doc_id; after the largest comes
    the smallest. Rows that repeat a doc_id all get the next different one;
    of its rows the one with the smallest text. A null doc_id has no next.
    Rows of one doc_id stand in one window, which is read once and spills.
    Texts are shuffled once, in groups of neighbouring ids; only the last of
    each group looks at another group.
    """
    # A cast of a column that needs none would leave a renaming in one of the uses, and the shuffle would run again.
    doc_id = F.col("doc_id") if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long")
    rows = docs.select(doc_id, F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    rows = rows.withColumn("sketch", sketch(F.col("text")))
    span = rows.agg(F.min("doc_id").alias("a"), F.max("doc_id").alias("b")).head()
    none = rows.where("doc_id IS NULL").select("*", F.lit(None).cast("string").alias("next_text"), F.lit(None).cast("array<bigint>").alias("next_sketch"))
    if span["a"] is None:
        return none
    # All three uses of the groups have the same filters and columns below the shuffle, so that it runs once.
    near = rows.where("doc_id IS NOT NULL").withColumn("g", F.shiftright("doc_id", NEAR)).where("g IS NOT NULL")
    group = Window.partitionBy("g")
    # From the largest to the smallest: what stands before a row and is the smallest of its id comes next.
    back = group.orderBy(F.col("doc_id").desc(), F.col("text").desc())
    least = near.withColumns({"head": F.min("doc_id").over(group), "least": F.coalesce(F.lead("doc_id").over(back) != F.col("doc_id"), F.lit(True))})
    later = lambda c: F.last(F.when(F.col("least"), F.col(c)), ignorenulls=True).over(back.rowsBetween(Window.unboundedPreceding, -1))
    found = least.withColumns({"next_text": later("text"), "next_sketch": later("sketch")})
    within = found.where("next_text IS NOT NULL").select("doc_id", "text", "sketch", "next_text", "next_sketch")
    groups = rows.where("doc_id IS NOT NULL").select(F.shiftright("doc_id", NEAR).alias("id")).distinct()
    a, b = span["a"] >> NEAR, span["b"] >> NEAR
    after = successors(groups, a, b).select(F.coalesce("next", F.lit(a)).alias("g2"), F.col("id").alias("g"))
    heads = found.where("doc_id = head").groupBy("g").agg(F.min(F.struct("text", "sketch")).alias("h")).select(F.col("g").alias("g2"), F.col("h.text").alias("next_text"), F.col("h.sketch").alias("next_sketch"))
    ends = found.where("next_text IS NULL").select("g", "doc_id", "text", "sketch").join(after.join(heads, "g2"), "g")
    return within.unionByName(ends.select("doc_id", "text", "sketch", "next_text", "next_sketch")).unionByName(none)


def compare_edited(docs: DataFrame) -> DataFrame:
    """Fingerprints of each text and of its edited text, and their likeness.

    The edited text has the last floor(n/2) code points replaced by as many of
    the next document's first ones, or all. Null and empty texts have the
    empty fingerprint; two empty ones have likeness 1. A row with a null
    doc_id is only cut, and near_next is null.
    """
    paired = with_next(docs).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.substring(F.col("text"), F.lit(1), F.col("n_chars").cast("int") - half), F.substring(F.coalesce("next_text", F.lit("")), F.lit(1), half))
    out = let(edited, lambda e: F.struct(F.sha2(e.cast("binary"), 256).alias("sha"), sketch(e).alias("sketch")))
    return paired.withColumn("edited", out).select(
        "doc_id",
        "n_chars",
        F.col("edited.sha").alias("edited_sha256"),
        as_text(F.col("sketch")).alias("fingerprint"),
        as_text(F.col("edited.sketch")).alias("edited_fingerprint"),
        resemblance(F.col("sketch"), F.col("edited.sketch")).alias("near_edited"),
        F.when(F.col("next_sketch").isNotNull(), resemblance(F.col("sketch"), F.col("next_sketch"))).alias("near_next"),
        distinct_count(F.col("sketch")).alias("n_shingles"),
        let(merge(F.col("sketch"), F.col("edited.sketch")), lambda m: distinct_count(m)).alias("n_both"),
        containment(F.col("sketch"), F.col("edited.sketch")).alias("kept"),
    )


def op10(spark, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))
