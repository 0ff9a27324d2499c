"""SimHash near-dedup with meet-in-the-middle ball hashing.

A fingerprint has one or more tables of up to 64 bits. Two values that differ
in at most ``radius`` bits have a value within half the radius of both, so
each emits all variants within half the radius and equal variants meet in a
shuffle. All values that share a variant lie within the radius of each other:
a bucket has at most as many different values as a ball has members, and
linking its members to the smallest of them loses no connection. That takes
an even radius: with an odd one a bucket's members could lie one bit further
apart, so it is refused.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import cut, forget, free, release, scratch, session, table, with_number
from tessera.llm.components import connected_components
from tessera.llm.sketch import hashes, let, words
from tessera.operators.batches import number

#: Seed of the shingle hash.
SEED = 42
#: Words of 64 bits, a power of two, that tell sets of shingles apart before they are compared.
PARITIES = 8
#: Shingles hashed at once, so that a very long text needs bounded memory.
CHUNK = 1 << 15


def shingles(text: str | None, k: int) -> Iterator[bytes]:
    """k-word shingles of the text with A-Z lower-cased, repeats included.

    Words are separated by space and \\x09-\\x0D. With fewer than k words the
    whole sequence is the only shingle; without words there is none.
    """
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return
    joined, at = b" ".join(words), [0]
    for w in words:
        at.append(at[-1] + len(w) + 1)
    if len(words) <= k:
        yield joined
        return
    for i in range(len(words) - k + 1):
        yield joined[at[i] : at[i + k] - 1]


def further(h: np.ndarray, j: int) -> np.ndarray:
    """The j-th further 64 bits of each hash: the hash itself for j = 0, else it is mixed anew (splitmix64)."""
    if j == 0:
        return h
    z = h + np.uint64(j * 0x9E3779B97F4A7C15 & (1 << 64) - 1)
    z = (z ^ z >> np.uint64(30)) * np.uint64(0xBF58476D1CE4E5B9)
    z = (z ^ z >> np.uint64(27)) * np.uint64(0x94D049BB133111EB)
    return z ^ z >> np.uint64(31)


def fingerprint(text: str | None, k: int = 3, words64: int = 1, kinds: list[np.ndarray] | None = None) -> np.ndarray:
    """``words64`` unsigned 64-bit values; a bit is 1 if over half the hashes set it.

    Null, empty and white-space texts give zeros. With ``kinds`` each different
    shingle counts once, so that a line counts the same however often it is
    repeated; their hashes go there.
    """
    ones, n = np.zeros((words64, 64), np.int64), 0
    parts = hashed(text, k)
    if kinds is not None:
        known = [np.unique(h) for h in parts]
        kinds.append(np.unique(np.concatenate(known)) if known else np.zeros(0, np.uint64))
        parts = (kinds[-1][at : at + CHUNK] for at in range(0, len(kinds[-1]), CHUNK))
    for h in parts:
        n += len(h)
        for j in range(words64):
            ones[j] += np.unpackbits(further(h, j).astype(">u8").view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    bits = (2 * ones > n).astype(np.uint8)
    return np.packbits(bits, axis=1).view(">u8").astype(np.uint64).ravel()


def hashed(text: str | None, k: int) -> Iterator[np.ndarray]:
    """The hashes of a text's shingles, chunk by chunk."""
    source = shingles(text, k)
    while part := [s for _, s in zip(range(CHUNK), source)]:
        yield np.fromiter((xxhash.xxh64_intdigest(s, SEED) for s in part), np.uint64, len(part))


def fingerprints(docs: DataFrame, k: int = 3, bits: int = 64, tables: int = 1, sets: bool = False) -> DataFrame:
    """``(doc_id, t, f)``: f is an array of ``tables`` values of ``bits`` bits (64, or 56 at most), t a hash of the text.

    With ``sets`` the fingerprints are of the different shingles, and there is s: a hash of their set.
    """
    session(docs)
    words64 = -(-bits * tables // 64)
    weights = 1 << np.arange(bits - 1, -1, -1, dtype=np.int64)

    def run(batches):
        forget()
        for pdf in batches:
            values, kinds = [], []
            for t in pdf["text"]:
                parts: list[np.ndarray] | None = [] if sets else None
                values.append(split(fingerprint(t, k, words64, parts)))
                if parts is not None:
                    kinds.append(xxhash.xxh64_intdigest(parts[0].tobytes()) - (1 << 63))
            out = pd.DataFrame({"doc_id": pdf["doc_id"], "t": pdf["t"], "f": values})
            yield out.assign(s=kinds) if sets else out
        release()

    def split(f: np.ndarray) -> list[int]:
        if bits == 64:
            return f[:tables].view(np.int64).tolist()
        every = np.unpackbits(f.astype(">u8").view(np.uint8))[: bits * tables]
        return (every.reshape(tables, bits) @ weights).tolist()

    text = F.col("text").cast("string")
    named = docs.select(F.col("doc_id").cast("long").cast("string").alias("doc_id"), text.alias("text"), F.xxhash64(text).alias("t"))
    return with_number(named.mapInPandas(run, "doc_id string, t long, f array<long>" + (", s long" if sets else "")))


def ball(x: Column, bits: int, half: int) -> Column:
    """Array of all values within ``half`` bits of x."""
    out = F.array(x)
    for _ in range(half):
        one = lambda y: F.transform(F.sequence(F.lit(0), F.lit(bits - 1)), lambda i: y.bitwiseXOR(F.call_function("shiftleft", F.lit(1).cast("long"), i)))
        out = F.array_union(out, F.flatten(F.transform(out, one)))
    return out


def distinct_fingerprints(fps: DataFrame) -> DataFrame:
    """``(node, f, rep)``: each fingerprint (and set of shingles s) with its smallest doc_id and, with s, the hash t of that one's text.

    Nodes are numbers in the order of rep, then of s and f, so that rows that
    repeat a doc_id with different texts are nodes of their own; what has no
    doc_id has none.
    """
    if "s" in fps.columns:
        one = F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "t"))
        named, order = fps.groupBy("f", "s").agg(F.min(one).alias("least")).select("f", "s", F.col("least.doc_id").alias("rep"), "least.t"), ["rep", "s", "f"]
    else:
        named, order = fps.groupBy("f").agg(F.min("doc_id").alias("rep")), ["rep", "f"]
    placed = number(named, order, "node")
    return placed.withColumn("node", F.when(F.col("rep").isNotNull(), F.col("node")))


def buckets(distinct: DataFrame, bits: int = 64, radius: int = 2, similarity: float | None = None) -> tuple[DataFrame, DataFrame]:
    """``(t, hub, node)``: of table t the nodes with one value, and the smallest of them; ``(t, m)``: the hubs whose values share a variant.

    With ``similarity`` hubs that met by chance are left out: see :func:`near_by`.
    """
    if radius % 2:
        raise ValueError("the radius must be even: see the module's text")
    known = distinct.where("node IS NOT NULL")
    single = known.select("node", F.posexplode("f").alias("t", "x"))
    if similarity is None:
        hubs = single.groupBy("t", "x").agg(F.min("node").alias("hub"))
        spread = hubs.select("t", F.col("hub").alias("h"), F.explode(ball(F.col("x"), bits, radius // 2)).alias("v"))
    else:
        # A hub takes some bits of another table along, in the same number: see `near_by`.
        more = seal_bits(known.count())
        tables = F.size("f")
        sealed = known.select("node", F.posexplode("f").alias("t", "x"), "f").select("node", "t", "x", F.shiftrightunsigned(F.get("f", (F.col("t") + 1) % tables), max(0, bits - more)).alias("e"))
        low = F.min(F.struct("node", "e")).alias("low")
        hubs = sealed.groupBy("t", "x").agg(low, F.count(F.lit(1)).alias("n")).select("t", "x", F.col("low.node").alias("hub"), F.col("low.e").alias("e"), "n")
        h = F.shiftleft(F.col("hub"), more + 1) + F.shiftleft((F.col("n") > 1).cast("long"), more) + F.col("e")
        spread = hubs.select("t", h.alias("h"), F.explode(ball(F.col("x"), bits, radius // 2)).alias("v"))
    # A table's number goes into the bits above its values where there is room. Variants are dealt out as plain
    # rows: nearly all differ, and lists made before the shuffle would only be larger.
    keys = ["t", "v"] if bits == 64 else ["v"]
    if bits < 64:
        spread = spread.select((F.shiftleft(F.col("t").cast("long"), bits) + F.col("v")).alias("v"), "h")
    near = spread.repartition(*keys).groupBy(*keys).agg(F.collect_list("h").alias("m")).where(F.size("m") > 1)
    if similarity is not None:
        near = near.withColumn("m", near_by(F.col("m"), more, min(more, bits), similarity)).where(F.size("m") > 1)
    if bits < 64:
        near = near.withColumn("t", F.shiftright("v", bits).cast("int"))
    return single.join(hubs.select("t", "x", "hub"), ["t", "x"]).select("t", "hub", "node"), near.select("t", "m")


def seal_bits(n: int) -> int:
    """How many bits of another table a hub's number has room for, beside n nodes and a mark."""
    return max(1, min(28, 61 - max(n, 1).bit_length()))


def near_by(m: Column, more: int, bits: int, similarity: float) -> Column:
    """The hubs of a bucket without those that can be alike to no other one by the bits they took along.

    A value that only its hub has and whose bits differ from all others' in
    more than ``similarity`` allows met them by chance. A value of several
    nodes stays, as the bits are only its hub's. A bucket has at most as many
    hubs as a ball has members.
    """
    p = differing(similarity)
    most = math.ceil(bits * p + 3 * math.sqrt(bits * p * (1 - p)))
    seal, many = F.lit((1 << more) - 1), F.lit(1 << more)
    several = lambda x: x.bitwiseAND(many) != 0
    close = lambda x, y: (F.bit_count(x.bitwiseXOR(y).bitwiseAND(seal)) <= most) | several(x) | several(y)
    kept = F.filter(m, lambda x: F.exists(m, lambda y: (x != y) & close(x, y)))
    return F.transform(kept, lambda x: F.shiftright(x, more + 1))


def within(pairs: DataFrame, distinct: DataFrame, most: int) -> DataFrame:
    """The pairs ``(a, b)`` of nodes whose fingerprints differ in at most ``most`` bits."""
    differ = F.aggregate(F.zip_with("fa", "fb", lambda p, q: F.bit_count(p.bitwiseXOR(q)).cast("int")), F.lit(0), lambda s, d: s + d)
    first, second = (distinct.where("node IS NOT NULL").select(F.col("node").alias(n), F.col("f").alias(f"f{n}")) for n in ("a", "b"))
    return pairs.join(first, "a").join(second, "b").where(differ <= most).select("a", "b")


def spokes(near: DataFrame) -> DataFrame:
    """``(t, a, b)``: each bucket's smallest hub and its other ones."""
    return near.select("t", F.array_min("m").alias("a"), F.explode(F.array_remove("m", F.array_min("m"))).alias("b"))


def stars(members: DataFrame, near: DataFrame, one_table: bool = False) -> DataFrame:
    """The pairs ``(a, b)`` of each bucket's smallest node and its other ones."""
    found = spokes(near).select("a", "b")
    return (found if one_table else found.union(members.select(F.col("hub").alias("a"), F.col("node").alias("b")))).where("a <> b").distinct()


def links(distinct: DataFrame, bits: int = 64, radius: int = 2, most: int | None = None) -> DataFrame:
    """Verified links ``(a, b)`` between the nodes of different fingerprints.

    ``most``: over all tables the fingerprints may differ in so many bits
    (default: the radius). With one table the links connect all that lie
    within the radius of each other; with more, members of a bucket are held
    against the bucket's smallest member. Fingerprints of which no row has a
    doc_id are not linked.
    """
    most = radius if most is None else most
    return within(stars(*buckets(distinct, bits, radius), most <= radius), distinct, most)


def shingle_sets(docs: DataFrame, nodes: DataFrame, k: int) -> DataFrame:
    """``(a, s)``: the different hashes of the k-word shingles of the texts that stand for ``nodes(a, doc_id, t)``.

    Rows that repeat a doc_id and its text are one.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("t"), F.lower(F.coalesce(text, F.lit(""))).alias("text"))
    found = rows.join(nodes, ["doc_id", "t"])
    return cut(found.select("a", F.array_distinct(let(words(F.col("text")), lambda w: hashes(w, k))).alias("s")).dropDuplicates(["a"]))


def of_nodes(ids: DataFrame, distinct: DataFrame) -> DataFrame:
    """``(a, doc_id, t)``: which document and text stands for each node of ``ids(a)``."""
    return distinct.where("node IS NOT NULL").select(F.col("node").alias("a"), F.col("rep").alias("doc_id"), "t").join(ids.select("a"), "a", "left_semi")


def alike(pairs: DataFrame, docs: DataFrame, distinct: DataFrame, k: int, similarity: float) -> DataFrame:
    """The links ``(a, b)`` whose documents share at least ``similarity`` of their different k-word shingles.

    Only documents of some link are read as shingles; each link holds the two
    arrays of hashes once.
    """
    sets = shingle_sets(docs, of_nodes(pairs.select("a").union(pairs.select("b")).distinct(), distinct), k)
    both = pairs.join(sets.withColumnRenamed("s", "sa"), "a").join(sets.select(F.col("a").alias("b"), F.col("s").alias("sb")), "b")
    shared = F.size(F.array_intersect("sa", "sb"))
    return both.where(shared >= similarity * (F.size("sa") + F.size("sb") - shared)).select("a", "b")


def top_of(found: DataFrame) -> DataFrame:
    """``(node, top)`` of all ends of links: the smallest node that can be reached."""
    groups = connected_components(found)
    top = groups.groupBy("root").agg(F.min("node").alias("top"))
    return groups.join(top, "root").select("node", "top")


def unsettled(members: DataFrame, near: DataFrame, moved: DataFrame) -> DataFrame:
    """``(a, c)``: the nodes, with their components, of buckets that hold three or more of more than one component.

    Of three some were not held against each other. Buckets of a dense group
    overlap: a pair of hubs is in several, and a hub in as many as a ball has
    members. So a bucket's smallest hub is held against the others once for
    all buckets, and buckets then meet those that differ by their smallest.
    """
    known = cut(members.join(moved, "node", "left").select("t", "hub", "node", F.coalesce("top", "node").alias("c")))
    value = cut(known.groupBy("t", "hub").agg(F.count("*").alias("n"), F.min("c").alias("low"), F.max("c").alias("high")))
    first, second = (value.select("t", F.col("hub").alias(x), *[F.col(c).alias(c + x) for c in ("n", "low", "high")]) for x in ("a", "b"))
    pairs = spokes(near).distinct().join(first, ["t", "a"]).join(second, ["t", "b"])
    apart = cut(pairs.where("least(lowa, lowb) <> greatest(higha, highb)").select("t", "a", "b", (F.col("na") + F.col("nb")).alias("n")))
    # The hubs that differ from one lie within the radius of it, so a list holds few.
    lists = apart.groupBy("t", "a").agg(F.collect_list("b").alias("others"))
    mixed = near.where(F.size("m") > 2).withColumn("a", F.array_min("m")).join(lists, ["t", "a"]).where(F.arrays_overlap("m", "others"))
    # Buckets of two hubs are pairs themselves.
    two = apart.where("n > 2").select("t", F.explode(F.array("a", "b")).alias("hub"))
    at = mixed.select("t", F.explode("m").alias("hub")).union(two).union(value.where("n > 2 AND low <> high").select("t", "hub")).distinct()
    return known.join(at, ["t", "hub"], "left_semi").select(F.col("node").alias("a"), "c").distinct()


def parities(s: Column) -> Column:
    """64 x PARITIES bits of a set of hashes: whether an odd number of them falls on a bit.

    A hash that only one of two sets has turns one bit: sets differ in at
    least as many hashes as their bits do.
    """
    bit = lambda x: F.call_function("shiftleft", F.lit(1).cast("long"), x.bitwiseAND(F.lit(63)).cast("int"))
    of = lambda i: F.filter(s, lambda x: F.shiftright(x, 6).bitwiseAND(F.lit(PARITIES - 1)) == i)
    return F.struct(*[F.aggregate(of(i), F.lit(0).cast("long"), lambda z, x: z.bitwiseXOR(bit(x))).alias(f"z{i}") for i in range(PARITIES)])


def turned(z: str, y: str) -> Column:
    """In how many bits two of :func:`parities` differ."""
    return sum((F.bit_count(F.col(f"{z}.z{i}").bitwiseXOR(F.col(f"{y}.z{i}"))) for i in range(PARITIES)), F.lit(0))


def sharing(docs: DataFrame, ids: DataFrame, distinct: DataFrame, k: int, similarity: float) -> DataFrame:
    """Pairs ``(a, b)`` of ``ids(a, c)`` with different c: all that can be as alike, and few others.

    Shingles are ordered by how few documents have them. Of two sets that
    share ``s`` of their shingles and more, one of the first
    ``n - ceil(2s / (1 + s) n) + 1`` of the shorter's n is among the first
    ``n - ceil(s n) + 1`` of the longer's. What a large group has in common
    stands last and makes no pairs. What two sets share of these prefixes is
    counted: with it, what follows the last shared one in either must reach
    the number that they need to share. Before that, two sets whose parities
    differ in more bits than sets that share enough may differ in hashes are
    not paired: members of a large group that are nearly as alike, but not
    quite, all meet at the same few shingles.
    """
    sets = shingle_sets(docs, of_nodes(ids, distinct), k).join(ids, "a")
    each = sets.select("a", "c", F.size("s").alias("n"), F.explode("s").alias("w"))
    bits = sets.select("a", parities(F.col("s")).alias("z"))
    often = cut(each.groupBy("w").agg(F.count("*").alias("df")).where("df > 1"))
    # Of the shingles that only one document has the number is enough: they come first and meet none.
    listed = each.join(often, "w").groupBy("a", "c", "n").agg(F.sort_array(F.collect_list(F.struct("df", "w"))).alias("l"))
    first = lambda share: F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1 - (F.col("n") - F.size("l"))
    prefix = (
        listed.withColumns({"probe": first(similarity), "index": first(2 * similarity / (1 + similarity)), "own": F.col("n") - F.size("l")})
        .where("probe > 0")
        .select("a", "c", "n", "index", "own", F.posexplode(F.slice("l", F.lit(1), F.col("probe").cast("int"))).alias("p", "x"))
        .select("a", "c", "n", (F.col("p") < F.col("index")).alias("short"), F.col("x.w").alias("w"), (F.col("own") + F.col("p") + 1).alias("p"))
    )
    prefix = cut(prefix.join(bits, "a"))
    # Components meet before documents do: a shingle of one component alone makes no pairs, however many documents have it.
    ends = cut(prefix.groupBy("w", "c").agg(F.count_if("short").alias("short"), F.count(F.lit(1)).alias("long")))
    meet = cut(ends.where("short > 0").select("w", F.col("c").alias("cb"), "short").join(ends.select("w", F.col("c").alias("ca"), "long"), "w").where("ca <> cb"))
    shorter = prefix.where("short").select("w", F.col("c").alias("cb"), F.col("a").alias("b"), F.col("n").alias("nb"), F.col("p").alias("pb"), F.col("z").alias("zb"))
    longer = prefix.select("w", F.col("c").alias("ca"), "a", F.col("n").alias("na"), F.col("p").alias("pa"), F.col("z").alias("za"))
    enough = similarity / (1 + similarity) * (F.col("na") + F.col("nb")) - 1e-9
    follow = F.least(F.col("na") - F.col("pa"), F.col("nb") - F.col("pb"))
    # Up to a shared place no more can be shared than the shorter way to it holds.
    # The component with fewer documents comes first: a large one's are only there together with another's.
    one = meet.where("short <= long").drop("short", "long").join(shorter, ["w", "cb"]).join(longer, ["w", "ca"])
    two = meet.where("short > long").drop("short", "long").join(longer, ["w", "ca"]).join(shorter, ["w", "cb"])
    pairs = one.unionByName(two)
    pairs = pairs.where((F.col("nb") <= F.col("na")) & (F.col("nb") >= similarity * F.col("na") - 1e-9) & (F.least("pa", "pb") + follow >= enough) & (turned("za", "zb") <= F.col("na") + F.col("nb") - 2 * enough))
    # All that both prefixes share has been met: what was counted is all up to the last of it. The shorter one's prefix
    # is cut where `short` ends, so what is shared behind that counts as what may follow.
    counted = pairs.groupBy("a", "b", "na", "nb").agg(F.count(F.lit(1)).alias("n"), F.max("pa").alias("pa"), F.max("pb").alias("pb"))
    return counted.where(F.col("n") + follow >= enough).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def alike_links(docs: DataFrame, distinct: DataFrame, bits: int, radius: int, most: int, k: int, similarity: float) -> DataFrame:
    """``(node, top)``: components of links between nodes of one bucket of any table.

    Links differ in at most ``most`` bits and hold by the shingles. First the
    members of a bucket are held against its smallest. That settles large
    groups of copies; members that are alike to each other but not to the
    smallest are then found by the rare shingles that they share.
    """
    spark = docs.sparkSession
    members, near = buckets(distinct, bits, radius, similarity)
    members, near = cut(members), cut(near.select("t", F.array_sort("m").alias("m")).distinct())
    with scratch(spark):
        found = cut(alike(cut(within(stars(members, near), distinct, most)), docs, distinct, k, similarity), outside=True)
    with scratch(spark):
        moved = cut(top_of(found), outside=True)
    with scratch(spark):
        left = cut(unsettled(members, near, moved), outside=True)
    if left.isEmpty():
        return moved
    with scratch(spark):
        more = cut(alike(cut(within(sharing(docs, left, distinct, k, similarity), distinct, most)), docs, distinct, k, similarity), outside=True)
    return moved if more.isEmpty() else top_of(found.union(more))


def near_rows(docs: DataFrame, k: int = 3, bits: int = 64, tables: int = 1, radius: int = 2, most: int | None = None, similarity: float | None = None) -> DataFrame:
    """``(doc_id, t, f, component_id)`` for every row of ``docs``, t being a hash of its text: see :func:`near_groups`."""
    with scratch(docs.sparkSession):
        fps = cut(fingerprints(docs, k, bits, tables, sets=similarity is not None), outside=True)
        distinct = cut(distinct_fingerprints(fps))
        moved = top_of(links(distinct, bits, radius, most)) if similarity is None else alike_links(docs, distinct, bits, radius, radius if most is None else most, k, similarity)
        key = [c for c in ("f", "s") if c in distinct.columns]
        # Nodes are in the order of their smallest doc_id, so the smallest node has the component's.
        first = distinct.select(F.col("node").alias("top"), F.col("rep").alias("component_id"))
        by_f = cut(distinct.join(moved, "node", "left").withColumn("top", F.coalesce("top", "node")).join(first, "top", "left").select(*key, "component_id"), outside=True)
    return fps.join(by_f, key).select("doc_id", "t", "f", "component_id")


def near_groups(docs: DataFrame, **how) -> DataFrame:
    """``(doc_id, f, component_id)`` for every row of ``docs(doc_id, text)``.

    Parameters are those of :func:`near_rows`. component_id is the smallest
    doc_id that can be reached over links, the row's own included. Rows
    without words (null, empty, white space) have fingerprint zero and are
    linked like any other. Repeated rows and ties are kept, one result row
    each. Rows that repeat a doc_id with another text are documents of their
    own, linked by their own texts. Rows with a null doc_id are kept, get the
    component of equal fingerprints, else null, and don't count for it. Other
    columns are ignored; an empty table gives an empty result. Very long texts
    are hashed in chunks. With ``similarity`` links must also hold by the
    shingles: see :func:`alike`; equal fingerprints of different sets of
    shingles are linked only so.
    """
    return near_rows(docs, **how).select("doc_id", "f", "component_id")


#: The near-dedup stage of a pipeline: five-word shingles and similarity 0.8, of which a bucket of some table catches
#: RECALL at least; tables have LEAST bits, more where random values would meet too often.
NEAR = {"k": 5, "radius": 2, "similarity": 0.8}
RECALL, LEAST, ROOM = 0.9, 28, 6


def differing(similarity: float) -> float:
    """The chance that a bit differs for texts of equal length that share so many of their shingles."""
    return math.acos(min(1.0, 2 * similarity / (1 + similarity))) / math.pi


@lru_cache
def widths(n: int, similarity: float, radius: int) -> dict[str, int]:
    """Bits of a table, number of tables and most different bits for n documents.

    Texts of equal length that share ``similarity`` of their shingles have an
    angle whose share of a half turn is the chance that a bit differs. Two
    values of b bits are within the radius with the binomial's probability; so
    many tables are taken that one of them has the pair with RECALL. Bits grow
    with the logarithm of n, so that a value meets few strangers at any size.
    """
    bits = min(56, max(LEAST, math.ceil(math.log2(max(n, 1))) + ROOM))
    p = differing(similarity)
    meet = sum(math.comb(bits, i) * p**i * (1 - p) ** (bits - i) for i in range(radius + 1))
    tables = math.ceil(math.log(1 - RECALL) / math.log(1 - meet)) if meet < 1 else 1
    total = bits * tables
    return {"bits": bits, "tables": tables, "most": max(radius, math.ceil(total * p + 4 * math.sqrt(total * p * (1 - p))))}


def near_dedup(docs: DataFrame, **how) -> DataFrame:
    """One document of each group stays: the one with the smallest doc_id.

    Documents without any word and those with a null doc_id stay. Of several
    rows with the kept doc_id and text all stay; a row that repeats a doc_id
    with another text goes or stays by its own text. Columns are those of
    ``docs``.
    """
    how = NEAR | how
    how = widths(docs.count(), how["similarity"], how["radius"]) | how
    one, two = free(docs, "gone", "hash")
    with scratch(docs.sparkSession):
        found = near_rows(docs, **how).where("doc_id <> component_id")
        gone = cut(found.select(F.col("doc_id").alias(one), F.col("t").alias(two)).distinct(), outside=True)
    text = F.col("text").cast("string")
    wordless = F.length(F.regexp_replace(F.coalesce(text, F.lit("")), r"[\x20\x09-\x0D]+", "")) == 0
    return docs.join(gone, (F.col("doc_id") == F.col(one)) & (F.xxhash64(text) == F.col(two)) & ~wordless, "left_anti").select(*docs.columns)


def op1(spark, sf_dir: str) -> DataFrame:
    found = near_groups(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex(F.col("f")[0])), 16, "0").alias("fingerprint"), "component_id")
