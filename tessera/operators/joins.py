"""Similarity joins: all pairs of bags that share enough, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.sources.shared import cut, scratch

#: Bags of this many tokens and fewer meet by two tokens, larger ones by one: two tell more, but make a row for each two.
SMALL = 16
#: Larger bags are dealt into parts: bags of PART * DEAL ** j tokens and more into DEAL ** j, so of PART tokens at least.
PART, DEAL = 12, 8
#: Tokens are counted in this many numbers, whatever the table's size, which are added up in pieces: a byte for each goes
#: through the driver to the tasks.
COUNTERS, PIECES = 1 << 20, 256
#: Words that a task in Python looks at together, bags of small groups that one task compares, and of a large group's block.
TOGETHER, FEW, GROUP = 1 << 20, 256, 2048
#: A product that is whole but for rounding.
ROUNDING = 1e-9


@dataclass(frozen=True)
class Similar:
    """``members(key, rep)``: the class of equal bags that a row is in, named by its smallest key;
    ``pairs(left, right, similarity)`` of classes, left < right."""

    members: DataFrame
    pairs: DataFrame


def mixed(h: np.ndarray) -> np.ndarray:
    """Each 64-bit number's own other one, with all bits mixed."""
    h = h.astype(np.uint64)
    for shift, times in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        h = (h ^ (h >> np.uint64(shift))) * np.uint64(times)
    return h ^ (h >> np.uint64(31))


def numbered(bags: np.ndarray, words: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bags and words in order, and each word's number among the equal ones of its bag."""
    order = np.lexsort((words, bags))
    bags, words = bags[order], words[order]
    new = np.flatnonzero(np.r_[True, (bags[1:] != bags[:-1]) | (words[1:] != words[:-1])][: len(bags)])
    return bags, words, np.arange(len(bags)) - np.repeat(new, np.diff(np.r_[new, len(bags)]))


def tokens(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``reps``, and by bag ``(bag, token)``, of batches ``(rep, words)``, whose words are hashes; few bags at once.

    A token is a word with its number among the equal ones of its bag: bags
    become sets that share as much.
    """
    for batch in batches:
        reps, lists = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1)
        ends = lists.offsets.to_numpy()
        first = 0
        while first < len(reps):
            last = max(first + 1, int(np.searchsorted(ends, ends[first] + TOGETHER, "right")) - 1)
            words = lists.values.slice(ends[first], ends[last] - ends[first]).to_numpy()
            bags, words, k = numbered(np.repeat(np.arange(last - first), np.diff(ends[first : last + 1])), words)
            yield reps[first:last], bags, mixed(words.view(np.uint64) + k.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
            first = last


def by_frequency(bags: DataFrame) -> np.ndarray:
    """How many of ``bags(rep, words)`` have a token, as a byte for each of ``COUNTERS`` numbers; 0 where one has at most.

    Tokens that share a counter are counted together, and larger counts are
    eighths of a power of two: that changes which tokens come first, for all
    bags alike, and no result. Each task counts on its own; what comes to the
    driver and goes to the tasks is as much for any table.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(COUNTERS, np.uint32)
        for _, _, token in tokens(batches):
            np.add.at(n, (token % np.uint64(COUNTERS)).astype(np.int64), np.uint32(1))
        if n.any():
            yield pa.RecordBatch.from_arrays([pa.array(range(PIECES), pa.int32()), pa.array([x.tobytes() for x in np.split(n, PIECES)], pa.binary())], ["piece", "n"])

    def add(pdf: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(COUNTERS // PIECES, np.int64)
        for x in pdf["n"]:
            n += np.frombuffer(x, np.uint32)
        level = np.minimum(np.ceil(8 * np.log2(np.maximum(n, 1))), 255).astype(np.uint8)
        return pd.DataFrame({"piece": pdf["piece"].iloc[:1], "level": [level.tobytes()]})

    found = bags.mapInArrow(count, "piece int, n binary").groupBy("piece").applyInPandas(add, "piece int, level binary").collect()
    levels = np.zeros((PIECES, COUNTERS // PIECES), np.uint8)
    for r in found:
        levels[r["piece"]] = np.frombuffer(r["level"], np.uint8)
    return levels.ravel()


def meetings(bags: DataFrame, levels: np.ndarray, least: float) -> DataFrame:
    """``(at, rep, m, bits)``: where bags meet that share enough, with the size and the parities of what meets there.

    ``bits`` has for each of 64 kinds of tokens whether their number is odd.
    Two sets differ in as many tokens at least as these differ in bits.
    """

    def kept(n: np.ndarray, shared: int) -> np.ndarray:
        """How many of the rarest of n tokens hold ``shared`` of those that a similar bag has too."""
        return np.minimum(n, n - np.ceil(n * least - ROUNDING).astype(np.int64) + shared)

    def part(reps: np.ndarray, sub: np.ndarray, token: np.ndarray, salt: int, two: bool, share: int) -> Iterator[pa.RecordBatch]:
        """The meetings of sets ``(sub, token)``; ``share`` of them are one bag's."""
        if not len(sub):
            return
        level = levels[(token % np.uint64(COUNTERS)).astype(np.int64)]
        order = np.lexsort((token, level, sub))
        sub, token, level = sub[order], token[order], level[order]
        starts = np.flatnonzero(np.r_[True, sub[1:] != sub[:-1]])
        n = np.diff(np.r_[starts, len(sub)])
        bits = np.bitwise_xor.reduceat(np.uint64(1) << (token >> np.uint64(58)), starts)
        mine = np.repeat(np.arange(len(starts)), n)
        place = np.arange(len(sub)) - starts[mine]
        # A token that no other bag has meets nothing.
        use = (place < kept(n, 2 if two else 1)[mine]) & (level > 0)
        at, mine, place = mixed(token + np.uint64(salt)), mine[use], place[use]
        if two:
            own = np.flatnonzero(use)
            chosen = [np.flatnonzero((mine[:-i] == mine[i:])) for i in range(1, min(SMALL, len(mine)))]
            firsts, seconds = np.concatenate([[], *chosen]).astype(np.int64), np.concatenate([[], *(c + i + 1 for i, c in enumerate(chosen))]).astype(np.int64)
            at, mine = mixed(at[own[firsts]] + mixed(at[own[seconds]] + np.uint64(1))), mine[firsts]
        else:
            at = at[use]
        yield pa.RecordBatch.from_arrays([pa.array(at.view(np.int64)), pa.array(reps[sub[starts[mine]] // share]), pa.array(n[mine].astype(np.int32)), pa.array(bits[mine].view(np.int64))], ["at", "rep", "m", "bits"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for reps, bag, token in tokens(batches):
            n = np.bincount(bag, minlength=len(reps))
            small = (n >= 2) & (n <= SMALL)
            pick = small[bag]
            yield from part(reps, bag[pick], token[pick], 1, True, 1)
            j, longest = 0, int(n.max(initial=0))
            while not j or PART * DEAL**j * least <= longest:
                # Two bags meet among those of the larger one's size, so the smaller one is there too.
                lower, upper = (PART * DEAL**j, SMALL + 1)[not j], PART * DEAL ** (j + 1)
                pick = ((n >= np.ceil(lower * least - ROUNDING)) & (n < upper))[bag]
                share = DEAL**j
                sub = bag[pick] * share + ((token[pick] >> np.uint64(20)) % np.uint64(share)).astype(np.int64)
                yield from part(reps, sub, token[pick], 2 + j, False, share)
                j += 1

    return bags.mapInArrow(run, "at long, rep long, m int, bits long")


def shares(pairs: pd.DataFrame, texts: pd.DataFrame, least: float) -> pd.DataFrame:
    """``(a, b, similarity)`` of ``pairs(a, b)`` whose ``texts(id, text)`` share ``least`` and more of their words."""
    codes: dict[str, int] = {}
    bags = []
    for t in texts["text"]:
        bags.append(np.unique(np.array([codes.setdefault(w, len(codes)) for w in t.split(" ") if w], np.int32), return_counts=True))
    places = pd.Series(np.arange(len(bags)), texts["id"].to_numpy())
    pairs = pairs.sort_values(["a", "b"])
    a, b = places[pairs["a"]].to_numpy(), places[pairs["b"]].to_numpy()
    both, n = np.zeros(len(pairs), np.int64), np.array([c.sum() for _, c in bags])
    has = np.zeros(len(codes), np.int64)
    edges = np.flatnonzero(np.r_[True, a[1:] != a[:-1], True])
    for first, last in zip(edges[:-1], edges[1:], strict=True):
        words, counts = bags[a[first]]
        has[words] = counts
        for i in range(first, last):
            both[i] = np.minimum(has[bags[b[i]][0]], bags[b[i]][1]).sum()
        has[words] = 0
    similarity = both / (n[a] + n[b] - both)
    return pairs.assign(similarity=similarity)[similarity >= least][["a", "b", "similarity"]]


def verified(met: DataFrame, bags: DataFrame, least: float) -> DataFrame:
    """``(a, b, similarity)`` of the pairs ``met(a, b)`` of ``bags(id, text)`` that share enough.

    Bags that meet each other go to one group, which is named by the smallest
    bag that a pair's smaller one meets: a text is sent once for all of its
    pairs there, not once for each. Large groups are dealt into blocks.
    """
    roots = met.groupBy("b").agg(F.min("a").alias("root"))
    grouped = cut(met.join(roots.withColumnRenamed("b", "a"), "a", "left").select("a", "b", F.coalesce("root", "a").alias("group")))
    sizes = grouped.groupBy("group").agg(F.ceil((F.countDistinct("b") + 1) / GROUP).alias("blocks"))
    few = max(1, grouped.select("b").distinct().count() // FEW)
    one = F.col("blocks") == 1
    block = lambda c: F.when(one, 0).otherwise(F.pmod(F.xxhash64(c), "blocks")).cast("long")
    # Many small groups are one; large ones keep their own number, below zero.
    dealt = cut(grouped.join(sizes, "group").select("a", "b", F.when(one, F.pmod(F.xxhash64("group"), F.lit(few))).otherwise(-1 - F.col("group")).alias("g"), block("a").alias("x"), block("b").alias("y")))
    wanted = dealt.select("g", "x", "y", F.explode(F.array("a", "b")).alias("id")).distinct()
    sent = wanted.join(bags, "id").toDF("id", "to_g", "to_x", "to_y", "text")
    return dealt.groupBy("g", "x", "y").cogroup(sent.groupBy("to_g", "to_x", "to_y")).applyInPandas(lambda p, t: shares(p[["a", "b"]], t, least), "a long, b long, similarity double")


def words_of(text: str) -> Column:
    return F.filter(F.split(F.col(text).cast("string"), " "), lambda w: w != "")


def bag_join(rows: DataFrame, key: str, text: str, least: float = 0.8) -> Similar:
    """Classes of rows with equal bags of words, and all pairs of classes whose bags share ``least`` and more of all words.

    Repeats count, as in ``skeleton.bag_jaccard``. Bags are dealt into parts by
    their tokens' hashes, more of them for larger bags. If two bags share
    ``least``, then so do their halves of one part at least, as the shares of
    the parts have the whole one between them. Two sets that share enough have
    one token in common among the rarest of both, if only as many of the common
    ones are left out as they need not share: there the two meet. Small bags
    aren't dealt and meet at two of these. That asks for ``least`` over one
    half. Meetings are held back by the parts' sizes and by 64 parities of
    them, which two parts that share enough have nearly all alike, so that few
    other pairs are left to compare. Pairs are compared by their words, each
    text in one group with most of those that it meets. A token that
    most bags have is among the rarest of a bag only if nearly all of that bag
    is as frequent, so it makes no pairs by itself.

    Texts are written once and shuffled as they are; what is made of them for
    the meetings is a row for about every fourth word. Tokens are 64-bit hashes
    there.

    A null or blank text has no words and no class; rows that repeat a key and
    a text are one member, a key with several texts is in several classes;
    other columns are ignored.
    """
    if not 0.5 < least <= 1:
        raise ValueError(f"a similarity over 0.5 and up to 1 is needed, not {least}")
    with scratch(rows.sparkSession):
        texts = rows.select(F.col(key).alias("key"), F.col(text).cast("string").alias("text"))
        named = texts.withColumn("words", words_of("text")).where(F.size("words") > 0)
        named = cut(named.select("key", F.xxhash64("text").alias("hash"), F.unhex(F.sha2(F.array_join(F.array_sort("words"), " "), 256)).alias("sha")).distinct())
        # A class is known by a number, as a key with several texts may stand for several classes: hashes would be most of
        # what is shuffled.
        first = F.min(F.when(F.col("key").isNotNull(), F.struct("key", "hash")))
        classes = cut(named.groupBy("sha").agg(first.alias("first")).select("sha", "first.*").withColumnRenamed("key", "rep").withColumn("id", F.monotonically_increasing_id()))
        members = cut(named.select("key", "sha").join(classes.select("sha", "rep"), "sha").select("key", "rep", "sha").distinct(), outside=True)
        firsts = classes.where("rep IS NOT NULL").select(F.col("rep").alias("key"), "hash", "id")
        # Copies go before the join, by the same columns: texts are shuffled once.
        single = texts.where("text IS NOT NULL").withColumn("hash", F.xxhash64("text")).dropDuplicates(["key", "hash"])
        bags = cut(single.join(firsts, ["key", "hash"]).select("id", "text"))

        hashed = bags.select(F.col("id").alias("rep"), F.transform(words_of("text"), lambda w: F.xxhash64(w)).alias("words"))
        rarest = meetings(hashed, by_frequency(hashed), least)
        a, b = (rarest.select("at", *(F.col(c).alias(f"{s}_{c}") for c in ("rep", "m", "bits"))) for s in "ab")
        smaller, larger = F.least("a_m", "b_m"), F.greatest("a_m", "b_m")
        apart = F.floor((F.col("a_m") + F.col("b_m")) * ((1 - least) / (1 + least)) + ROUNDING)
        alike = (smaller >= F.ceil(larger * least - ROUNDING)) & (F.bit_count(F.col("a_bits").bitwiseXOR(F.col("b_bits"))) <= apart)
        # Many rows are made of each bag, which Spark's estimate doesn't see: they must not go through the driver.
        met = a.join(b.hint("merge"), "at").where((F.col("a_rep") < F.col("b_rep")) & alike)
        held = verified(cut(met.select(F.col("a_rep").alias("a"), F.col("b_rep").alias("b")).distinct()), bags, least)
        keys = classes.select(F.col("id").alias("a"), F.col("rep").alias("x")), classes.select(F.col("id").alias("b"), F.col("rep").alias("y"))
        pairs = held.join(keys[0], "a").join(keys[1], "b")
        pairs = cut(pairs.select(F.least("x", "y").alias("left"), F.greatest("x", "y").alias("right"), "similarity"), outside=True)
    return Similar(members.select("key", "rep"), pairs)


def linked(similar: Similar) -> DataFrame:
    """``(key, rep, links)``: each row's class and with how many other classes it is similar."""
    ends = similar.pairs.select(F.explode(F.array("left", "right")).alias("rep")).groupBy("rep").agg(F.count(F.lit(1)).alias("links"))
    return similar.members.join(ends, "rep", "left").select("key", "rep", F.coalesce("links", F.lit(0)).alias("links"))
