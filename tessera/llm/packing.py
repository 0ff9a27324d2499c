"""Best-fit packing of tokenised documents by hierarchical residual packing.

Each partition packs its pieces best-fit, longest first, and emits the bins
that are nearly full. Underfull bins that can still be joined are items of the
next round, in fewer partitions, until one partition has packed them all. Two
bins over half of a sequence never fit together, and a task leaves at most one
that is not over half; so these go on, with as many of the emptiest others. A
task holds ITEMS lengths on average at any size of the input, and a round has
about 2 / ITEMS of the items before it.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from functools import lru_cache

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import Memory, cut, id_and_text, session, table, with_number

#: Tokens of a sequence, and the id that ends each document.
CAPACITY, END = 4096, 1
#: A bin that lacks at most so many tokens is nearly full.
SLACK = 8
#: Pieces or bins that one task packs, on average.
ITEMS = 50_000
#: Parts whose ids are remembered (twice as many at most), and the longest such part.
REMEMBERED, LONGEST = 500_000, 64
#: Characters of texts whose new parts are tokenised together.
TOGETHER = 1 << 20
#: str.split() parts at these, too, which the tokenizer's pattern doesn't.
ODD = regex.compile("[\x1c-\x1f]")
# Letters and numbers of Latin-1.
LETTERS, NUMBERS = "a-zA-Z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe"
#: The tokenizer's own splitting, for texts of Latin-1 only.
PARTS = re.compile(f"'(?:[stmd]|re|ve|ll)|[{LETTERS}]+|[{NUMBERS}]|[^\t-\r \x85\xa0{LETTERS}{NUMBERS}]+")


def apart(text: str) -> list[str] | None:
    """Parts that are tokenised each for itself: what the tokenizer would split, in lower case; words, if the
    text has other letters than those of Latin-1; None if it must be tokenised as a whole."""
    if ODD.search(text):
        return None
    try:
        text.encode("latin-1")
    except UnicodeEncodeError:
        return text.split()
    return PARTS.findall(text.lower())


class WordTokenizer:
    """Ids by the tokenizers library, remembered for each part of a text.

    The tokenizer drops white space, and no token crosses it or the places
    where the tokenizer splits, so a text's ids are those of its parts, one
    after the other. Ids are held as bytes.
    """

    def __init__(self, path: str):
        # Spark's tasks are the parallel part; must be set before the library is loaded.
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.own = Tokenizer.from_file(path)
        #: A text that holds one of the added tokens is tokenised as a whole: they are found before it is split.
        self.added = [t.content.lower() for t in self.own.get_added_tokens_decoder().values()]
        self.known = Memory(REMEMBERED)
        #: Which tokens end a part that the tokenizer has split off.
        self.ends = np.zeros(self.own.get_vocab_size(with_added_tokens=True), bool)
        self.ends[[i for t, i in self.own.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all([text])[0]

    def encode_all(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; what isn't remembered is tokenised at once for some texts together."""
        out: list[np.ndarray] = []
        some: list[list[str] | None] = []
        at, start = 0, 0
        for k, text in enumerate(texts):
            low = text.lower()
            some.append(None if any(t in low for t in self.added) else apart(text))
            at += len(text)
            if at >= TOGETHER or k == len(texts) - 1:
                out += self.encode_some(texts[start : k + 1], some)
                some, at, start = [], 0, k + 1
        return out

    def encode_some(self, texts: list[str], parts: list[list[str] | None]) -> list[np.ndarray]:
        recent, older = self.known.recent, self.known.older
        find = recent.get
        found = [None if p is None else list(map(find, p)) for p in parts]
        new: dict[str, bytes | None] = {}
        for p, f in zip(parts, found, strict=True):
            if f and None in f:
                new.update([x for x in zip(p, f, strict=True) if x[1] is None])
        unknown = []
        for x in new:
            ids = older.get(x)
            if ids is None:
                unknown.append(x)
            else:
                new[x] = recent[x] = ids
        for x, ids in zip(unknown, self.encode_words(unknown), strict=True):
            new[x] = ids
            if len(x) <= LONGEST:
                recent[x] = ids
        self.known.turn()
        out = []
        for text, p, f in zip(texts, parts, found, strict=True):
            if p is None:
                out.append(np.array(self.own.encode(text, add_special_tokens=False).ids, "<u4"))
                continue
            if None in f:
                f = [new[x] if ids is None else ids for x, ids in zip(p, f, strict=True)]
            out.append(np.frombuffer(b"".join(f), "<u4"))
        return out

    def encode_words(self, words: list[str]) -> list[bytes]:
        """Ids of each word; all are tokenised at once and parted where words end, or else by their places."""
        joined = " ".join(words)
        ids = np.array(self.own.encode_batch_fast([joined], add_special_tokens=False)[0].ids, "<u4")
        border = np.flatnonzero(self.ends[ids]) + 1
        if len(border) != len(words):
            got = self.own.encode(joined, add_special_tokens=False)
            starts = np.fromiter((a for a, _ in got.offsets), np.int64, len(ids))
            border = np.searchsorted(starts, np.cumsum([len(w) + 1 for w in words]))
        raw, places = ids.tobytes(), (4 * border).tolist()
        return [raw[a:b] for a, b in zip([0, *places], places, strict=False)]


@lru_cache(maxsize=2)
def tokenizer(path: str) -> WordTokenizer:
    return WordTokenizer(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def pieces(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, end: int = END) -> DataFrame:
    """``(doc_id, piece, start, length, ids_crc32)`` of every document, cut only where it is longer than a sequence.

    A null or empty text is the end id alone. Each row is a document of its
    own, repeated rows too; a null doc_id stays null; other columns are
    ignored; a very long text gives as many pieces as it needs; an empty table
    gives an empty result.
    """
    session(docs)
    path = path or default_path()

    def run(batches):
        coder = tokenizer(path)
        for pdf in batches:
            rows = []
            for d, found in zip(pdf["doc_id"], coder.encode_all([t or "" for t in pdf["text"]]), strict=True):
                ids = np.append(found, np.array([end], "<u4"))
                rows += [(d, k, at, len(part := ids[at : at + capacity]), zlib.crc32(part.tobytes())) for k, at in enumerate(range(0, len(ids), capacity))]
            out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
            yield out

    return with_number(id_and_text(docs).mapInPandas(run, "doc_id string, piece int, start long, length long, ids_crc32 long"))


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, list[int]]:
    """Bin and offset of each item, longest first into the fullest bin that takes it; and what each bin holds."""
    bins, offsets, used = np.empty(len(lengths), np.int64), np.empty(len(lengths), np.int64), []
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    rooms: list[int] = []  # sorted rooms for which there are bins
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        at = bisect_left(rooms, n)
        if at == len(rooms):
            b = len(used)
            used.append(0)
        else:
            room = rooms[at]
            b = by_room[room].pop()
            if not by_room[room]:
                rooms.pop(at)
        bins[i], offsets[i] = b, used[b]
        used[b] += n
        room = capacity - used[b]
        if room:
            if not by_room[room]:
                insort(rooms, room)
            by_room[room].append(b)
    return bins, offsets, used


def pack_round(items: DataFrame, number: int, capacity: int, slack: int) -> DataFrame:
    """``items(item, length)`` -> ``(item, bin, shift, used, full)`` in the partitions at hand.

    ``bin`` numbers hold the round and the partition, so that they differ from
    all others.
    """

    def run(batches):
        from pyspark import TaskContext

        parts = [pdf[["item", "length"]] for pdf in batches]
        if not parts:
            return
        pdf = pd.concat(parts, ignore_index=True).sort_values("item", ignore_index=True)
        b, at, used = best_fit(pdf["length"].to_numpy(), capacity)
        held = np.array(used, np.int64)[b]
        first = (number << 58) + (TaskContext.get().partitionId() << 32)
        yield pd.DataFrame({"item": pdf["item"], "bin": first + b, "shift": at, "used": held, "full": held >= capacity - slack})

    return items.mapInPandas(run, "item long, bin long, shift long, used long, full boolean")


def pack(pieces_: DataFrame, capacity: int = CAPACITY, slack: int = SLACK, each: int = ITEMS) -> DataFrame:
    """Adds ``sequence_id`` and ``offset`` to ``pieces_(..., length)``.

    Lengths are from 1 to ``capacity``. Sequences have no gaps; every row gets
    one place. An empty table gives an empty result.
    """
    numbered = cut(pieces_.withColumn("item", F.monotonically_increasing_id()))
    left, n, number = numbered.select("item", "length"), numbered.count(), 0
    placed = None
    while True:
        tasks = max(1, -(-n // each))
        packed = cut(pack_round(left.repartition(tasks, F.xxhash64("item", F.lit(number))), number, capacity, slack))
        step = packed.select("item", "bin", "shift", "used", "full")
        if placed is None:
            placed = step.select("item", F.col("bin").alias("sequence_id"), F.col("shift").alias("offset"))
        else:
            moved = step.select(F.col("item").alias("sequence_id"), "bin", "shift")
            placed = cut(
                placed.join(moved, "sequence_id", "left").select("item", F.coalesce("bin", "sequence_id").alias("sequence_id"), (F.col("offset") + F.coalesce("shift", F.lit(0))).alias("offset"))
            )
        if tasks == 1:
            break
        under = step.where(~F.col("full")).groupBy("bin").agg(F.first("used").alias("length")).select(F.col("bin").alias("item"), "length")
        small = cut(under.where(F.col("length") * 2 <= capacity))
        n = small.count()
        if not n:
            break
        # A small bin takes up one of the others at most, and the emptiest have room for whatever fits anywhere.
        left = cut(small.union(under.where(F.col("length") * 2 > capacity).orderBy("length", "item").limit(n)))
        n, number = left.count(), number + 1
    return numbered.join(placed, "item").drop("item")


def pack_documents(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY) -> DataFrame:
    """Pieces of all documents with their places: see :func:`pieces` and :func:`pack`."""
    return pack(pieces(docs, path, capacity), capacity)


def op8(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
