"""Suffix-array dedup: removes what a document shares with one of a smaller id.

Every byte that is covered by a string of LENGTH bytes which also starts in a
document with a smaller doc_id goes. Equal strings must meet somewhere without
all places of the corpus being sorted together, so:

1. Each window of LENGTH bytes is named by the smallest hash of its k-grams;
   neighbouring windows mostly share their name, so a run of them counts once.
   Equal windows have equal names. Names that only one document has are done.
2. The runs under the other names, with the bytes they span, are dealt out by
   name; equal ones are one run with the smallest of its documents' ids.
3. Per share of names, a suffix array and its Burrows-Wheeler transform are
   built. Breadth-first backward extension of intervals gives the common
   prefixes of neighbouring suffixes by increasing value and stops at LENGTH:
   borders that aren't found by then part nothing within LENGTH bytes. That
   groups equal windows; each group has its smallest doc_id.
4. Documents get back, for their runs, which windows are older elsewhere.

Texts are shuffled once, compressed; names and runs travel as packed arrays.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.llm.common import buckets_for, cut, forget, free, scratch, session, table, total_bytes

#: Bytes of a repeated string; a name's k-gram has GRAM of them.
LENGTH, GRAM = 50, 20
#: Bits of a name. Different k-grams with one name only cost work.
NAME = (1 << 48) - 1
#: Text bytes of a group of documents, and of a share of names; what one suffix array takes.
GROUP, SHARE, ARRAY = 4 << 20, 8 << 20, 1 << 19
#: Windows of a text that are named at once.
CHUNK = 1 << 20
#: Larger than any doc_id.
NOBODY = np.iinfo(np.int64).max

_random = np.random.default_rng(20)
_BYTES = _random.integers(0, 1 << 64, 256, np.uint64)
_STEPS = [(1 << i, np.uint64(int(_random.integers(1 << 32, 1 << 62)) * 2 + 1)) for i in range(4)]


def names(data: bytes) -> Iterator[tuple[int, np.ndarray]]:
    """(first window, names of the windows from there), piece by piece."""
    raw = np.frombuffer(data, np.uint8)
    for at in range(0, len(raw) - LENGTH + 1, CHUNK):
        h = four = _BYTES[raw[at : at + CHUNK + LENGTH - 1]]
        for step, factor in _STEPS:  # 16-grams; with the 4-gram after it, 20-grams
            h = h[:-step] * factor + h[step:]
            four = h if step == 2 else four
        h = h[: len(four) - 16] * _STEPS[0][1] + four[16:]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0x9E3779B97F4A7C15)
        h ^= h >> np.uint64(29)
        for step in (1, 2, 4, 8, LENGTH - GRAM - 15):  # over LENGTH - GRAM + 1 places
            h = np.minimum(h[:-step], h[step:])
        yield at, h & np.uint64(NAME)


def runs(data: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Name, first window and number of windows of each run; empty for a text shorter than LENGTH."""
    found = []
    for at, name in names(data):
        first = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
        found.append((name[first], first + at, np.diff(np.append(first, len(name)))))
    if not found:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(x) for x in zip(*found, strict=True))


def pack_names(name: np.ndarray) -> bytes:
    return name.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :6].tobytes()


def unpack_names(data: bytes) -> np.ndarray:
    out = np.zeros((len(data) // 6, 8), np.uint8)
    out[:, :6] = np.frombuffer(data, np.uint8).reshape(-1, 6)
    return out.view("<u8").ravel()


def encoded(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def suffix_array(symbols: np.ndarray, enough: int) -> np.ndarray:
    """Suffix array by prefix doubling, in which suffixes that agree in ``enough`` symbols may stand in any order.

    Only what isn't told apart yet is sorted again.
    """
    n = len(symbols)
    bits = max(1, int(symbols.max(initial=0)).bit_length())
    width = max(1, 62 // bits)
    key, padded = np.zeros(n, np.int64), np.concatenate([symbols.astype(np.int64) + 1, np.zeros(width, np.int64)])
    base = int(symbols.max(initial=0)) + 2
    while base**width >= 1 << 62:
        width -= 1
    for i in range(width):
        key = key * base + padded[i : i + n]
    order = np.argsort(key, kind="stable")
    new = np.concatenate([[True], key[order][1:] != key[order][:-1]])
    start = np.maximum.accumulate(np.where(new, np.arange(n), 0))
    rank = np.empty(n + 1, np.int64)
    rank[n] = -1
    rank[order] = start
    depth = width
    while True:
        alone = new & np.concatenate([new[1:], [True]])
        at = np.flatnonzero(~alone)  # places in the order that hold ties
        if not len(at) or depth >= enough:
            return order
        who = order[at]
        second = rank[np.minimum(who + depth, n)]
        by = np.argsort(start[at] * (n + 1) + second, kind="stable")
        who, second, first = who[by], second[by], start[at]
        order[at] = who
        parts = np.concatenate([[True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])])
        new[at] = parts
        start[at] = np.maximum.accumulate(np.where(parts, at, 0))
        rank[order[at]] = start[at]
        depth *= 2


def equal_prefixes(symbols: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array, and where in it a suffix differs from the one before within ``length`` symbols.

    Symbol 0 parts strings; suffixes that have it within ``length`` may be
    grouped wrongly. Intervals are extended backwards breadth first: a pass at
    depth d finds the borders at which neighbours share d symbols. Those that
    are open after ``length`` passes share at least so many.
    """
    n = len(symbols)
    order = suffix_array(symbols, length)
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    before = symbols[order - 1]  # the Burrows-Wheeler transform; the first suffix has the last symbol before it
    back = place[order - 1]
    first = symbols[order]
    border = np.zeros(n + 1, bool)
    border[0] = border[n] = True
    owner = np.full(n, -1, np.int64)
    low, high = np.zeros(1, np.int64), np.full(1, n, np.int64)
    for _ in range(length):
        size = high - low
        total = int(size.sum())
        if not total:
            break
        whose = np.repeat(np.arange(len(low)), size)
        inside = np.arange(total) - np.repeat(np.cumsum(size) - size, size) + np.repeat(low, size)
        keep = before[inside] != 0
        to = back[inside[keep]]
        owner[to] = whose[keep]
        if len(to) * 8 < n:
            to.sort()
        else:
            to = np.flatnonzero(owner >= 0)
        own, symbol = owner[to], first[to]
        owner[to] = -1
        starts = np.flatnonzero(np.concatenate([[True], (own[1:] != own[:-1]) | (symbol[1:] != symbol[:-1])])) if len(to) else np.zeros(0, np.int64)
        a, b = to[starts], to[np.append(starts[1:], len(to)) - 1] + 1 if len(to) else starts
        fresh = ~border[b]
        border[b] = True
        low, high = a[fresh], b[fresh]
    return order, border[:n]


def oldest(strings: list[bytes], docs: np.ndarray, length: int = LENGTH) -> np.ndarray:
    """For each place of the joined strings (each followed by one more place) the smallest of ``docs`` among
    strings that have the same ``length`` bytes there; NOBODY where fewer are left."""
    size = np.array([len(s) for s in strings], np.int64) + 1
    ends = np.cumsum(size)
    raw = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
    used = np.zeros(256, bool)
    used[raw] = True
    code = np.cumsum(used).astype(np.int16)
    symbols = code[raw]
    symbols[ends - 1] = 0
    left = np.repeat(ends, size) - np.arange(len(raw)) - 1
    of = np.where(left >= length, np.repeat(docs, size), NOBODY)
    order, border = equal_prefixes(symbols, length)
    starts = np.flatnonzero(border)
    least = np.minimum.reduceat(of[order], starts)
    out = np.empty(len(raw), np.int64)
    out[order] = np.repeat(least, np.diff(np.append(starts, len(raw))))
    return np.where(left >= length, out, NOBODY)


def spans(n: int, first: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, int]:
    """Which of n bytes the windows cover (``count`` windows from each ``first``), in how many runs."""
    change = np.zeros(n + 1, np.int32)
    np.add.at(change, first, 1)
    np.add.at(change, first + count + LENGTH - 1, -1)
    covered = np.cumsum(change[:n]) > 0
    return covered, int(np.count_nonzero(covered[1:] & ~covered[:-1])) + int(n > 0 and covered[0])


def characters(data: bytes, covered: np.ndarray) -> bytes:
    """What is left of UTF-8 text; a character that lost some of its bytes goes as a whole."""
    raw = np.frombuffer(data, np.uint8)
    whose = np.cumsum((raw & 0xC0) != 0x80) - 1
    lost = np.zeros(int(whose[-1]) + 1, bool)
    lost[whose[covered]] = True
    return raw[~lost[whose]].tobytes()


_ROW = "kind int, share int, grp int, doc_id string, n_bytes long, n_removed long, n_spans long, kept_sha256 string, data binary"
_COLUMNS = ["kind", "share", "grp", "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "data"]
# Kinds of rows.
_TEXT, _NAMES, _COPY, _DONE, _OPEN, _RUNS, _OLDER = range(7)


def _frame(rows: list[tuple]) -> pd.DataFrame:
    """Rows with their types; ids are strings here, as pandas would turn numbers beside a null into floats."""
    out = pd.DataFrame(rows, columns=_COLUMNS, dtype=object)
    out["kind"] = out["kind"].astype("int32")
    for c in ("share", "grp"):
        out[c] = out[c].astype("Int32")
    for c in ("n_bytes", "n_removed", "n_spans"):
        out[c] = out[c].astype("Int64")
    out["doc_id"] = pd.Series([None if d is None or pd.isna(d) else str(d) for d in out["doc_id"]], dtype=object)
    return out


def _arrays(*parts: bytes) -> bytes:
    """Byte strings in one, compressed."""
    sizes = np.array([len(p) for p in parts], "<i8").tobytes()
    return zstandard.ZstdCompressor(3).compress(bytes([len(parts)]) + sizes + b"".join(parts))


def _parts(data: bytes) -> list[bytes]:
    raw = zstandard.ZstdDecompressor().decompress(data)
    ends = np.cumsum(np.frombuffer(raw, "<i8", raw[0], 1)).tolist()
    at = 1 + 8 * raw[0]
    return [raw[at + a : at + b] for a, b in zip([0, *ends], ends, strict=False)]


def _name_rows(shares: int):
    """Texts -> for each share of names, the names and groups of some megabytes of documents."""

    def flush(name, group, doc):
        name, group, doc = (np.concatenate(x) for x in (name, group, doc))
        by = np.lexsort((doc, name))
        name, group, doc = name[by], group[by], doc[by]
        new = np.concatenate([[True], name[1:] != name[:-1]])
        several = np.zeros(len(name), bool)
        several[1:] = ~new[1:] & (doc[1:] != doc[:-1])
        shared = np.logical_or.reduceat(several, np.flatnonzero(new)) if len(name) else several
        flag = np.repeat(shared, np.diff(np.append(np.flatnonzero(new), len(name))))
        by = np.lexsort((group, name, name % np.uint64(shares)))
        name, group, flag = name[by], group[by], flag[by]
        keep = np.concatenate([[True], (name[1:] != name[:-1]) | (group[1:] != group[:-1])])
        name, group, flag = name[keep], group[keep], flag[keep]
        share = (name % np.uint64(shares)).astype(np.int64)
        cuts = np.flatnonzero(np.concatenate([[True], share[1:] != share[:-1]]))
        for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(name)], strict=True):
            yield int(share[a]), pack_names(name[a:b]), (group[a:b].astype("<i4") | flag[a:b].astype("<i4") << 31).tobytes()

    def run(batches):
        forget()
        held, at, doc = [], 0, 0
        for pdf in batches:
            out = []
            for text, group in zip(pdf["text"], pdf["grp"], strict=True):
                data = encoded(text)
                name = np.unique(runs(data)[0])
                doc, at = doc + 1, at + len(data)
                if len(name):
                    held.append((name, np.full(len(name), group, np.int64), np.full(len(name), doc, np.int64)))
                if at >= SHARE and held:
                    out += flush(*zip(*held, strict=True))
                    held, at = [], 0
            if out:
                yield pd.DataFrame(out, columns=["share", "names", "groups"])
        if held:
            yield pd.DataFrame(list(flush(*zip(*held, strict=True))), columns=["share", "names", "groups"])

    return run


def _shared_names(pdf: pd.DataFrame) -> pd.DataFrame:
    """A share's names -> for each group of documents those that more than one document has."""
    name = np.concatenate([unpack_names(x) for x in pdf["names"]])
    parts = [np.frombuffer(x, "<i4") for x in pdf["groups"]]
    group = np.concatenate(parts)
    source = np.repeat(np.arange(len(parts)), [len(p) for p in parts])
    by = np.lexsort((source, name))
    name, group, source = name[by], group[by], source[by]
    starts = np.flatnonzero(np.concatenate([[True], name[1:] != name[:-1]]))
    size = np.diff(np.append(starts, len(name)))
    ends = starts + size - 1
    many = (source[starts] != source[ends]) | np.logical_or.reduceat(group < 0, starts)
    keep = np.repeat(many, size)
    name, group = name[keep], group[keep] & 0x7FFFFFFF
    by = np.lexsort((name, group))
    name, group = name[by], group[by]
    cuts = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]])) if len(name) else np.zeros(0, np.int64)
    rows = [(_NAMES, None, int(group[a]), None, None, None, None, None, pack_names(np.unique(name[a:b]))) for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(name)], strict=False)]
    return _frame(rows)


def _compress(batches):
    squeeze = zstandard.ZstdCompressor(3)
    for pdf in batches:
        yield _frame([(_TEXT, None, g, d, None, None, None, None, squeeze.compress(encoded(t))) for d, t, g in zip(pdf["doc_id"], pdf["text"], pdf["grp"], strict=True)])


def _done(doc: int, data: bytes) -> tuple:
    return (_DONE, None, None, doc, len(data), 0, 0, hashlib.sha256(data).hexdigest(), None)


def _group_runs(shares: int):
    """A group's texts, shared names and copies -> finished documents, open ones, and their runs by share."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        forget()
        group, unzip = int(pdf["grp"].iloc[0]), zstandard.ZstdDecompressor()
        shared = np.unique(np.concatenate([np.zeros(0, np.uint64), *[unpack_names(x) for x in pdf["data"][pdf["kind"] == _NAMES]]]))
        known_copies = pdf.loc[pdf["kind"] == _COPY, ["doc_id", "kept_sha256"]]
        copies = set(zip(map(int, known_copies["doc_id"]), known_copies["kept_sha256"], strict=True))
        copied = {d for d, _ in copies}
        rows: list[tuple] = []
        held: dict[bytes, list[int]] = {}
        for doc, zipped in pdf.loc[pdf["kind"] == _TEXT, ["doc_id", "data"]].itertuples(index=False):
            data = unzip.decompress(zipped)
            doc = int(doc)
            if doc in copied and (doc, sha := hashlib.sha256(data).hexdigest()) in copies:
                rows.append((_DONE, None, None, doc, len(data), len(data), 1, hashlib.sha256(b"").hexdigest(), bytes.fromhex(sha)))
                continue
            name, first, count = runs(data)
            hit = _isin(name, shared)
            if not hit.any():
                rows.append(_done(doc, data))
                continue
            rows.append((_OPEN, None, group, doc, None, None, None, None, zipped))
            for v, a, c in zip(name[hit].tolist(), first[hit].tolist(), count[hit].tolist(), strict=True):
                key = data[a : a + c + LENGTH - 1]
                known = held.get(key)
                if known is None:
                    held[key] = [v, doc, doc]
                elif doc < known[1]:
                    known[1] = doc
                elif doc > known[2]:
                    known[2] = doc
        by_share: dict[int, list[bytes]] = {}
        for key in sorted(held, key=lambda k: held[k][0]):
            by_share.setdefault(held[key][0] % shares, []).append(key)
        for share, keys in sorted(by_share.items()):
            about = np.array([held[k] for k in keys], np.int64)
            v, low, high = np.diff(about[:, 0], prepend=0), about[:, 1].copy(), about[:, 2] - about[:, 1]
            size = np.array([len(k) for k in keys], np.int32)
            rows.append((_RUNS, share, group, None, int(size.sum()), None, None, None, _arrays(v.tobytes(), low.tobytes(), high.tobytes(), size.tobytes(), b"".join(keys))))
        return _frame(rows)

    return run


def _isin(name: np.ndarray, known: np.ndarray) -> np.ndarray:
    if not len(known):
        return np.zeros(len(name), bool)
    return known[np.minimum(np.searchsorted(known, name), len(known) - 1)] == name


def _windows(strings: list[bytes], docs: np.ndarray) -> tuple[np.ndarray, ...]:
    """(string, first window, windows, smallest doc_id) of each stretch of windows with one smallest doc_id."""
    old = oldest(strings, docs)
    size = np.array([len(s) for s in strings], np.int64) + 1
    ends = np.cumsum(size)
    of = np.repeat(np.arange(len(strings)), size)
    first = np.zeros(len(old), bool)
    first[ends - size] = True
    starts = np.flatnonzero((old != NOBODY) & (first | np.concatenate([[True], old[1:] != old[:-1]])))
    stop = np.minimum(np.append(starts[1:], len(old)), ends[of[starts]] - LENGTH)
    return of[starts], starts - (ends - size)[of[starts]], stop - starts, old[starts]


def _share_older(pdf: pd.DataFrame) -> pd.DataFrame:
    """A share's runs -> for each group which windows of its runs are older elsewhere."""
    index: dict[bytes, int] = {}
    ids, name, low, high, group = [], [], [], [], []
    for g, data in zip(pdf["grp"].tolist(), pdf["data"], strict=True):
        v, least, more, size, joined = _parts(data)
        ends = np.cumsum(np.frombuffer(size, np.int32)).tolist()
        ids += [index.setdefault(joined[a:b], len(index)) for a, b in zip([0, *ends], ends, strict=False)]
        name.append(np.cumsum(np.frombuffer(v, np.int64)))
        low.append(np.frombuffer(least, np.int64))
        high.append(low[-1] + np.frombuffer(more, np.int64))
        group.append(np.full(len(ends), g, np.int64))
    keys, use = list(index), np.array(ids, np.int64)
    name, low, high, group = (np.concatenate(x) for x in (name, low, high, group))
    by = np.argsort(use, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], use[by][1:] != use[by][:-1]]))
    least, name = np.minimum.reduceat(low[by], starts), name[by][starts]
    size = np.array([len(k) for k in keys], np.int64)
    by = np.argsort(name, kind="stable")
    starts = np.flatnonzero(np.concatenate([[True], name[by][1:] != name[by][:-1]]))
    count = np.diff(np.append(starts, len(by)))
    # What has a name of its own is equal to nothing but its copies, which are one here.
    own = by[starts[count == 1]]
    found = [(own, np.zeros(len(own), np.int64), size[own] - LENGTH + 1, least[own])]
    some = by[np.repeat(count > 1, count)]
    starts = np.flatnonzero(np.concatenate([[True], name[some][1:] != name[some][:-1]])) if len(some) else np.zeros(0, np.int64)
    filled = np.cumsum(size[some]) // ARRAY
    cuts = [0, *starts[1:][filled[starts[1:]] != filled[starts[:-1]]].tolist(), len(some)]
    for a, b in zip(cuts, cuts[1:], strict=False):
        if a < b:
            part = some[a:b]
            of, *rest = _windows([keys[i] for i in part.tolist()], least[part])
            found.append((part[of], *rest))
    of, first, windows, doc = (np.concatenate(x) for x in zip(*found, strict=True))
    by = np.argsort(of, kind="stable")
    first, windows, doc = first[by], windows[by], doc[by]
    n = np.bincount(of, minlength=len(keys))
    begin = np.cumsum(n) - n
    # Every use of a run gets the run's stretches that are older than its youngest document.
    whose = np.repeat(np.arange(len(use)), n[use])
    entry = np.arange(len(whose)) - np.repeat(np.cumsum(n[use]) - n[use], n[use]) + begin[use[whose]]
    keep = doc[entry] < high[whose]
    whose, entry = whose[keep], entry[keep]
    order = np.argsort(group[whose], kind="stable")
    whose, entry = whose[order], entry[order]
    cuts = np.flatnonzero(np.concatenate([[True], group[whose][1:] != group[whose][:-1]])) if len(whose) else np.zeros(0, np.int64)
    rows = []
    for a, b in zip(cuts.tolist(), [*cuts[1:].tolist(), len(whose)], strict=False):
        w, e = whose[a:b], entry[a:b]
        new = np.flatnonzero(np.concatenate([[True], w[1:] != w[:-1]]))
        key = np.array([xxhash.xxh3_64_intdigest(keys[i]) for i in use[w[new]].tolist()], np.uint64)
        parts = (key, np.diff(np.append(new, len(w))).astype(np.int32), first[e].astype(np.int32), windows[e].astype(np.int32), doc[e])
        rows.append((_OLDER, None, int(group[w[0]]), None, None, None, None, None, _arrays(*[p.tobytes() for p in parts])))
    return _frame(rows)


def _remove(keep_text: bool):
    """A group's open texts and what is older elsewhere -> finished documents."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [_parts(data) for data in pdf["data"][pdf["kind"] == _OLDER]]
        key, n, first, count, least = (np.frombuffer(b"".join(p[k] for p in parts), t) for k, t in enumerate((np.uint64, np.int32, np.int32, np.int32, np.int64)))
        begin = np.cumsum(n) - n
        place = dict(zip(key.tolist(), range(len(key)), strict=True))
        unzip, rows = zstandard.ZstdDecompressor(), []
        for doc, zipped in pdf.loc[pdf["kind"] == _OPEN, ["doc_id", "data"]].itertuples(index=False):
            data = unzip.decompress(zipped)
            _, start, windows = runs(data)
            hit = [place.get(xxhash.xxh3_64_intdigest(data[a:b]), -1) for a, b in zip(start.tolist(), (start + windows + LENGTH - 1).tolist(), strict=True)]
            hit = np.array(hit, np.int64)
            start, hit = start[hit >= 0], hit[hit >= 0]
            whose = np.repeat(np.arange(len(hit)), n[hit])
            entry = np.arange(len(whose)) - np.repeat(np.cumsum(n[hit]) - n[hit], n[hit]) + begin[hit[whose]]
            keep = least[entry] < int(doc)
            whose, entry = whose[keep], entry[keep]
            if not len(entry):
                rows.append(_done(int(doc), data))
                continue
            covered, n_spans = spans(len(data), start[whose] + first[entry], count[entry].astype(np.int64))
            kept = np.frombuffer(data, np.uint8)[~covered].tobytes()
            text = hashlib.sha256(data).digest() + characters(data, covered) if keep_text else None
            rows.append((_DONE, None, None, int(doc), len(data), int(covered.sum()), n_spans, hashlib.sha256(kept).hexdigest(), text))
        return _frame(rows)

    return run


def _group(groups: int) -> Column:
    """The group of a document: by id and text, so that one id's different texts are in many."""
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(groups)).cast("int")


def remove_repeats(docs: DataFrame, keep_text: bool = False) -> DataFrame:
    """``(doc_id, n_bytes, n_removed, n_spans, kept_sha256, data)`` for every row of ``docs(doc_id, text)``.

    ``data``, only where bytes were removed: the input's SHA-256 if it went as
    a copy of another; with ``keep_text`` also for others, followed by the text
    that is left, without characters that lost some of their bytes. A null text
    is an empty one. Texts of fewer than LENGTH bytes stay whole; very long
    ones are named in chunks. Rows that repeat a doc_id are documents of their
    own, whatever their texts: none of them is older than the others. Rows with
    a null doc_id stay whole and make nothing old. Other columns are ignored;
    an empty table gives an empty result.
    """
    session(docs)
    rows = docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    size = total_bytes(rows)
    groups, shares = buckets_for(size, GROUP), buckets_for(size, SHARE)
    # Rows without an id are as they are: however many there are, they pass no shuffle.
    unnamed = rows.where("doc_id IS NULL").select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), *[F.lit(0).cast("long").alias(c) for c in ("n_removed", "n_spans")], F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"), F.lit(None).cast("binary").alias("data"))
    rows = rows.where("doc_id IS NOT NULL").withColumn("grp", _group(groups))
    counted = rows.where(f"octet_length(text) >= {LENGTH}")
    named = counted.select("text", "grp").mapInPandas(_name_rows(shares), "share int, names binary, groups binary")
    shared = named.groupBy("share").applyInPandas(_shared_names, _ROW)
    hashed = counted.select("doc_id", "grp", F.unhex(F.sha2(F.col("text").cast("binary"), 256)).alias("sha"))
    least = hashed.groupBy("sha").agg(F.min("doc_id").alias("least"))
    copies = hashed.join(least, "sha").where("doc_id > least").select(
        F.lit(_COPY).alias("kind"), F.lit(None).cast("int").alias("share"), "grp", F.col("doc_id").cast("string").alias("doc_id"), *[F.lit(None).cast("long").alias(c) for c in ("n_bytes", "n_removed", "n_spans")], F.lower(F.hex("sha")).alias("kept_sha256"), F.lit(None).cast("binary").alias("data")
    )
    texts = rows.withColumn("doc_id", F.col("doc_id").cast("string")).mapInPandas(_compress, _ROW)
    first = cut(texts.unionByName(shared).unionByName(copies).groupBy("grp").applyInPandas(_group_runs(shares), _ROW))
    older = first.where(F.col("kind") == _RUNS).groupBy("share").applyInPandas(_share_older, _ROW)
    second = first.where(F.col("kind") == _OPEN).unionByName(older).groupBy("grp").applyInPandas(_remove(keep_text), _ROW)
    done = first.where(F.col("kind") == _DONE).unionByName(second).select(F.col("doc_id").cast("long").alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256", "data")
    return done.unionByName(unnamed)


def without_repeats(docs: DataFrame) -> DataFrame:
    """``docs`` with repeats cut out of ``text``, and ``n_chars`` after it where there is such a column.

    A character that lost some of its bytes goes as a whole. No row goes;
    what is a copy as a whole has an empty text. Columns are those of
    ``docs``. Rows that repeat a doc_id are told apart by their texts, those
    with the same text are cut alike. An empty table gives an empty result.
    """
    id_, sha, left, text = free(docs, "id", "sha", "left", "new")
    with scratch(docs.sparkSession):
        found = cut(remove_repeats(docs, keep_text=True).where("n_removed > 0").select("doc_id", "data"), outside=True)
    changed = found.select(F.col("doc_id").alias(id_), F.lower(F.hex(F.substring("data", 1, 32))).alias(sha), F.expr("substring(data, 33)").cast("string").alias(left)).dropDuplicates([id_, sha])
    own = F.sha2(F.coalesce(F.col("text").cast("string"), F.lit("")).cast("binary"), 256)
    out = docs.join(changed, (F.col("doc_id") == F.col(id_)) & (own == F.col(sha)), "left")
    out = out.withColumn(text, F.when(F.col(id_).isNull(), F.col("text")).otherwise(F.col(left)))
    picked = [F.col(text).alias("text") if c == "text" else F.when(F.col(id_).isNull(), F.col(c)).otherwise(F.char_length(text)).cast("long").alias(c) if c == "n_chars" else F.col(c) for c in docs.columns]
    return out.select(*picked)


def op4(spark, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents")).drop("data")
