"""Number partitioning: sequences dealt to ranks with about equal totals."""

from __future__ import annotations

import heapq
from bisect import insort
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame


def differencing(lengths: list[int], k: int, equal: bool = False) -> list[list[int]]:
    """Partition of indexes into k parts by largest differencing.

    The two states with the largest spread are merged, heaviest part with
    lightest, until one is left: about n log n steps, however many parts there are. With ``equal``, indexes enter in groups of k
    neighbours by size, so that all parts have as many members; their number
    must be divisible by k.
    """
    order = sorted(range(len(lengths)), key=lambda i: (lengths[i], i))
    if equal:
        if len(lengths) % k:
            raise ValueError(f"{len(lengths)} sequences can't be parted into {k} equally large parts")
        starts = [State.of([(-lengths[i], [i]) for i in order[a : a + k]], 0) for a in range(0, len(order), k)]
    else:
        starts = [State.of([(-lengths[i], [i])], k - 1) for i in order]
    heap = [(-s.spread(), n, s) for n, s in enumerate(starts)]
    heapq.heapify(heap)
    n = len(starts)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = a.merged(b)
        heapq.heappush(heap, (-merged.spread(), n, merged))
        n += 1
    if not heap:
        return [[] for _ in range(k)]
    return [sorted(p) for _, p in heap[0][2].parts()]


@dataclass
class State:
    """Parts ``(-total, members)`` from the heaviest to the lightest, those without members only counted.

    ``heavy`` have a total, ``idle`` have members of length 0: these stand
    behind the empty ones. While most parts are empty a merge costs as much as
    its smaller side has parts, not as many as there are in all.
    """

    heavy: list[tuple[int, list[int]]]
    empty: int
    idle: list[tuple[int, list[int]]]

    @classmethod
    def of(cls, parts: list[tuple[int, list[int]]], empty: int) -> State:
        parts = sorted(parts)
        return cls([p for p in parts if p[0]], empty, [p for p in parts if not p[0]])

    def spread(self) -> int:
        heaviest = -self.heavy[0][0] if self.heavy else 0
        return heaviest if self.empty or self.idle or not self.heavy else heaviest + self.heavy[-1][0]

    def parts(self) -> list[tuple[int, list[int]]]:
        return [*self.heavy, *((0, []) for _ in range(self.empty)), *self.idle]

    def merged(self, other: State) -> State:
        """Heaviest part with lightest; members of ``self`` come first. The larger of the two is used up."""
        mine, theirs = len(self.heavy) + len(self.idle), len(other.heavy) + len(other.idle)
        if 4 * min(mine, theirs) > max(mine, theirs) or self.idle or other.idle:
            pairs = [(x[0] + y[0], x[1] + y[1]) for x, y in zip(self.parts(), reversed(other.parts()), strict=True)]
            return State.of([p for p in pairs if p[1]], sum(not p[1] for p in pairs))
        small, large = (other, self) if theirs <= mine else (self, other)
        heavy, empty, new = large.heavy, large.empty, []
        k = len(heavy) + empty
        # The i-th heaviest meets the part that is i-th from the end: an empty one as long as there are any.
        for i, (total, members) in enumerate(small.heavy):
            at = k - 1 - i
            if at >= len(heavy):
                new.append((total, members))
            else:
                t, m = heavy[at]
                new.append((total + t, m + members if small is other else members + m))
        taken = max(0, len(small.heavy) - empty)
        if taken:
            del heavy[len(heavy) - taken :]
        for p in new:
            insort(heavy, p)
        return State(heavy, empty - (len(new) - taken), [])


def greedy(lengths: list[int], k: int) -> list[list[int]]:
    """Each sequence, in its order, goes to the part with the smallest total so far."""
    heap, parts = [(0, p) for p in range(k)], [[] for _ in range(k)]
    for i, n in enumerate(lengths):
        total, p = heapq.heappop(heap)
        parts[p].append(i)
        heapq.heappush(heap, (total + n, p))
    return parts


def balance(rows: DataFrame, group: str, key: str, length: str, k: int, how: str) -> DataFrame:
    """``(group, key, length, part)``: each group's rows dealt to k parts. Groups are batches of one step and fit a task."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        lengths = pdf[length].tolist()
        parts = differencing(lengths, k) if how == "differencing" else greedy(lengths, k)
        pdf["part"] = 0
        for p, members in enumerate(parts):
            pdf.loc[members, "part"] = p
        return pdf[[group, key, length, "part"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, {length} {kinds[length]}, part int")


def micro_batches(rows: DataFrame, group: str, key: str, length: str, most: int) -> DataFrame:
    """``(group, key, length, part)``: as many parts as the total needs at ``most`` each, at most one a row."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(key, ignore_index=True)
        lengths = pdf[length].tolist()
        k = max(1, min(len(lengths), -(-sum(lengths) // most)))
        parts = np.zeros(len(pdf), np.int32)
        for p, members in enumerate(differencing(lengths, k)):
            parts[members] = p
        pdf["part"] = parts
        return pdf[[group, key, length, "part"]]

    kinds = dict(rows.dtypes)
    return rows.groupBy(group).applyInPandas(run, f"{group} {kinds[group]}, {key} {kinds[key]}, {length} {kinds[length]}, part int")
