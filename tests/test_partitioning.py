"""Largest differencing: the same parts as the plain way, in about n log n steps."""

from __future__ import annotations

import heapq
import random
import time

from tessera.operators import partitioning as P


def plain(lengths, k):
    """All k parts of every state, written out."""
    heap = []
    for n, i in enumerate(sorted(range(len(lengths)), key=lambda i: (lengths[i], i))):
        parts = sorted([(lengths[i], [i])] + [(0, [])] * (k - 1), key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (parts[-1][0] - parts[0][0], n, parts))
    n = len(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[2], heapq.heappop(heap)[2]
        merged = sorted(((x[0] + y[0], x[1] + y[1]) for x, y in zip(a, reversed(b), strict=True)), key=lambda p: (-p[0], p[1]))
        heapq.heappush(heap, (merged[-1][0] - merged[0][0], n, merged))
        n += 1
    return [sorted(p) for _, p in heap[0][2]]


def test_same_parts_as_the_plain_way():
    r = random.Random(1)
    for t in range(600):
        lengths = [r.randint(t % 2, (3, 10, 1000)[t % 3]) for _ in range(r.randint(1, 40))]
        k = r.randint(1, 50)
        assert P.differencing(lengths, k) == plain(lengths, k)
    assert P.differencing([], 2) == [[], []]


def test_many_parts_take_no_square_of_steps():
    r = random.Random(2)
    lengths = [int(r.lognormvariate(7, 1)) for _ in range(24_000)]
    began = time.process_time()
    parts = P.differencing(lengths, 3_000)
    assert time.process_time() - began < 15
    assert sorted(i for p in parts for i in p) == list(range(24_000))
