"""Packing token sequences by Karmarkar-Karp multiway differencing.

Every document's ids, with an end id, are cut into full windows and one tail. Tails are cut
further into a few pieces of nearly equal length and gathered in pools; multiway differencing
splits each pool over as few windows as can hold it: partial partitions with the largest
imbalance are merged, large sums of one on small sums of the other, until a single one is
left. If its largest window exceeds the capacity, the number of windows rises. Windows thus
come out nearly equal, and padding stays at a few tokens each.

Pools are filled partition by partition, so nothing is shuffled and memory is bounded by the
pool. Null texts count as empty, repeated rows are packed once each, a null doc_id is kept.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quillon.llm import common

CAPACITY = 1024
#: Longest piece of a tail: shorter ones fill windows better, longer ones keep tails together.
TAIL_PIECE = 128
#: Windows' worth of tail tokens that are partitioned together.
POOL_WINDOWS = 128

SCHEMA = pa.schema(
    [
        ("doc_id", pa.int64()),
        ("start", pa.int64()),
        ("length", pa.int64()),
        ("ids_crc32", pa.int64()),
        ("doc_tokens", pa.int64()),
        ("sequence_id", pa.int64()),
        ("offset", pa.int64()),
    ]
)
DDL = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _merge(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray], k: int, tree: list) -> tuple[np.ndarray, np.ndarray]:
    """Two partial partitions (non-zero sums in descending order, their nodes) into one of k windows."""
    (sa, na), (sb, nb) = a, b
    shared = max(0, len(sa) + len(sb) - k)
    ka, kb = len(sa) - shared, len(sb) - shared
    sums, nodes = [sa[:ka], sb[:kb]], [na[:ka], nb[:kb]]
    if shared:
        left, right = na[ka:], nb[kb:][::-1]
        first = len(tree)
        tree.extend(zip(left.tolist(), right.tolist(), strict=True))
        sums.append(sa[ka:] + sb[kb:][::-1])
        nodes.append(np.arange(first, first + shared))
    s, n = np.concatenate(sums), np.concatenate(nodes)
    order = np.argsort(-s, kind="stable")
    return s[order], n[order]


def multiway_difference(sizes: list[int], k: int) -> list[list[int]]:
    """Indices of ``sizes`` in k groups of nearly equal sums; groups may be empty."""
    if not sizes:
        return [[] for _ in range(k)]
    tree: list[tuple[int, int] | None] = [None] * len(sizes)
    parts = {i: (np.array([s], np.int64), np.array([i], np.int64)) for i, s in enumerate(sizes)}
    heap = [(-s, i) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    label = len(sizes)
    while len(heap) > 1:
        _, i = heapq.heappop(heap)
        _, j = heapq.heappop(heap)
        merged = _merge(parts.pop(i), parts.pop(j), k, tree)
        parts[label] = merged
        low = int(merged[0][-1]) if len(merged[0]) == k else 0
        heapq.heappush(heap, (low - int(merged[0][0]), label))
        label += 1
    groups = []
    for node in parts[heap[0][1]][1].tolist():
        group, todo = [], [node]
        while todo:
            x = todo.pop()
            if (pair := tree[x]) is None:
                group.append(x)
            else:
                todo.extend(pair)
        groups.append(sorted(group))
    return groups + [[] for _ in range(k - len(groups))]


def fill(sizes: list[int], capacity: int) -> list[list[int]]:
    """Groups of at most ``capacity``: the smallest number of windows whose differencing fits."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        groups = multiway_difference(sizes, k)
        if max(sum(sizes[i] for i in g) for g in groups) <= capacity:
            return [g for g in groups if g]
        k += 1


def pieces(n: int, capacity: int, longest: int) -> tuple[list[int], list[int]]:
    """Lengths of the full windows and of the tail's pieces of a document with n tokens."""
    full, tail = divmod(n, capacity)
    parts = -(-tail // longest)
    return [capacity] * full, [tail // parts + (i < tail % parts) for i in range(parts)]


def pack(df: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, tail_piece: int = TAIL_PIECE, pool_windows: int = POOL_WINDOWS, keep: int | None = None) -> DataFrame:
    """One row per piece of each document's ids (``doc_id``, ``text``): where it lies, in which window.

    ``sequence_id`` is the partition's number times 2**33 plus the window's number there. A worker
    remembers ``common.KEEP`` words from task to task; given ``keep``, so many at most, and it
    forgets them when its task ends, for workers that other operators use too.
    """
    return common.texts_of(df.select("doc_id", "text")).mapInArrow(_packer(tokenizer, end_id, capacity, tail_piece, pool_windows, keep), DDL)


def _packer(tokenizer: str, end_id: int, capacity: int, tail_piece: int, pool_windows: int, keep: int | None = None):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cache = common.word_cache(tokenizer, keep=common.KEEP if keep is None else keep)
        try:
            yield from packed(batches, cache)
        finally:
            if keep is not None:
                cache.forget()

    def packed(batches: Iterable[pa.RecordBatch], cache: common.WordCache) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 33
        out = common.Emitter(SCHEMA)
        pool: list[tuple] = []
        waiting = 0

        def settle() -> None:
            nonlocal sequence, pool, waiting
            for group in fill([p[2] for p in pool], capacity):
                offset = 0
                for i in group:
                    doc, start, length, crc, total = pool[i]
                    out.add(doc, start, length, crc, total, sequence, offset)
                    offset += length
                sequence += 1
            pool, waiting = [], 0

        encoded = ((row[0], ids) for block in common.arrow_blocks(batches, "doc_id", "text", text="text") for row, ids in zip(block, cache.spaced([x[1] for x in block]), strict=True))
        for doc, found in encoded:
            ids = memoryview(found + end)
            total, start = len(ids) // 4, 0
            full, tail = pieces(total, capacity, tail_piece)
            for length in full:
                out.add(doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total, sequence, 0)
                sequence, start = sequence + 1, start + length
            for length in tail:
                pool.append((doc, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)]), total))
                waiting, start = waiting + length, start + length
            if waiting >= pool_windows * capacity:
                settle()
            if out.full():
                yield out.take()
        if pool:
            settle()
        yield out.take()

    return run
