"""Packing documents into windows by Karmarkar-Karp multiway differencing.

Each task tokenises its rows. A document's ids (plus a closing id) are cut into whole windows and one
remainder; whole windows are sequences of their own. Remainders gather until `group` of them wait, then are
dealt to windows: every remainder starts as a partition of loads (size, 0, ..., 0); the two partitions of largest
spread are merged, largest load with smallest, until one is left, so opposing imbalances cancel. The count of
windows is the least that could do; if one of them exceeds capacity, the count rises by a hundredth (by one at
least) and the differencing runs again. Lengths that can't be balanced by whole remainders (say, all a little over
half a window) still leave windows above capacity: what is above it is cut off the window's largest remainder and
fills windows with room. So a group leaves about 1 % of padding at most, whatever its lengths, and is differenced
twice at most.

Nothing is shuffled, and memory is one Arrow batch and two groups. sequence_id is the task's partition and a
running number, so a task that runs twice gives the same rows.

Defined cases: null texts are empty (one piece, the closing id); null keys stay null; repeated rows are
documents of their own; an empty table gives no piece.
"""

from __future__ import annotations

import heapq
import zlib

from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import TokenBytes
from .common import text_of

PIECES = "start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint, sequence_id bigint, offset bigint"


def difference(sizes: list[int], windows: int) -> list[list[int]]:
    """Largest differencing into `windows` parts: the sizes' indices by part."""
    import numpy as np

    n = len(sizes)
    if windows == 1:
        return [list(range(n))]
    left, right = np.full(2 * n, -1), np.full(2 * n, -1)  # parts are trees; nodes below n are sizes
    made = n
    heap = []
    for i in sorted(range(n), key=lambda i: -sizes[i]):
        loads, parts = np.zeros(windows, np.int64), np.full(windows, -1)
        loads[0], parts[0] = sizes[i], i
        heap.append((-sizes[i], i, loads, parts))
    heapq.heapify(heap)
    order = n
    while len(heap) > 1:
        _, _, a, pa = heapq.heappop(heap)
        _, _, b, pb = heapq.heappop(heap)
        loads, pb = a + b[::-1], pb[::-1]
        parts = np.where(pa < 0, pb, pa)
        both = np.flatnonzero((pa >= 0) & (pb >= 0))
        new = np.arange(made, made + len(both))
        left[new], right[new], parts[both] = pa[both], pb[both], new
        made += len(both)
        rank = np.argsort(-loads, kind="stable")
        loads = loads[rank] - loads[rank[-1]]
        heapq.heappush(heap, (-int(loads[0]), order, loads, parts[rank]))
        order += 1
    out = []
    for root in heap[0][3]:
        part, stack = [], [int(root)] if root >= 0 else []
        while stack:
            x = stack.pop()
            if x < n:
                part.append(x)
            else:
                stack += [int(left[x]), int(right[x])]
        out.append(part)
    return out


def windows_of(sizes: list[int], capacity: int) -> list[list[tuple[int, int, int]]]:
    """Windows of (index, start, length): all sizes, in windows of at most capacity, few more than must be."""
    count = max(1, -(-sum(sizes) // capacity))
    parts = difference(sizes, count)
    if max(sum(sizes[i] for i in p) for p in parts) > capacity:
        count += max(1, count // 100)
        parts = difference(sizes, count)
    parts = [[(i, 0, sizes[i]) for i in p] for p in parts]
    loads, over = [sum(x[2] for x in p) for p in parts], []
    for w, part in enumerate(parts):
        while loads[w] > capacity:  # cut the largest one's end off
            at = max(range(len(part)), key=lambda j: part[j][2])
            i, start, length = part[at]
            off = min(length, loads[w] - capacity)
            part[at : at + 1] = [(i, start, length - off)] if off < length else []
            over.append((i, start + length - off, off))
            loads[w] -= off
    room = sorted((w for w in range(count) if loads[w] < capacity), key=lambda w: loads[w])
    while over:
        i, start, length = over.pop()
        w = room[-1]  # the fullest of those with room, so that few pieces are cut again
        put = min(length, capacity - loads[w])
        parts[w].append((i, start, put))
        loads[w] += put
        if loads[w] == capacity:
            room.pop()
        if put < length:
            over.append((i, start + put, length - put))
    return [sorted(p) for p in parts if p]


def pack(df: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text", capacity: int = 4096, end: int = 2, group: int = 1024) -> DataFrame:
    """One row a piece: key, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def run(batches):
        import pyarrow as pa

        coder, tail = TokenBytes(vocabulary), end.to_bytes(4, "little")
        base, sequence = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0
        waiting: list[tuple] = []
        kind = None

        def rows(pieces):
            k, *rest = zip(*pieces, strict=True) if pieces else ([],) * 7
            return pa.RecordBatch.from_arrays([pa.array(k, kind), *(pa.array(x, pa.int64()) for x in rest)], names=["k", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        def deal(n):
            nonlocal sequence
            taken, out = waiting[:n], []
            del waiting[:n]
            for part in windows_of([len(p[2]) // 4 for p in taken], capacity):
                at = 0
                for i, begin, length in part:
                    k, start, ids, n = taken[i]
                    out.append((k, start + begin, length, zlib.crc32(ids[4 * begin : 4 * (begin + length)]), n, base + sequence, at))
                    at += length
                sequence += 1
            return out

        for b in batches:
            kind, out = b.column(0).type, []
            for k, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = memoryview(coder.ids(t) + tail)
                n = len(ids) // 4
                for start in range(0, n, capacity):
                    some = ids[4 * start : 4 * (start + capacity)]
                    if len(some) == 4 * capacity:
                        out.append((k, start, capacity, zlib.crc32(some), n, base + sequence, 0))
                        sequence += 1
                    else:
                        waiting.append((k, start, bytes(some), n))
            while len(waiting) >= 2 * group:
                out += deal(group)
            yield rows(out)
        if waiting:
            yield rows(deal(len(waiting)))

    own = df.select(F.col(key).alias("k"), text_of(text).alias("t"))
    return own.mapInArrow(run, f"k {dict(own.dtypes)['k']}, {PIECES}").withColumnRenamed("k", key)
