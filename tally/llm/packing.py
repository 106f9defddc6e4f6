"""Packing of token ids into fixed windows by multiway differencing.

Each document's ids (with an end id) are cut into pieces: whole windows first,
then pieces of at most ``piece`` ids of what is left. Whole windows stand alone.
The others are gathered in groups, and each group is dealt to k windows by the
Karmarkar-Karp multiway differencing method: partial partitions, one sum for
each window, are merged in the order of their imbalance, the largest sums of
one with the smallest of the other. k starts at the least count that could hold
the group and rises until no window exceeds the capacity.

Everything happens within a task and in one pass, so nothing is shuffled and a
group never holds more than ``group`` pieces. Null texts count as empty and give
the end id alone; equal rows are packed once each; a null doc_id is carried.
An empty table gives no pieces.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, texts_of, trim
from .tokens import Encoder

SCHEMA = "doc_id long, start long, length long, doc_tokens long, sequence_id long, offset long, ids binary"


def difference(sizes: list[int], k: int) -> np.ndarray:
    """The window (0 to k - 1) of each size, by Karmarkar-Karp multiway differencing."""
    order = np.argsort(-np.array(sizes, np.int64), kind="stable")
    # each size enters as a partial partition of its own: it in one window, nothing in the others
    leaves = [order[i : i + 1] for i in range(len(sizes))]
    sums: dict[int, np.ndarray] = {}
    made: list[tuple[int, int, np.ndarray, np.ndarray]] = []
    heap = []
    for i, leaf in enumerate(leaves):
        sums[i] = np.zeros(k, np.int64)
        sums[i][-1] = sizes[leaf[0]]
        heap.append((int(sums[i][0] - sums[i][-1]), i))
        sums[i] -= sums[i][0]
    heapq.heapify(heap)
    while len(heap) > 1:
        a, b = heapq.heappop(heap)[1], heapq.heappop(heap)[1]
        both = sums.pop(a) + sums.pop(b)[::-1]
        sort = both.argsort(kind="stable")
        both = both[sort]
        node = len(leaves) + len(made)
        made.append((a, b, sort, k - 1 - sort))
        sums[node] = both - both[0]
        heapq.heappush(heap, (int(both[0] - both[-1]), node))
    # from the last merge down: where each slot of a partial partition ends up
    out = np.zeros(len(sizes), np.int64)
    places: dict[int, np.ndarray] = {heap[0][1]: np.arange(k)} if heap else {}
    for node in range(len(leaves) + len(made) - 1, -1, -1):
        where = places.pop(node)
        if node < len(leaves):
            out[leaves[node]] = where[-len(leaves[node]) :]
            continue
        a, b, left, right = made[node - len(leaves)]
        for child, slots in ((a, left), (b, right)):
            places[child] = np.empty(k, np.int64)
            places[child][slots] = where
    return out


def windows(sizes: list[int], capacity: int) -> np.ndarray:
    """The window of each size; as many windows as the capacity needs."""
    k = max(1, -(-sum(sizes) // capacity))
    while True:
        at = difference(sizes, k)
        if np.bincount(at, weights=sizes, minlength=k).max() <= capacity:
            return at
        k += 1


def pack(docs: DataFrame, tokenizer_path: str, window: int = 1024, end_id: int = 0, piece: int = 256, group: int = 512) -> DataFrame:
    """Pieces of all documents with their sequence, their place in it and their ids (little-endian unsigned 32-bit)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        trim()  # a reused worker may hold what other stages have freed
        encoder = Encoder.of(tokenizer_path)
        end = np.array([end_id], "<u4").tobytes()
        sequence = TaskContext.get().partitionId() << 40
        held: list[tuple] = []
        out: list[tuple] = []

        def close(pieces: list[tuple]) -> None:
            nonlocal sequence
            if not pieces:
                return
            at = windows([p[2] for p in pieces], window)
            filled: dict[int, list[int]] = {}
            for p, w in zip(pieces, at.tolist(), strict=True):
                if w not in filled:
                    filled[w] = [sequence, 0]
                    sequence += 1
                out.append((*p[:4], *filled[w], p[4]))
                filled[w][1] += p[2]

        def batch() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True)) or [()] * 7
            types = [pa.int64()] * 6 + [pa.binary()]
            done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], [c.split()[0] for c in SCHEMA.split(", ")])
            out.clear()
            return done

        for whole in batches:
            for part in slices(whole):
                for doc, ids in zip(part.column(0).to_pylist(), encoder.encode(texts_of(part)), strict=True):
                    ids += end
                    n = len(ids) // 4
                    full = n - n % window
                    for a in range(0, full, window):
                        out.append((doc, a, window, n, sequence, 0, ids[4 * a : 4 * (a + window)]))
                        sequence += 1
                    # what is left, in pieces of nearly one size
                    count = -(-(n - full) // piece)
                    cuts = [full + (n - full) * i // count for i in range(count + 1)] if count else []
                    held += [(doc, a, b - a, n, ids[4 * a : 4 * b]) for a, b in zip(cuts, cuts[1:], strict=False)]
                while len(held) >= group:
                    close(held[:group])
                    del held[:group]
                yield batch()
        close(held)
        yield batch()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, SCHEMA)
