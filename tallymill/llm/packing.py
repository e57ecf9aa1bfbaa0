"""Best-fit-decreasing packing of token ids into windows.

A document is its ids and an end id. Documents over the window are first cut into full windows; what
is left of them, and the shorter documents, are packed by decreasing length, each into the tightest
open window that takes it. Open windows are found by a segment tree over the remaining capacity, in
a number of steps that depends on the window size only.

Each task packs what it has read, in groups of ``GROUP_IDS`` ids (some thousand windows), so nothing
is shuffled, memory is bounded, and a hot source or a huge text changes nothing. Sequence ids are
the task's number in the high bits and a count in the low ones; a task that is repeated gives the
same.

Rows returned, one per piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens,
sequence_id, offset, padded_length (2048, or the sequence's own length where that is a power of two).

Defined cases: a NULL or empty text is the end id alone; a repeated row is packed each time; a NULL
id stays NULL; other columns are not read; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallymill.llm import tokens

WINDOW = 2048
END_ID = 1
GROUP_IDS = 1 << 22
SLICE = 128


class Capacities:
    """How many open windows have each remaining capacity: a segment tree of counts."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.count = [0] * (2 * self.leaves)

    def add(self, capacity: int, by: int) -> None:
        node = capacity + self.leaves
        while node:
            self.count[node] += by
            node >>= 1

    def tightest(self, least: int) -> int:
        """The smallest capacity of an open window, ``least`` at the least; -1 if there is none."""
        count, node = self.count, least + self.leaves
        if count[node]:
            return least
        # up to the first right neighbour that has any, then down on the left
        while node > 1 and not (node % 2 == 0 and count[node + 1]):
            node >>= 1
        if node <= 1:
            return -1
        node += 1
        while node < self.leaves:
            node = 2 * node if count[2 * node] else 2 * node + 1
        return node - self.leaves


def best_fit(lengths: list[int], window: int) -> tuple[list[int], list[int], int]:
    """Window and offset of each piece (1 to window long), and how many windows there are."""
    of, offset, n = [0] * len(lengths), [0] * len(lengths), 0
    tree, open_at = Capacities(window), [[] for _ in range(window + 1)]
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        need = lengths[i]
        capacity = tree.tightest(need)
        if capacity < 0:
            capacity, w, n = window, n, n + 1
        else:
            tree.add(capacity, -1)
            w = open_at[capacity].pop()
        of[i], offset[i] = w, window - capacity
        if capacity > need:
            tree.add(capacity - need, 1)
            open_at[capacity - need].append(w)
    return of, offset, n


def _power_of_two(n: np.ndarray) -> np.ndarray:
    return (n & (n - 1)) == 0


def pack(df: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end_id: int = END_ID) -> DataFrame:
    """The pieces of all documents and their places, for the tokenizers file at ``path``."""
    rows = df.select(F.col(f"`{id_col}`").alias("doc_id"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    field = rows.schema["doc_id"].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(path)
        first = TaskContext.get().partitionId() << 40
        ids: list = []
        whole: list[bytes] = []
        size = 0
        kind = None

        def packed() -> pa.RecordBatch:
            nonlocal first
            doc, start, piece = [], [], []
            for k, x in enumerate(whole):
                for at in range(0, len(x), 4 * window):
                    doc.append(k)
                    start.append(at // 4)
                    piece.append(x[at : at + 4 * window])
            lengths = [len(p) // 4 for p in piece]
            of, offset, n = best_fit(lengths, window)
            filled = np.bincount(of, lengths, n).astype(np.int64)
            padded = np.where(_power_of_two(filled), filled, window)
            by_place = sorted(range(len(piece)), key=lambda i: (of[i], offset[i]))
            at = np.array(by_place)
            take = lambda values: pa.array(np.array(values, np.int64)[at])
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([ids[doc[i]] for i in by_place], kind),
                    take(start),
                    take(lengths),
                    pa.array([piece[i] for i in by_place], pa.binary()),
                    take([len(whole[k]) // 4 for k in doc]),
                    take(np.array(of, np.int64) + first),
                    take(offset),
                    take(padded[of]),
                ],
                ["doc_id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset", "padded_length"],
            )
            first += n
            ids.clear()
            whole.clear()
            return out

        for batch in batches:
            kind = batch.schema.field(0).type
            for begin in range(0, batch.num_rows, SLICE):
                part = batch.slice(begin, SLICE)
                ids += part.column(0).to_pylist()
                made = coder.encode(part.column(1).to_pylist())
                whole += [x + end for x in made]
                size += sum(map(len, made)) // 4 + len(made)
                if size >= GROUP_IDS:
                    yield packed()
                    size = 0
        if whole:
            yield packed()

    return rows.mapInArrow(
        run, f"doc_id {field}, start bigint, length bigint, ids binary, doc_tokens bigint, sequence_id bigint, offset bigint, padded_length bigint"
    )
