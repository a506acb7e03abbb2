"""Packed token-id matrices (operator 7).

Documents are encoded, split losslessly at the row length where they are longer, and packed by
best fit in decreasing order. A segment tree over remaining capacities finds the fullest row that still takes
a piece. Every task packs blocks of bounded size, so its memory doesn't depend on the table.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from netloom.llm import pieces
from netloom.llm.common import small_batches

#: Tokens that a task packs together.
BLOCK_TOKENS = 4 << 20


class Capacities:
    """Segment tree over remaining capacities 0..most: counts of open rows, and the rows themselves at the leaves."""

    def __init__(self, most: int) -> None:
        self.leaves = 1 << max(1, (most + 1 - 1).bit_length())
        if self.leaves <= most:
            self.leaves <<= 1
        self.counts = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        k = capacity + self.leaves
        while k:
            self.counts[k] += 1
            k >>= 1

    def take(self, least: int) -> tuple[int, int] | None:
        """(capacity, row) with the smallest capacity that is ``least`` or more; the row is taken out."""
        k = least + self.leaves
        counts = self.counts
        while not counts[k]:
            while k & 1:  # a right child: go up until there is a right sibling
                k >>= 1
            if not k:
                return None
            k += 1
            if k & (k - 1) == 0:  # wrapped past the last leaf of a level
                return None
        while k < self.leaves:
            k <<= 1
            k += not counts[k]
        capacity = k - self.leaves
        row = self.rows[capacity].pop()
        while k:
            counts[k] -= 1
            k >>= 1
        return capacity, row


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of piece numbers; every length is at most ``width``, and a row's sum too."""
    rows: list[list[int]] = []
    tree = Capacities(width)
    for piece in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        size = lengths[piece]
        if size == width:
            rows.append([piece])
            continue
        got = tree.take(size)
        if got is None:
            rows.append([piece])
            tree.add(width - size, len(rows) - 1)
        else:
            rows[got[1]].append(piece)
            tree.add(got[0] - size, got[1])
    return rows


SCHEMA = (
    "row_key string, n_tokens int, input_ids binary, cu_seqlens array<int>, position_ids binary, "
    "doc_ids array<long>, doc_starts array<long>"
)


def packed(docs: DataFrame, width: int = 2048, id_col: str = "doc_id", text_col: str = "text", model: str = pieces.DEFAULT_MODEL, pad: int = 0) -> DataFrame:
    """One row for each row of the packed matrices.

    ``input_ids`` and ``position_ids`` hold ``width`` little-endian unsigned integers (two bytes each, four for vocabularies over 65,536 or wider rows),
    padded with ``pad`` and 0; ``cu_seqlens`` the cumulative segment lengths from 0; positions restart at 0 in every segment. ``doc_ids`` and
    ``doc_starts`` tell each segment's document and the offset of its first token there, so that every document can be put together again.
    Null and empty texts have no tokens and no segment. A null id stays null in ``doc_ids``; repeated rows are packed each. Ties in length keep the order in which
    rows arrive. An empty table gives no row. Other columns are ignored.
    """
    small_batches(docs.sparkSession)
    source = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = pieces.load(model)
        kind = np.dtype("<u2" if len(enc.pieces) <= 1 << 16 and width <= 1 << 16 else "<u4")
        task = TaskContext.get()
        part, block = task.partitionId() if task else 0, 0
        held: list[tuple[np.ndarray, np.ndarray, list]] = []
        tokens = 0
        for batch in batches:
            ids, bounds = enc.encode(batch.column(1))
            held.append((ids.astype(kind), bounds, batch.column(0).to_pylist()))
            tokens += len(ids)
            if tokens >= BLOCK_TOKENS:
                yield from _block(held, width, kind, pad, f"{part}-{block}")
                held, tokens, block = [], 0, block + 1
        yield from _block(held, width, kind, pad, f"{part}-{block}")

    return source.mapInArrow(run, SCHEMA)


def _block(held: list[tuple[np.ndarray, np.ndarray, list]], width: int, kind: np.dtype, pad: int, key: str) -> Iterator[pa.RecordBatch]:
    doc_ids, first, size, inside = [], [], [], []
    base = 0
    for ids, bounds, names in held:
        for name, a, b in zip(names, bounds[:-1].tolist(), bounds[1:].tolist()):
            for at in range(a, b, width):
                doc_ids.append(name)
                first.append(base + at)
                inside.append(at - a)
                size.append(min(width, b - at))
        base += len(ids)
    if not size:
        return
    flat = np.concatenate([h[0] for h in held])
    rows = best_fit(size, width)
    for some in range(0, len(rows), 512):
        part = rows[some : some + 512]
        matrix = np.full((len(part), width), pad, kind)
        places = np.zeros((len(part), width), kind)
        cuts = []
        for k, row in enumerate(part):
            at = 0
            cut = [0]
            for p in row:
                n = size[p]
                matrix[k, at : at + n] = flat[first[p] : first[p] + n]
                places[k, at : at + n] = np.arange(n)
                at += n
                cut.append(at)
            cuts.append(cut)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([f"{key}-{some + k}" for k in range(len(part))]),
                pa.array([c[-1] for c in cuts], pa.int32()),
                pa.array([m.tobytes() for m in matrix], pa.binary()),
                pa.array(cuts, pa.list_(pa.int32())),
                pa.array([m.tobytes() for m in places], pa.binary()),
                pa.array([[doc_ids[p] for p in row] for row in part], pa.list_(pa.int64())),
                pa.array([[inside[p] for p in row] for row in part], pa.list_(pa.int64())),
            ],
            ["row_key", "n_tokens", "input_ids", "cu_seqlens", "position_ids", "doc_ids", "doc_starts"],
        )


def write(rows: DataFrame, path: str) -> None:
    """Writes packed rows as Parquet with binary columns; any folder that Spark can write."""
    rows.write.mode("errorifexists").parquet(path)
