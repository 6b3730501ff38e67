"""Token-ID output: best-fit-decreasing packing into fixed-length id matrices.

Documents are encoded and collected, task by task, into blocks of bounded size.
In a block, an overlong document is split losslessly: its full lengths fill
sequences of their own, and the rest is packed like a short document.  Pieces
go, longest first, into the open sequence with the least room that still holds
them.  A segment tree over the possible rooms (0 .. length) finds it in
log2(length) steps, however many sequences are open.  No row is shuffled.

A row of the output is a sequence: a row of the id matrix in little-endian
binary, padded with ``pad_id``; the cumulative segment lengths, as attention
kernels for packed sequences take them; and the places where positions restart.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import ship

LENGTH = 2048
#: Tokens of the documents that are packed together, at least.
BLOCK_TOKENS = 1 << 22


class RoomTree:
    """Open bins by the room they have left."""

    def __init__(self, length: int):
        self.leaves = 1 << length.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.bins: list[list[int]] = [[] for _ in range(length + 1)]

    def add(self, room: int, bin_: int) -> None:
        self.bins[room].append(bin_)
        i = room + self.leaves
        while i:
            self.count[i] += 1
            i >>= 1

    def take(self, size: int) -> tuple[int, int] | None:
        """Removes and returns (room, bin) of the least room that is ``size`` or more."""
        i = size + self.leaves
        if not self.count[i]:
            while i > 1 and (i & 1 or not self.count[i + 1]):
                i >>= 1  # up, until a subtree of larger rooms holds a bin
            if i <= 1:
                return None
            i += 1
            while i < self.leaves:
                i = 2 * i if self.count[2 * i] else 2 * i + 1
        room = i - self.leaves
        bin_ = self.bins[room].pop()
        while i:
            self.count[i] -= 1
            i >>= 1
        return room, bin_


def best_fit_decreasing(sizes: list[int], length: int) -> list[list[int]]:
    """Bins of places in ``sizes`` (each 1 .. length); a bin's sizes sum to length at most."""
    tree, bins = RoomTree(length), []
    for place in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        found = tree.take(sizes[place])
        if found is None:
            room, b = length, len(bins)
            bins.append([])
        else:
            room, b = found
        bins[b].append(place)
        if room > sizes[place]:
            tree.add(room - sizes[place], b)
    return bins


OUT = "sequence_id long, n_tokens int, n_segments int, doc_ids array<long>, starts array<long>, cu_seqlens array<int>, position_resets array<int>, ids binary"


def _pack(path: str, end_id: int, pad_id: int, length: int, block_tokens: int):
    def run(batches):
        from pyspark import TaskContext

        task, encode, made = TaskContext.get().partitionId(), encoder(path), 0
        end = np.array([end_id], encode.dtype)

        def packed(docs: list[tuple[int, np.ndarray]]):
            nonlocal made
            pieces = [(d, at, ids[at : at + length]) for d, ids in docs for at in range(0, len(ids), length)]
            rows: dict[str, list] = {c.split()[0]: [] for c in OUT.split(", ")}
            for places in best_fit_decreasing([len(p[2]) for p in pieces], length):
                segments = [pieces[i] for i in places]
                ends = np.cumsum([len(s[2]) for s in segments]).tolist()
                matrix = np.full(length, pad_id, encode.dtype)
                matrix[: ends[-1]] = np.concatenate([s[2] for s in segments])
                values = ((task << 40) + made, ends[-1], len(segments), [s[0] for s in segments], [s[1] for s in segments], [0, *ends], [0, *ends[:-1]], matrix.tobytes())
                for c, v in zip(rows, values):
                    rows[c].append(v)
                made += 1
            ints = pa.list_(pa.int32())
            kinds = (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.list_(pa.int64()), ints, ints, pa.binary())
            return pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(rows.values(), kinds)], names=list(rows))

        held, tokens = [], 0
        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text")):
                ids = np.concatenate((encode(text.as_py()), end))
                held.append((doc, ids))
                tokens += len(ids)
                if tokens >= block_tokens:
                    yield packed(held)
                    held, tokens = [], 0
        if held:
            yield packed(held)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 1, pad_id: int = 0, length: int = LENGTH, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per packed sequence of the rows of ``docs`` (doc_id, text); see OUT.

    ``starts`` says for each segment which token of its document it begins with.
    Every document is followed by ``end_id``; a null or empty text is that token
    alone; rows that repeat are packed each; a null doc_id stays null.  An empty
    table gives an empty one; other columns are left out.
    """
    ship(docs.sparkSession)
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return base.mapInArrow(_pack(tokenizer, end_id, pad_id, length, block_tokens), OUT)


def write(sequences: DataFrame, path: str) -> None:
    """Writes sequences as Parquet shards, a row of the id matrix in each row."""
    sequences.write.option("compression", "zstd").parquet(path)


def matrix(rows: list, dtype: str = "<u2") -> tuple[np.ndarray, list[np.ndarray], np.ndarray]:
    """(ids, cu_seqlens, positions) of collected sequences, as a training step takes them."""
    ids = np.stack([np.frombuffer(r["ids"], dtype) for r in rows])
    positions = np.zeros(ids.shape, np.int32)
    for i, r in enumerate(rows):
        for a, b in zip(r["cu_seqlens"], r["cu_seqlens"][1:]):
            positions[i, a:b] = np.arange(b - a)
    return ids, [np.array(r["cu_seqlens"], np.int32) for r in rows], positions
