"""Mixture-controlled packing: deficit round-robin over source queues.

Every source is a queue of token ids: its documents one after the other.  A
window of ``window`` tokens visits all queues; each visit adds the source's
share of the window to its deficit and takes whole tokens from the queue up to
the deficit, whose fraction is carried into the next window.  A drained queue
leaves, and its share goes to the others by weight.  With shares equal to the
sources' sizes (the default) every window holds the corpus's own mixture and
all queues drain together.

The deficits have a closed form: after j windows of one set of live queues a
source has given floor(deficit + j * quantum) tokens.  So nothing runs window by
window.  The ids are made once and written with each document's place among its
source's documents of the same task; small sums per task and source turn that
into a place in the queue; and each document then finds its windows, sequences
and offsets by itself, whichever task holds it.  No shuffle moves the ids.

Windows follow each other without gaps, and sequences of ``length`` tokens are
cut from them.  The last tokens, fewer than ``length``, fall into sequences of
falling powers of two, so that nothing is padded.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bpe import encoder
from .shared import Scratch

LENGTH = 2048
#: Tokens of a window, as a multiple of a sequence's.
WINDOW_SEQUENCES = 64


@dataclass(frozen=True)
class _Epoch:
    """Windows from ``window`` on, while the same queues are live."""

    window: int
    served: tuple[int, ...]
    deficit: tuple[Fraction, ...]
    quantum: tuple[Fraction, ...]

    def given(self, s: int, j: int) -> int:
        return self.served[s] + int(self.deficit[s] + j * self.quantum[s])


class Schedule:
    """Which tokens of each queue stand in which window; sizes are tokens by source."""

    def __init__(self, sizes: list[int], weights: list[float] | None, window: int):
        self.sizes, self.total = sizes, sum(sizes)
        shares = [Fraction(w) for w in (weights if weights is not None else sizes)]
        self.epochs: list[_Epoch] = []
        served, deficit, at = [0] * len(sizes), [Fraction(0)] * len(sizes), 0
        while live := [s for s, n in enumerate(sizes) if served[s] < n]:
            if not any(shares[s] for s in live):  # what has no weight comes last, by size
                for s in live:
                    shares[s] = Fraction(sizes[s])
            whole = sum(shares[s] for s in live)
            quantum = [window * shares[s] / whole if s in set(live) else Fraction(0) for s in range(len(sizes))]
            self.epochs.append(_Epoch(at, tuple(served), tuple(deficit), tuple(quantum)))
            windows = min(-((deficit[s] - sizes[s] + served[s]) // quantum[s]) for s in live if quantum[s])
            now = self.epochs[-1]
            for s in live:
                exact = deficit[s] + windows * quantum[s]
                given = min(int(exact), sizes[s] - served[s])
                served[s], deficit[s] = now.served[s] + given, exact - int(exact)
            at += windows
        self._starts = [e.window for e in self.epochs]
        self._layouts: dict[int, tuple[list[int], list[int]]] = {}

    def before(self, s: int, w: int) -> int:
        """Tokens of queue s that stand before window w."""
        e = self.epochs[max(0, int(np.searchsorted(self._starts, w, "right")) - 1)]
        return min(self.sizes[s], e.given(s, w - e.window))

    def window_of(self, s: int, t: int) -> int:
        """The window of token t of queue s."""
        for i, e in enumerate(self.epochs):
            if e.quantum[s] and (i + 1 == len(self.epochs) or t < self.epochs[i + 1].served[s]):
                return e.window - ((e.deficit[s] - (t + 1 - e.served[s])) // e.quantum[s]) - 1
        raise ValueError("no such token")

    def layout(self, w: int) -> tuple[list[int], list[int]]:
        """By source: its tokens before window w, and where its part of w starts among all tokens."""
        if w not in self._layouts:
            if len(self._layouts) > 20_000:
                self._layouts.clear()
            low = [self.before(s, w) for s in range(len(self.sizes))]
            parts = np.array([self.before(s, w + 1) - low[s] for s in range(len(self.sizes))], dtype=object)
            self._layouts[w] = low, list(sum(low) + np.cumsum(parts) - parts)
        return self._layouts[w]


def sequence_at(place: int, total: int, length: int) -> tuple[int, int, int]:
    """(sequence, its first token, its end) for a token's place among ``total``."""
    full = total // length
    if place < full * length:
        n = place // length
        return n, n * length, (n + 1) * length
    n, first = full, full * length
    while True:
        end = first + (1 << ((total - first).bit_length() - 1))
        if place < end:
            return n, first, end
        n, first = n + 1, end


def _encode(path: str, end_id: int):
    def run(batches):
        from pyspark import TaskContext

        task, encode = TaskContext.get().partitionId(), encoder(path)
        end = np.array([end_id], encode.dtype)
        before: dict[str | None, int] = {}
        for batch in batches:
            sources, sizes, starts, ids = batch.column("source").to_pylist(), [], [], []
            for source, text in zip(sources, batch.column("text")):
                got = encode(text.as_py())
                start = before.get(source, 0)
                before[source] = start + len(got) + 1
                sizes.append(len(got) + 1)
                starts.append(start)
                ids.append(got.tobytes() + end.tobytes())
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("source"), pa.array([task] * len(ids), pa.int32()), pa.array(starts, pa.int64()), pa.array(sizes, pa.int64()), pa.array(ids, pa.binary())],
                names=["doc_id", "source", "task", "start", "n", "ids"],
            )

    return run


def _place(schedule: Schedule, width: int, length: int):
    def run(batches):
        ids_type = np.dtype(f"<u{width}")
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for doc, s, t0, n, ids in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "sid", "at", "n", "ids"))):
                ids, done = np.frombuffer(ids, ids_type), 0
                while done < n:
                    w = schedule.window_of(s, t0 + done)
                    low, first = schedule.layout(w)
                    place = first[s] + t0 + done - low[s]
                    left = min(n - done, schedule.before(s, w + 1) - t0 - done)
                    while left:
                        sequence, start, end = sequence_at(place, schedule.total, length)
                        size = min(left, end - place)
                        crc = zlib.crc32(ids[done : done + size].astype("<u4").tobytes())
                        for column, x in zip(out, (doc, done, size, crc, n, sequence, place - start)):
                            column.append(x)
                        done, place, left = done + size, place + size, left - size
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in out], names=[c.split()[0] for c in PIECE.split(", ")])

    return run


PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def pack(
    docs: DataFrame, tokenizer: str, end_id: int = 1, length: int = LENGTH, window: int | None = None, weights: dict | None = None
) -> DataFrame:
    """One row per piece of a document (doc_id, text, source), with its place in a sequence.

    ``tokenizer`` is the path of the vocabulary file on every machine, ``end_id``
    follows each document, ``weights`` maps sources to their share of a window
    (default: their tokens).  A null text is an empty one, which is its end
    token alone; a null source is a queue of its own, the last; rows that repeat
    are packed as often as they stand there; a null doc_id stays null.  An empty
    table gives an empty one; other columns are left out.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("source").cast("string").alias("source"), F.col("text").cast("string").alias("text"))
    coded = scratch.save(base.mapInArrow(_encode(tokenizer, end_id), "doc_id long, source string, task int, start long, n long, ids binary"))
    by_task = coded.groupBy("task", "source").agg(F.sum("n").alias("tokens"))
    so_far = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    by_task = scratch.save(by_task.withColumn("base", F.coalesce(F.sum("tokens").over(so_far), F.lit(0))))
    totals = by_task.groupBy("source").agg(F.sum("tokens").alias("tokens")).collect()  # a row per source
    totals = sorted(totals, key=lambda r: (r["source"] is None, (r["source"] or "").encode()))
    sizes = [r["tokens"] for r in totals]
    shares = None if weights is None else [float(weights.get(r["source"], 0)) for r in totals]
    schedule = Schedule(sizes, shares, window or WINDOW_SEQUENCES * length)
    sids = spark.createDataFrame([(r["source"], i) for i, r in enumerate(totals)], "name string, sid int")
    bases = scratch.save(by_task.join(sids, F.col("source").eqNullSafe(F.col("name"))).select("task", F.col("source").alias("name"), "sid", "base"))
    placed = coded.join(bases, (coded["task"] == bases["task"]) & coded["source"].eqNullSafe(bases["name"]))
    placed = placed.select("doc_id", "sid", (F.col("base") + F.col("start")).alias("at"), "n", "ids")
    width = encoder(tokenizer).dtype.itemsize
    return placed.mapInArrow(_place(schedule, width, length), PIECE)
