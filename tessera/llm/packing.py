"""Packing documents into sequences of a fixed number of tokens.

A document's tokens and an end token are cut into whole windows, which are sequences by
themselves, and a rest.  Rests are placed online by the sum-of-squares rule: of all levels
with an open window that has room, and a new window, the rest goes to the one that leaves the
least sum of squared counts of open windows by fill level (ties: the fullest window).  The
counts are one array of ``capacity`` + 1 levels.  Where more than ``MOST_OPEN`` windows are
open (rests of one size that never add up, say), and at the end of a task, open windows are
filled up with cut pieces of the emptiest ones.  What is then left of a task is less than one
window; it becomes sequences of powers of two, which need no padding.

It runs as one Arrow batch function over the scan: no shuffle, and a task holds a batch and
its open windows, at most ``MOST_OPEN`` times ``capacity`` ids.  Each task packs its own
documents, so sequences do not cross tasks; their ids hold the task's number.  A lost task
packs the same rows again alike, if its input is a stored table.

Cases: null text counts as empty, so it is an end token alone; texts of any length are cut
into whole windows; a null or repeated id is an id like any other; an empty table gives an
empty table; only id and text are read, so clashing extra columns do no harm.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from tessera.llm import bpe

CAPACITY = 2048
END = 1
MOST_OPEN = 4096
#: Pieces of a batch that is handed on.
_OUT = 4096

Piece = tuple[int | None, int, np.ndarray, int]
Placed = tuple[int | None, int, np.ndarray, int, int, int]


class Packer:
    """Windows of one task.  A piece is (document, its start there, ids, tokens of the document)."""

    def __init__(self, capacity: int = CAPACITY, first: int = 0, most_open: int = MOST_OPEN):
        self.capacity, self.next, self.most_open = capacity, first, most_open
        self.counts = np.zeros(capacity + 1, dtype=np.int64)
        self.windows: dict[int, list[list[Piece]]] = defaultdict(list)
        self.opened = 0

    def level(self, size: int) -> int:
        """The fill level to which a piece goes; 0 is a new window."""
        n, top = self.counts, self.capacity - size
        rise = 2 * (n[size : self.capacity + 1] - n[: top + 1]) + 2
        rise[n[: top + 1] == 0] = np.iinfo(np.int64).max
        if n[top]:
            rise[top] = 1 - 2 * n[top]
        rise[0] = 2 * n[size] + 1
        return top - int(rise[::-1].argmin())

    def add(self, doc: int | None, ids: np.ndarray) -> Iterator[Placed]:
        total, at = len(ids), 0
        while total - at >= self.capacity:
            yield from self.close([(doc, at, ids[at : at + self.capacity], total)])
            at += self.capacity
        if at < total:
            yield from self.place((doc, at, ids[at:].copy(), total))

    def place(self, piece: Piece) -> Iterator[Placed]:
        size = len(piece[2])
        at = self.level(size)
        window = self.windows[at].pop() if at else []
        self.counts[at] -= at > 0
        self.opened += at == 0
        window.append(piece)
        if at + size == self.capacity:
            self.opened -= 1
            yield from self.close(window)
        else:
            self.windows[at + size].append(window)
            self.counts[at + size] += 1
            if self.opened > self.most_open:
                rest = yield from self.fill_up()
                if rest:
                    full = sum(len(p[2]) for p in rest)
                    self.windows[full].append(rest)
                    self.counts[full] += 1
                    self.opened += 1

    def close(self, window: list[Piece]) -> Iterator[Placed]:
        offset = 0
        for doc, start, ids, total in window:
            yield doc, start, ids, total, self.next, offset
            offset += len(ids)
        self.next += 1

    def fill_up(self) -> Iterator[Placed]:
        """Close all open windows but one, which is returned, by cutting up the emptiest."""
        queue = [w for at in sorted(self.windows, reverse=True) for w in self.windows[at]]
        self.windows.clear()
        self.counts[:] = 0
        self.opened = 0
        at = 0
        while at < len(queue) - 1:
            window = queue[at]
            room = self.capacity - sum(len(p[2]) for p in window)
            while room and at < len(queue) - 1:
                doc, start, ids, total = queue[-1].pop()
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    queue[-1].append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
                if not queue[-1]:
                    queue.pop()
            if room:
                break
            yield from self.close(window)
            at += 1
        return queue[at] if at < len(queue) else None

    def finish(self) -> Iterator[Placed]:
        rest = yield from self.fill_up()
        pieces = rest[::-1] if rest else []
        while left := sum(len(p[2]) for p in pieces):
            room, window = 1 << (left.bit_length() - 1), []
            while room:
                doc, start, ids, total = pieces.pop()
                window.append((doc, start, ids[:room], total))
                if len(ids) > room:
                    pieces.append((doc, start + room, ids[room:], total))
                room -= min(room, len(ids))
            yield from self.close(window)


def _batch(rows: list[Placed], names: list[str], doc_type: pa.DataType) -> pa.RecordBatch:
    docs, starts, ids, totals, sequences, offsets = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(docs, doc_type), pa.array(starts, pa.int64()), pa.array([len(x) for x in ids], pa.int64()), pa.array([x.tobytes() for x in ids], pa.binary()), *(pa.array(x, pa.int64()) for x in (totals, sequences, offsets))], names=names
    )


def pack(df: DataFrame, spec: str, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, end: int = END, most_open: int = MOST_OPEN) -> DataFrame:
    """Pieces as doc_id, start, length, token_ids (packed), doc_tokens, sequence_id, offset."""
    held = df.sparkSession.sparkContext.broadcast(spec)
    source = df.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    names = ["doc_id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"]
    stop = np.array([end], dtype="<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, packer = bpe.loaded(held.value), Packer(capacity, TaskContext.get().partitionId() << 40, most_open)
        rows: list[Placed] = []
        for whole in batches:
            for b in bpe.slices(whole, "text"):
                coded = coder.encode_many([t or "" for t in b.column("text").to_pylist()])
                for doc, ids in zip(b.column("doc_id").to_pylist(), coded):
                    rows.extend(packer.add(doc, np.frombuffer(ids + stop, dtype="<u4")))
                    if len(rows) >= _OUT:
                        yield _batch(rows, names, pa.int64())
                        rows = []
        rows.extend(packer.finish())
        if rows:
            yield _batch(rows, names, pa.int64())

    return source.mapInArrow(run, "doc_id long, start long, length long, token_ids binary, doc_tokens long, sequence_id long, offset long")


def layout(pieces: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """sequence_id, filled and padding: a sequence is padded to ``capacity``, unless it holds a power of two."""
    filled = F.col("filled")
    return pieces.groupBy("sequence_id").agg(F.sum("length").alias("filled")).withColumn("padding", F.when(filled.bitwiseAND(filled - 1) == 0, 0).otherwise(capacity - filled))
