"""Harmonic packing of token sequences, each task on its own.

The capacity C has classes k = 1..`classes`; a bin of class k holds k pieces of at most C // k tokens.
A document gives whole pieces of C tokens, and its rest is cut into the largest class lengths that
fit; a rest that fills a slot up to `slack` of it isn't cut. Rests shorter than the last class are
packed uncut, C // length of them in a bin of their length. A bin is a sequence once it holds its
fixed number of pieces. What is left in open bins when a task ends is laid end to end, cut at the
capacity, so that a task has one unfilled sequence at most.

Tasks need no shuffle and no common state: a sequence id is (task << 32) | its number there.

Cases: null and empty texts are the end id alone; a very long text is read whole, in pieces; repeated
rows are packed each; an empty table gives no rows; columns other than id and text aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.staging import slices
from rookery.llm.tokens import END_ID, SLICE_BYTES, encoder, vocabulary

CAPACITY = 4096
CLASSES = 64
SLACK = 0.01


class Bins:
    """Open bins of one task; `out` gets (piece, sequence, offset) rows as sequences fill."""

    def __init__(self, capacity: int = CAPACITY, classes: int = CLASSES, slack: float = SLACK):
        self.capacity, self.classes, self.slack = capacity, classes, slack
        self.open: dict[tuple[str, int], list] = {}
        self.made = 0
        self.out: list[tuple] = []

    def _close(self, pieces: list) -> None:
        at = 0
        for p in pieces:
            self.out.append((p, self.made, at))
            at += len(p[2])
        self.made += 1

    def _put(self, kind: str, slots: int, piece: tuple) -> None:
        held = self.open.setdefault((kind, slots), [])
        held.append(piece)
        if len(held) == slots:
            self._close(self.open.pop((kind, slots)))

    def add(self, doc, ids: np.ndarray) -> None:
        """Cuts one document; a piece is (doc, start, ids, tokens of the document)."""
        c, n, at = self.capacity, len(ids), 0
        while n - at >= c:
            self._close([(doc, at, ids[at : at + c], n)])
            at += c
        while at < n:
            rest = n - at
            slots = c // rest  # so many pieces of this length fit
            if slots > self.classes:
                self._put("short", slots, (doc, at, ids[at:], n))
                return
            if rest >= (1 - self.slack) * (c // slots):
                self._put("class", slots, (doc, at, ids[at:], n))
                return
            slots = -(-c // rest)  # the largest class length that the rest fills
            if slots > self.classes:
                self._put("short", c // rest, (doc, at, ids[at:], n))
                return
            self._put("class", slots, (doc, at, ids[at : at + c // slots], n))
            at += c // slots

    def finish(self) -> None:
        """Pieces of bins that aren't full, end to end."""
        line, room = [], self.capacity
        for key in sorted(self.open):
            for doc, at, ids, n in self.open[key]:
                while len(ids):
                    part, ids = ids[:room], ids[room:]
                    line.append((doc, at, part, n))
                    at, room = at + len(part), room - len(part)
                    if not room:
                        self._close(line)
                        line, room = [], self.capacity
        if line:
            self._close(line)
        self.open.clear()


def pack(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", vocabulary_name: str = "word_bpe_49k.json",
    spaced: bool = False, end: int = END_ID, capacity: int = CAPACITY, with_ids: bool = True,
) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, ids."""

    def rows(task: int, done: list) -> pa.RecordBatch:
        pieces = [p for p, _, _ in done]
        cols = {
            "doc_id": pa.array([p[0] for p in pieces], pa.int64()),
            "start": pa.array([p[1] for p in pieces], pa.int64()),
            "length": pa.array([len(p[2]) for p in pieces], pa.int64()),
            "ids_crc32": pa.array([zlib.crc32(np.ascontiguousarray(p[2], "<u4")) for p in pieces], pa.int64()),
            "doc_tokens": pa.array([p[3] for p in pieces], pa.int64()),
            "sequence_id": pa.array([task << 32 | s for _, s, _ in done], pa.int64()),
            "offset": pa.array([o for _, _, o in done], pa.int64()),
        }
        if with_ids:
            cols["ids"] = pa.array([p[2].astype(np.int32) for p in pieces], pa.list_(pa.int32()))
        return pa.RecordBatch.from_pydict(cols)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bins, task = Bins(capacity), TaskContext.get().partitionId()
        coder = encoder(vocabulary(vocabulary_name), spaced, end)
        for batch in slices(batches, "t", SLICE_BYTES):
            ids, ends = coder.encode(batch.column("t"))
            for doc, own in zip(batch.column("d").to_pylist(), np.split(ids, ends[:-1])):
                bins.add(doc, own.copy())  # so that a waiting piece doesn't hold the whole batch
            if bins.out:
                yield rows(task, bins.out)
                bins.out = []
        bins.finish()
        if bins.out:
            yield rows(task, bins.out)

    schema = (
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"
        + ", ids array<int>" * with_ids
    )
    return docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).mapInArrow(run, schema)
