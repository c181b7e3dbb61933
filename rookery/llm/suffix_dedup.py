"""Repeated byte strings across documents: difference-cover blockwise suffix sorting.

Each byte covered by a string of `length` bytes that also starts in a document with a smaller id is
removed; strings are judged on the input. Documents are kept in slabs of about `slab_bytes`, written
once. A window of `length` bytes belongs to the gram of `GRAM` bytes in it with the least hash (its
anchor); neighbouring windows with one anchor form a run of at most 2 * length - GRAM bytes. Equal
windows have equal anchors, so only runs of one anchor have to be compared.

1. Equal runs are one: slabs send one entry per different run (anchor, digest, smallest document) to
   the anchor's bucket. The bucket knows each run's smallest document; all other documents lose that run
   whole. Anchors that have several runs and several documents have to be sorted; only the smallest
   document of each of their runs takes part.
2. These runs are laid end to end in blocks of whole anchors, and the suffixes that start windows are
   sorted: ranks of a difference-cover sample (mod `PERIOD`) by prefix doubling first, then one suffix
   bucket at a time, by its first 8 bytes and, for longer ties, by the ranks at the shift where two
   suffixes are both in the sample. Neighbours in the order that share `length` bytes are equal
   windows; each but those of the smallest document is removed.
3. Verdicts return to the slabs, windows turn into removed bytes, and what is left is joined.

An anchor with more than `HOT` runs is split by the bytes before it (windows that begin well before
the anchor) and by those after it (the others), so that none has all its runs in one block. Runs are
matched by 64-bit digests within one anchor; everything sorted is compared byte by byte.

Bounds: a task holds one slab, one bucket's entries (about `bucket_bytes` of text gives one bucket) or
one block; sorting holds one suffix bucket. The driver holds one number, the bytes of all texts.

Cases: null text is empty; texts shorter than `length` lose nothing; a null id is larger than all
others; rows that share an id don't remove each other's bytes; repeated rows under several ids leave
the first; a very long text is a slab of its own, read in chunks; an empty table gives no rows; other
columns aren't read. Cutting may split characters, so what is kept is binary.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.staging import buffer_of, release, slices, stage, utf8

LENGTH, GRAM = 50, 20
SLAB_BYTES, BUCKET_BYTES, BLOCK_BYTES = 4 << 20, 8 << 20, 2 << 20
TASK_BYTES, MOST_TASKS = 8 << 20, 20_000  # of text behind one task of a shuffle; a task's rows are one Arrow batch
HOT = 50_000
PERIOD, COVER = 7, (0, 1, 3)  # every difference modulo 7 occurs in the cover
SUFFIXES = 1 << 18  # suffixes sorted at a time
_CHUNK = 1 << 15
_NO_ID = np.iinfo(np.int64).max
_ANCHOR_BYTES = 5

_random = np.random.default_rng(20240712)
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_STEP = int(_random.integers(0, 2**63)) * 2 + 1
_MULTIPLY = _random.integers(0, 2**64, 4, np.uint64) | np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MULTIPLY[0]
    x ^= x >> np.uint64(29)
    x *= _MULTIPLY[1]
    return x ^ (x >> np.uint64(32))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = (_powers(b, _CHUNK + 512) for b in (_STEP, pow(_STEP, -1, 2**64)))


def runs(data: np.ndarray, offsets: np.ndarray, length: int) -> dict[str, np.ndarray]:
    """Runs of the windows of all texts: start, n (windows), doc (which text), at (of the anchor), anchor, digest."""
    out: dict[str, list] = {k: [] for k in ("start", "n", "doc", "at", "anchor", "digest")}
    span = length - GRAM + 1
    for begin in range(0, max(len(data) - length + 1, 0), _CHUNK):
        own = data[begin : begin + _CHUNK + length - 1]
        sums = np.zeros(len(own) + 1, np.uint64)
        np.cumsum(_BYTE[own] * _UP[: len(own)], dtype=np.uint64, out=sums[1:])
        grams = _mixed((sums[GRAM:] - sums[:-GRAM]) * _DOWN[: len(own) - GRAM + 1])
        # the least hash and, of equal ones, the first
        least, width = (grams & ~np.uint64(0xFFFF)) | np.arange(len(grams), dtype=np.uint64), 1
        while width < span:
            step = min(width, span - width)
            least, width = np.minimum(least[:-step], least[step:]), width + step
        at = (least & np.uint64(0xFFFF)).astype(np.int64)
        # windows that lie inside one text
        stops = np.searchsorted(offsets, [begin, begin + len(own)], "right")
        inside = np.zeros(len(at) + 1, np.int64)
        for i in range(stops[0] - 1, min(stops[1], len(offsets) - 1)):
            a, b = max(offsets[i] - begin, 0), min(offsets[i + 1] - begin - length + 1, len(at))
            if a < b:
                inside[a] += 1
                inside[b] -= 1
        inside = np.cumsum(inside[:-1]) > 0
        first = np.empty(len(at), bool)
        first[0], first[1:] = True, (at[1:] != at[:-1]) | ~inside[:-1]
        edge = offsets[(offsets > begin) & (offsets < begin + len(at))] - begin
        first[edge] = True
        start = np.flatnonzero(first & inside)
        if not len(start):
            continue
        stop = np.minimum(np.append(start[1:], len(at)), np.searchsorted(np.cumsum(~inside), np.cumsum(~inside)[start], "right"))
        end = stop + length - 1
        digest = (sums[end] - sums[start]) * _DOWN[start] + (end - start).astype(np.uint64) * _MULTIPLY[2]
        out["start"].append(begin + start)
        out["n"].append(stop - start)
        out["doc"].append(np.searchsorted(offsets, begin + start, "right") - 1)
        out["at"].append(begin + at[start])
        out["anchor"].append(grams[at[start]])
        out["digest"].append(_mixed(digest ^ (at[start] - start).astype(np.uint64) * _MULTIPLY[3]))
    kinds = {"anchor": np.uint64, "digest": np.uint64}
    return {k: np.concatenate(v) if v else np.empty(0, kinds.get(k, np.int64)) for k, v in out.items()}


class Slab:
    """The texts of one slab in order of their ids, their runs, and which different run each of them is."""

    def __init__(self, docs: np.ndarray, sizes: np.ndarray, text: np.ndarray, length: int, buckets: int):
        self.docs, self.text, self.length = docs, text, length
        self.offsets = np.concatenate(([0], np.cumsum(sizes)))
        self.runs = runs(text, self.offsets, length)
        anchor, digest = self.runs["anchor"], self.runs["digest"]
        order = np.argsort(anchor * _MULTIPLY[3] + digest, kind="stable")
        new = np.ones(len(order), bool)
        new[1:] = (anchor[order][1:] != anchor[order][:-1]) | (digest[order][1:] != digest[order][:-1])
        number = np.cumsum(new) - 1
        #: first run of each kind; the order is stable, so it is the one of the smallest document
        self.kinds = order[new]
        self.kind = np.empty(len(order), np.int64)
        self.kind[order] = number
        # anchors are least hashes, so most are small: hashed again, all buckets get about the same
        self.bucket = ((_mixed(anchor[self.kinds]) >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64)
        self.by_bucket = np.argsort(self.bucket, kind="stable")
        self.edges = np.searchsorted(self.bucket[self.by_bucket], np.arange(buckets + 1))

    @classmethod
    def of(cls, row: dict, length: int, buckets: int) -> Slab:
        sizes = np.frombuffer(row["sizes"], np.int64)
        text = np.frombuffer(zstandard.ZstdDecompressor().decompress(row["text"], max_output_size=max(int(sizes.sum()), 1)), np.uint8)
        return cls(np.frombuffer(row["docs"], np.int64), sizes, text, length, buckets)

    def doc_of(self, run: np.ndarray) -> np.ndarray:
        return self.docs[self.runs["doc"][run]]

    def entries(self) -> Iterator[tuple[int, bytes]]:
        """(bucket, anchors, digests and documents of its different runs)."""
        anchor = self.runs["anchor"][self.kinds].astype("<u8").view(np.uint8).reshape(-1, 8)[:, :_ANCHOR_BYTES]
        digest, doc = self.runs["digest"][self.kinds], self.doc_of(self.kinds)
        for b in np.unique(self.bucket):
            own = self.by_bucket[self.edges[b] : self.edges[b + 1]]
            ids, place = np.unique(doc[own], return_inverse=True)
            head = np.array([len(own), len(ids)], np.int64)
            yield int(b), b"".join(x.tobytes() for x in (head, ids, place.astype(np.uint32), digest[own], anchor[own]))

    def verdicts(self, replies: list[tuple[int, bytes]]) -> np.ndarray:
        """The bucket's verdict on each kind of run."""
        out = np.zeros(len(self.kinds), np.uint8)
        for b, flags in replies:
            out[self.by_bucket[self.edges[b] : self.edges[b + 1]]] = np.frombuffer(flags, np.uint8)
        return out


#: A bucket's verdicts on a run: alone; its smallest document is elsewhere; to be sorted; the same, at a hot anchor.
ALONE, ELSEWHERE, SORT, SORT_HOT = range(4)


def judge(blobs: list[bytes], hot: int = HOT) -> list[bytes]:
    """The verdicts on the entries that slabs sent to one bucket."""
    anchors, digests, docs, sizes = [], [], [], []
    for blob in blobs:
        n, ids = np.frombuffer(blob, np.int64, 2)
        at = 16 + 8 * ids
        docs.append(np.frombuffer(blob, np.int64, ids, 16)[np.frombuffer(blob, np.uint32, n, at)])
        digests.append(np.frombuffer(blob, np.uint64, n, at + 4 * n))
        wide = np.zeros((n, 8), np.uint8)
        wide[:, :_ANCHOR_BYTES] = np.frombuffer(blob, np.uint8, n * _ANCHOR_BYTES, at + 12 * n).reshape(n, -1)
        anchors.append(wide.view("<u8").ravel())
        sizes.append(n)
    anchor, digest, doc = map(np.concatenate, (anchors, digests, docs))
    flags = np.zeros(len(anchor), np.uint8)
    order = np.argsort(anchor)
    same = anchor[order][1:] == anchor[order][:-1]
    shared = np.zeros(len(order), bool)
    shared[1:] |= same
    shared[:-1] |= same
    own = order[shared]  # entries of anchors that several slabs or several runs have
    if len(own):
        own = own[np.lexsort((doc[own], digest[own], anchor[own]))]
        new_a = np.ones(len(own), bool)
        new_a[1:] = anchor[own][1:] != anchor[own][:-1]
        new_d = new_a.copy()
        new_d[1:] |= digest[own][1:] != digest[own][:-1]
        group, run = np.cumsum(new_a) - 1, np.cumsum(new_d) - 1
        least = doc[own][new_d][run]
        starts = np.flatnonzero(new_a)
        kinds = np.add.reduceat(new_d.astype(np.int64), starts)
        several = (kinds > 1) & (np.minimum.reduceat(doc[own], starts) != np.maximum.reduceat(doc[own], starts))
        sort = np.where(kinds > hot, SORT_HOT, SORT) * several
        flags[own] = np.where(doc[own] > least, ELSEWHERE, sort[group])
    return [f.tobytes() for f in np.split(flags, np.cumsum(sizes)[:-1])]


def _eights(text: np.ndarray) -> np.ndarray:
    """The 8 bytes from each place on, first byte highest; zero bytes follow the text."""
    padded = np.concatenate((text, np.zeros(8, np.uint8)))
    out = np.zeros(len(text), np.uint64)
    for k in range(8):
        out <<= np.uint64(8)
        out |= padded[k : k + len(text)]
    return out


def cover_ranks(eights: np.ndarray, depth: int) -> np.ndarray:
    """Ranks (from 1) of the sampled suffixes by their first `depth` bytes or more, at their places; 0 elsewhere."""
    n = len(eights)
    ranks = np.zeros(n + 2 * depth + PERIOD, np.int32)  # a block is far below 2^31 bytes
    places = np.sort(np.concatenate([np.arange(r, n, PERIOD, dtype=np.int32) for r in COVER]))

    def number(keys: np.ndarray) -> np.ndarray:
        order = np.argsort(keys)
        ordered = keys[order]
        new = np.ones(len(keys), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        out = np.empty(len(keys), np.int32)
        out[order] = np.cumsum(new)
        return out

    ranks[places], known = number(eights[places] >> np.uint64(8)), PERIOD
    while known < depth:  # place + known is sampled too: known is a multiple of PERIOD
        ranks[places] = number(ranks[places] * np.int64(len(places) + 1) + ranks[places + known])
        known *= 2
    return ranks


_SHIFT = np.array([[next(d for d in range(PERIOD) if (r + d) % PERIOD in COVER and (s + d) % PERIOD in COVER) for s in range(PERIOD)] for r in range(PERIOD)])


def _sorted_bucket(places: np.ndarray, eights: np.ndarray, ranks: np.ndarray) -> np.ndarray:
    """The suffixes at `places` in order: 8 bytes first, ties by cover ranks."""
    places = places[np.argsort(eights[places], kind="stable")]
    head = eights[places]
    new = np.ones(len(places), bool)
    new[1:] = head[1:] != head[:-1]
    group = np.cumsum(new) - 1
    tied = np.bincount(group)[group] > 1
    if not tied.any():
        return places
    own, tie = places[tied], group[tied]
    kind, top = own % PERIOD, int(ranks.max()) + 1
    parts = [np.flatnonzero(kind == r) for r in range(PERIOD)]
    smaller = np.zeros(len(own), np.int64)  # suffixes of the tie that are smaller
    for s, theirs in enumerate(parts):
        for shift in np.unique(_SHIFT[:, s]) if len(theirs) else ():
            line = np.sort(tie[theirs] * top + ranks[own[theirs] + shift])
            for r in np.flatnonzero(_SHIFT[:, s] == shift):
                mine = parts[r]
                base = tie[mine] * top
                smaller[mine] += np.searchsorted(line, base + ranks[own[mine] + shift]) - np.searchsorted(line, base)
    places[tied] = own[np.lexsort((smaller, tie))]
    return places


def repeated_windows(text: np.ndarray, places: np.ndarray, doc: np.ndarray, length: int, suffixes: int = SUFFIXES) -> np.ndarray:
    """Which windows (at `places`, of document `doc`) also start in a smaller document of this block."""
    eights = _eights(text)
    ranks = cover_ranks(eights, length + PERIOD)
    eights.resize(len(text) + length, refcheck=False)  # in place, with zeros
    out = np.zeros(len(places), bool)
    head = eights[places]
    cuts = np.unique(np.sort(head[:: max(1, len(head) >> 12)])[:: max(1, min(len(head), 4096) * suffixes // max(len(head), 1))][1:])
    bucket = np.searchsorted(cuts, head, "right")
    by = np.argsort(bucket, kind="stable")
    edges = np.searchsorted(bucket[by], np.arange(len(cuts) + 2))
    index = np.zeros(len(text) + 1, np.int32)
    index[places] = np.arange(len(places), dtype=np.int32)
    steps = sorted({*range(0, length - 7, 8), length - 8})
    for a, b in zip(edges[:-1], edges[1:]):
        if b - a < 2:
            continue
        own = _sorted_bucket(places[by[a:b]], eights, ranks)
        new = np.zeros(len(own), bool)
        new[0] = True
        for k in steps:
            new[1:] |= eights[own[1:] + k] != eights[own[:-1] + k]
        at = index[own]
        least = np.minimum.reduceat(doc[at], np.flatnonzero(new))
        out[at] = doc[at] > least[np.cumsum(new) - 1]
    return out


def _slabs(docs: DataFrame, slab_bytes: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        task, made = TaskContext.get().partitionId(), 0
        coder = zstandard.ZstdCompressor(level=3)
        ids: list[np.ndarray] = []
        texts: list[bytes] = []
        held = 0

        def flush() -> pa.RecordBatch:
            nonlocal ids, texts, held, made
            d = np.concatenate(ids)
            order = np.argsort(d, kind="stable")
            joined = b"".join(texts[i] for i in order)
            sizes = np.array([len(texts[i]) for i in order], np.int64)
            row = {"slab": [task << 32 | made], "size": [len(joined)], "docs": [d[order].tobytes()], "sizes": [sizes.tobytes()],
                   "text": [coder.compress(joined)]}
            ids, texts, held, made = [], [], 0, made + 1
            return pa.RecordBatch.from_pydict(row, _SLAB)

        for batch in slices(batches, "t", slab_bytes):
            own = utf8(batch.column("t")).to_pylist()
            size = sum(map(len, own))
            if held and held + size > slab_bytes:
                yield flush()
            ids.append(pc.fill_null(batch.column("d"), _NO_ID).to_numpy())
            texts += own
            held += size
        if ids:
            yield flush()

    return docs.mapInArrow(run, "slab long, size long, docs binary, sizes binary, text binary")


_SLAB = pa.schema([("slab", pa.int64()), ("size", pa.int64()), ("docs", pa.binary()), ("sizes", pa.binary()), ("text", pa.binary())])


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[dict]:
    """Row by row: a batch may hold many slabs."""
    for batch in batches:
        for i in range(batch.num_rows):
            yield batch.slice(i, 1).to_pylist()[0]


def _entries(slabs: DataFrame, length: int, buckets: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for row in _rows(batches):
            found = list(Slab.of(row, length, buckets).entries())
            yield pa.RecordBatch.from_pydict(
                {"bucket": pa.array([b for b, _ in found], pa.int64()), "slab": pa.array([row["slab"]] * len(found), pa.int64()),
                 "entries": pa.array([e for _, e in found], pa.binary())}
            )
            del found, row
        release()

    return slabs.mapInArrow(run, "bucket long, slab long, entries binary")


def _dealt(entries: DataFrame, tasks: int) -> DataFrame:
    """Whole buckets in `tasks` partitions, their numbers at most one apart; buckets are about equal, hashes would pile some up."""
    place = F.pmod(F.col("bucket"), F.lit(tasks)).cast("int")
    return entries.repartitionById(tasks, place).sortWithinPartitions("bucket")


def _judged(entries: DataFrame, hot: int, tasks: int) -> DataFrame:
    """(slab, bucket, verdicts) of every bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        now, slabs, blobs = None, [], []

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_pydict(
                {"slab": pa.array(slabs, pa.int64()), "bucket": pa.array([now] * len(slabs), pa.int64()),
                 "verdicts": pa.array(judge(blobs, hot), pa.binary())}
            )

        for row in _rows(batches):
            if row["bucket"] != now and slabs:
                yield flush()
                slabs, blobs = [], []
            now = row["bucket"]
            slabs.append(row["slab"])
            blobs.append(row["entries"])
        if slabs:
            yield flush()
            slabs, blobs, row = [], [], None
        release()

    return _dealt(entries, tasks).mapInArrow(run, "slab long, bucket long, verdicts binary")


_EMPTY = "cast(null as binary)"


def _with_slabs(slabs: DataFrame, replies: list[DataFrame], tasks: int) -> DataFrame:
    """Replies and slabs by slab, the slab's own row last; kind 0: verdicts of a bucket, 1: repeated windows, 2: the slab."""
    rows = slabs.selectExpr("slab", "2 as kind", "0L as bucket", f"{_EMPTY} as verdicts", "docs", "sizes", "text")
    for r in replies:
        rows = rows.unionByName(r.selectExpr("slab", "kind", "bucket", "verdicts", f"{_EMPTY} as docs", f"{_EMPTY} as sizes", f"{_EMPTY} as text"))
    return rows.repartition(tasks, "slab").sortWithinPartitions("slab", "kind")


def _each_slab(batches: Iterator[pa.RecordBatch], length: int, buckets: int) -> Iterator[tuple[int, Slab, np.ndarray, list[bytes]]]:
    """(slab, texts, verdicts, repeated windows) of each slab."""
    replies, found = [], []
    for row in _rows(batches):
        if row["kind"] == 0:
            replies.append((row["bucket"], row["verdicts"]))
        elif row["kind"] == 1:
            found.append(row["verdicts"])
        else:
            own = Slab.of(row, length, buckets)
            yield row["slab"], own, own.verdicts(replies), found
            replies, found = [], []


def _wanted(slabs: DataFrame, judged: DataFrame, length: int, buckets: int, tasks: int) -> DataFrame:
    """(key, doc, slab, kind, first, n, body) of the runs to be sorted: n windows from window `first` of the run on."""
    half = (length - GRAM) // 2

    def parts(own: Slab, kinds: np.ndarray, hot: bool) -> Iterator[tuple]:
        run = own.kinds[kinds]
        start, n, at, anchor = (own.runs[k][run] for k in ("start", "n", "at", "anchor"))
        doc = own.doc_of(run)
        before = np.clip(at - half - start + 1, 0, n) if hot else n  # windows with more than half before the anchor, or all
        for first, count, side in ((np.zeros_like(n), before, -half), (before, n - before, GRAM)) if hot else ((np.zeros_like(n), n, None),):
            for i in np.flatnonzero(count > 0):
                a = start[i] + first[i]
                key = int(anchor[i].astype(np.int64))
                if side is not None:
                    key = _side_key(key, own.text[at[i] + side : at[i] + side + half], side)
                yield key, int(doc[i]), int(kinds[i]), int(first[i]), int(count[i]), own.text[a : a + count[i] + length - 1].tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for slab, own, verdicts, _ in _each_slab(batches, length, buckets):
            rows = [r for v in (SORT, SORT_HOT) for r in parts(own, np.flatnonzero(verdicts == v), v == SORT_HOT)]
            if rows:
                key, doc, kind, first, n, body = zip(*rows)
                yield pa.RecordBatch.from_pydict(
                    {"key": pa.array(key, pa.int64()), "doc": pa.array(doc, pa.int64()), "slab": pa.array([slab] * len(rows), pa.int64()),
                     "kind": pa.array(kind, pa.int32()), "first": pa.array(first, pa.int32()), "n": pa.array(n, pa.int32()),
                     "body": pa.array(body, pa.binary())}
                )
                del rows, key, doc, kind, first, n, body
        release()

    return _with_slabs(slabs, [judged], tasks).mapInArrow(run, "key long, doc long, slab long, kind int, first int, n int, body binary")


def _side_key(anchor: int, beside: np.ndarray, side: int) -> int:
    """A key of an anchor with the bytes at one side of it."""
    parts = np.concatenate((_BYTE[beside] * _UP[: len(beside)], np.array([anchor % 2**64, side % 2**64], np.uint64)))
    return int(_mixed(np.array([np.sum(parts, dtype=np.uint64)]))[0].astype(np.int64))


def _sorted_blocks(wanted: DataFrame, length: int, block_bytes: int) -> DataFrame:
    """(slab, windows): kinds of runs and the ranges of their windows that a smaller document has."""

    def found(rows: pa.Table) -> pa.RecordBatch:
        body, ends = buffer_of(utf8(rows["body"]))
        text = body[ends[0] : ends[-1]]
        n, first = rows["n"].to_numpy().astype(np.int64), rows["first"].to_numpy()
        owner = np.repeat(np.arange(len(n)), n)
        nth = np.arange(len(owner)) - np.repeat(np.cumsum(n) - n, n)
        repeated = repeated_windows(text, (ends[:-1] - ends[0])[owner] + nth, rows["doc"].to_numpy()[owner], length)
        # ranges of repeated windows within one run
        begin = repeated.copy()
        begin[1:] &= ~repeated[:-1] | (owner[1:] != owner[:-1])
        stop = repeated.copy()
        stop[:-1] &= ~repeated[1:] | (owner[1:] != owner[:-1])
        b, e = np.flatnonzero(begin), np.flatnonzero(stop)
        packed = np.stack([rows["kind"].to_numpy()[owner[b]], first[owner[b]] + nth[b], first[owner[e]] + nth[e] + 1], 1).astype(np.int32)
        slab = rows["slab"].to_numpy()[owner[b]]
        order = np.argsort(slab, kind="stable")
        cuts = np.flatnonzero(np.diff(slab[order])) + 1
        heads = slab[order][np.concatenate(([0], cuts))] if len(b) else slab
        return pa.RecordBatch.from_pydict(
            {"slab": pa.array(heads, pa.int64()),
             "windows": pa.array([x.tobytes() for x in np.split(packed[order], cuts)] if len(b) else [], pa.binary())}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        held: list[pa.RecordBatch] = []
        size, last = 0, None
        for batch in slices(batches, "body", block_bytes // 4):
            keys = batch.column("key").to_numpy()
            if size >= block_bytes:  # the block ends where the next key begins
                cut = int(np.argmax(keys != last)) if (keys != last).any() else len(keys)
                held.append(batch.slice(0, cut))
                if cut == len(keys):
                    continue
                yield found(pa.Table.from_batches(held))
                batch, held, size = batch.slice(cut), [], 0
            held.append(batch)
            size += pc.sum(pc.binary_length(batch.column("body"))).as_py()
            last = keys[-1]
        if held:
            last = found(pa.Table.from_batches(held))
            held.clear()
            yield last
        del last
        release()

    return wanted.repartition("key").sortWithinPartitions("key").mapInArrow(run, "slab long, windows binary")


def deduplicate(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", length: int = LENGTH, slab_bytes: int = SLAB_BYTES,
    bucket_bytes: int = BUCKET_BYTES, block_bytes: int = BLOCK_BYTES, hot: int = HOT,
) -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, spans (removed byte ranges [start, end)) and kept (the bytes that are left)."""
    if not GRAM < length < 256:
        raise ValueError(f"length has to be above {GRAM} and below 256")
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    slabs = stage(_slabs(rows, slab_bytes), "slabs")
    size = slabs.agg(F.sum("size")).first()[0] or 0
    buckets, tasks = max(1, -(-size // bucket_bytes)), min(max(1, size // TASK_BYTES), MOST_TASKS)
    judged = stage(_judged(_entries(slabs, length, buckets), hot, tasks), "verdicts").withColumn("kind", F.lit(0))
    repeated = stage(_sorted_blocks(_wanted(slabs, judged, length, buckets, tasks), length, block_bytes), "windows").selectExpr(
        "slab", "1 as kind", "0L as bucket", "windows as verdicts"
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for _, own, verdicts, found in _each_slab(batches, length, buckets):
            yield from _cut(own, verdicts, found)
            del own, verdicts, found
        release()

    return _with_slabs(slabs, [judged, repeated], tasks).mapInArrow(
        run, "doc_id long, n_bytes long, n_removed long, spans array<struct<start: long, end: long>>, kept binary"
    )


def _cut(own: Slab, verdicts: np.ndarray, found: list[bytes]) -> Iterator[pa.RecordBatch]:
    """The result rows of one slab."""
    start, n, kind = own.runs["start"], own.runs["n"], own.kind
    change = np.zeros(len(own.text) + 1, np.int32)
    doc = own.doc_of(np.arange(len(start)))
    whole = (verdicts[kind] == ELSEWHERE) | (doc > doc[own.kinds][kind])
    np.add.at(change, start[whole], 1)
    np.add.at(change, (start + n + own.length - 1)[whole], -1)
    if found:
        kinds, a, b = np.frombuffer(b"".join(found), np.int32).reshape(-1, 3).T.astype(np.int64)
        # all runs of a kind in its smallest document
        rest = np.flatnonzero(~whole)
        rest = rest[np.argsort(kind[rest], kind="stable")]
        lo, hi = np.searchsorted(kind[rest], kinds), np.searchsorted(kind[rest], kinds, "right")
        each = np.repeat(np.arange(len(kinds)), hi - lo)
        runs_ = rest[np.arange(len(each)) - np.repeat(np.cumsum(hi - lo) - (hi - lo), hi - lo) + lo[each]]
        np.add.at(change, start[runs_] + a[each], 1)
        np.add.at(change, start[runs_] + b[each] + own.length - 1, -1)
    gone = np.cumsum(change[:-1]) > 0
    edge = np.zeros(len(gone) + 1, bool)
    edge[own.offsets] = True
    first, last = gone.copy(), gone.copy()
    first[1:] &= ~gone[:-1] | edge[1:-1]
    last[:-1] &= ~gone[1:] | edge[1:-1]
    begin, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    spans = np.searchsorted(begin, own.offsets)
    base = np.repeat(own.offsets[:-1], np.diff(spans))
    removed = np.concatenate(([0], np.cumsum(gone)))[own.offsets]
    kept = own.text[~gone]
    ends = own.offsets - removed
    for i in range(0, len(own.docs), 1024):
        j = min(i + 1024, len(own.docs))
        ids = own.docs[i:j]
        x, y = spans[i], spans[j]
        yield pa.RecordBatch.from_pydict(
            {
                "doc_id": pa.array(ids, mask=ids == _NO_ID),
                "n_bytes": pa.array(np.diff(own.offsets[i : j + 1])),
                "n_removed": pa.array(np.diff(removed[i : j + 1])),
                "spans": pa.ListArray.from_arrays(
                    pa.array((spans[i : j + 1] - x).astype(np.int32)),
                    pa.StructArray.from_arrays([pa.array(begin[x:y] - base[x:y]), pa.array(end[x:y] - base[x:y])], ["start", "end"]),
                ),
                "kept": pa.array([kept[a:b].tobytes() for a, b in zip(ends[i:j], ends[i + 1 : j + 1])], pa.binary()),
            }
        )
