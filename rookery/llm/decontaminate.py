"""Benchmark decontamination: one Aho-Corasick automaton over normalised benchmark texts.

Words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became a-z. Every benchmark text
gives its windows of `window` consecutive words (a shorter text, if it has words, is one window). The
automaton runs over word numbers, not characters: 13 nodes a window, no match inside a word. A
document is read once; words inside an occurrence of a window are hit, and runs of hit words are
mapped to character offsets of the original text.

Cases: null or empty text has no words and is clean; a null benchmark text has no window; a null
item id still hits words but is not listed; repeated rows are judged one by one; extra columns pass
through, and result columns get a leading underscore where they clash. The automaton of one block of
benchmark texts is bounded by `block_bytes`; a larger benchmark is scanned in several blocks.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterable, Iterator

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.llm.staging import fresh, hold, slices, stage, utf8

WINDOW = 13
BLOCK_BYTES = 1 << 20
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
_TO_WORDS = bytes(c + 32 if 65 <= c <= 90 else c if 48 <= c <= 57 or 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: bytes) -> list[bytes]:
    return text.translate(_TO_WORDS).split()


def word_offsets(text: str) -> list[tuple[int, int]]:
    """Character offsets of the words of the original text."""
    return [m.span() for m in _WORD.finditer(text.translate(_LOWER))]


class Automaton:
    """Windows of benchmark words as number sequences, with the items that hold each."""

    def __init__(self, items: Iterable[tuple[str | None, str]], window: int):
        self.number: dict[bytes, int] = {}
        held: dict[tuple[int, ...], set] = {}
        for item, text in items:
            seq = [self.number.setdefault(w, len(self.number) + 1) for w in words(text.encode())]
            for i in range(max(len(seq) - window, 0) + 1 if seq else 0):
                held.setdefault(tuple(seq[i : i + window]), set()).add(item)
        self.ids = [sorted(x for x in v if x is not None) for v in held.values()]
        self.machine = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for i, key in enumerate(held):
            self.machine.add_word(key, (len(key), i))
        if held:
            self.machine.make_automaton()
        self.empty = not held

    def scan(self, found: list[bytes], hit: np.ndarray, items: set) -> None:
        """Marks the hit words in `hit` and adds the items whose windows occur."""
        if self.empty:
            return
        get = self.number.get
        for end, (length, i) in self.machine.iter(tuple([get(w, 0) for w in found])):
            hit[end - length + 1 : end + 1] = True
            items.update(self.ids[i])


def _runs(hit: np.ndarray) -> np.ndarray:
    """Starts and ends of the runs of True, in pairs."""
    return np.flatnonzero(np.diff(np.concatenate(([0], hit.view(np.int8), [0]))))


_SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])
_STATE = T.StructType([T.StructField("runs", T.ArrayType(T.IntegerType())), T.StructField("items", T.ArrayType(T.StringType()))])
_RESULTS = {
    "n_words": (T.LongType(), pa.int64()),
    "n_hit": (T.LongType(), pa.int64()),
    "item_ids": (T.ArrayType(T.StringType()), pa.list_(pa.string())),
    "spans": (T.ArrayType(_SPAN), pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))),
    "contaminated": (T.BooleanType(), pa.bool_()),
}


def _judged(raw: bytes, found: list[bytes], hit: np.ndarray, items: set, share: int) -> tuple:
    """The result columns of one document."""
    n, runs = int(hit.sum()), _runs(hit).reshape(-1, 2).tolist()
    place = word_offsets(raw.decode()) if runs else []
    spans = [{"start": place[s][0], "end": place[e - 1][1]} for s, e in runs]
    return len(found), n, sorted(items), spans, n > 0 and share * n >= len(found)


def _scan_block(
    df: DataFrame, text: str, state: str, items: list, window: int, share: int, names: dict[str, str], last: bool
) -> DataFrame:
    """Adds the hits of one block of items to `state`, or the result columns after the last block."""
    name = hashlib.md5(repr((window, items)).encode()).hexdigest()
    shared = df.sparkSession.sparkContext.broadcast(items)
    first, columns = state not in df.columns, [c for c in df.columns if c != state]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = hold(name, lambda: Automaton(shared.value, window))
        for batch in slices(batches, text):
            before = [None] * batch.num_rows if first else batch.column(state).to_pylist()
            out = []
            for raw, old in zip(utf8(batch.column(text)).to_pylist(), before):
                found = words(raw)
                hit, seen = np.zeros(len(found), bool), set(old["items"] if old else ())
                for s, e in zip(*[iter(old["runs"] if old else ())] * 2):
                    hit[s:e] = True
                machine.scan(found, hit, seen)
                out.append(_judged(raw, found, hit, seen, share) if last else {"runs": _runs(hit).tolist(), "items": sorted(seen)})
            made = {c: batch.column(c) for c in columns}
            if last:
                made |= {n: pa.array(v, _RESULTS[k][1]) for (k, n), v in zip(names.items(), zip(*out))}
            else:
                kind = pa.struct([("runs", pa.list_(pa.int32())), ("items", pa.list_(pa.string()))])
                made[state] = pa.array(out, kind)
            yield pa.RecordBatch.from_pydict(made)

    kept = [f for f in df.schema.fields if f.name != state]
    new = [T.StructField(n, _RESULTS[k][0]) for k, n in names.items()] if last else [T.StructField(state, _STATE)]
    return df.mapInArrow(scan, T.StructType([*kept, *new]))


def _blocks(benchmark: DataFrame, item: str, text: str, block_bytes: int) -> tuple[int, Iterator[list]]:
    """Distinct (item, text) rows in blocks of about `block_bytes` bytes of text."""
    rows = benchmark.select(F.col(item).cast("string").alias("i"), F.col(text).alias("t")).where("t is not null").distinct()
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    parts = (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i", "t"), F.lit(n)) == k) for k in range(n))
    return n, (sorted(((r.i, r.t) for r in part.collect()), key=repr) for part in parts)


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, *, text: str = "text", item: str = "item_id", item_text: str = "text",
    window: int = WINDOW, share: int = 20, block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """`docs` with n_words, n_hit, item_ids, spans and contaminated.

    contaminated: some word is hit, and hit words are at least one in `share`. spans: character
    offsets [start, end) of the runs of hit words in the original text.
    """
    state, names, df = fresh(docs, "state"), {k: fresh(docs, k) for k in _RESULTS}, docs
    n, parts = _blocks(benchmark, item, item_text, block_bytes)
    for k, items in enumerate(parts):
        if k and k % 4 == 0:  # bounds the Python workers that one task holds at once
            df = stage(df, "decontaminate")
        df = _scan_block(df, text, state, items, window, share, names, last=k == n - 1)
    return df
