"""Importance resampling towards a target distribution, with hashed n-grams from prefix CRCs.

A text's words are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became a-z, joined by one space.
One scan keeps the running CRC-32 at the end of every word. The CRC of any n-gram follows from two of
them: it is the CRC at its end, xor the CRC before its start moved on by the n-gram's bytes. Moving by
zero bytes is linear over GF(2), so it is a product of tables for 1, 2, 4, ... bytes, whatever the
n-gram's length, and no n-gram is read again.

Each n-gram of `orders` words counts in the bucket crc mod `buckets`. A bucket's gain compares its
share in the target with that in all documents; a document's weight is the floored mean gain of its
n-grams. Gumbel noise from a hash of the id turns weights into scores whose highest `share` are a draw
without replacement. Ranks come from ranges of the score: sorted ranges are written, and each range's
rank begins after the rows before.

The driver holds `buckets` counts and gains and one row per range. Documents are read once; what is
kept of each is its bucket histogram.

Cases: null, empty and wordless texts have no n-grams and weight 0; texts of fewer than `least_words`
words are never drawn; repeated rows are drawn each; equal scores go to the smaller id, null ids last (they
hash as empty text); long texts are read whole; an empty target or table is defined (all its counts are 0);
other columns aren't read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.llm.decontaminate import words
from rookery.llm.staging import fresh, release, slices, stage, utf8

BUCKETS, ORDERS, LEAST_WORDS, SHARE, SEED = 10_000, (1, 1), 20, (10, 100), 2024
_ALL = np.uint32(0xFFFFFFFF)


def _byte_table() -> np.ndarray:
    """The CRC of each byte, from the reflected polynomial."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> 1) ^ np.uint32(0xEDB88320), out >> 1)
    return out


_BYTE = _byte_table()


def _apply(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = tables[0][crc & 255]
    for j in (1, 2, 3):
        out = out ^ tables[j][(crc >> np.uint32(8 * j)) & 255]
    return out


def _move_tables(bits: int) -> list[np.ndarray]:
    """For each k, what 2**k zero bytes do to each of a CRC's four bytes."""
    bytes_ = np.arange(256, dtype=np.uint32)
    tables = [np.stack([_BYTE, *((bytes_ << np.uint32(8 * j)) >> np.uint32(8) for j in (1, 2, 3))])]
    for _ in range(bits - 1):
        tables.append(_apply(tables[-1], tables[-1]))
    return tables


_MOVES = _move_tables(40)


def moved(crc: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The CRCs after `by` zero bytes each, without the usual complements (they cancel in a difference)."""
    crc = crc.copy()
    for k in range(int(by.max()).bit_length() if len(by) else 0):
        own = np.flatnonzero((by >> k) & 1)
        crc[own] = _apply(_MOVES[k], crc[own])
    return crc


def _step(crc: int, word: bytes) -> int:
    return zlib.crc32(word, zlib.crc32(b" ", crc))


def prefix_crcs(found: list[bytes]) -> np.ndarray:
    """The running CRC at the end of each word of one text; the only read of its bytes."""
    first = accumulate(found[1:], _step, initial=zlib.crc32(found[0])) if found else ()
    return np.fromiter(first, np.uint32, len(found))


def gram_crcs(ends: np.ndarray, lens: np.ndarray, counts: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """(CRC, text) of every run of `n` words; `ends` are the prefix CRCs, `lens` the bytes of the words of all texts."""
    last = np.cumsum(counts)
    owner = np.repeat(np.arange(len(counts)), counts)
    at = np.flatnonzero(last[owner] - np.arange(len(ends)) >= n)
    upto = np.concatenate(([0], np.cumsum(lens + 1)))
    # before the first word of a text there is nothing; later words follow the space after the one before
    before = np.zeros(len(at), np.uint32)
    later = at > (last - counts)[owner[at]]
    raw = ends[at[later] - 1] ^ _ALL
    before[later] = _BYTE[(raw ^ 32) & 255] ^ (raw >> np.uint32(8)) ^ _ALL
    return ends[at + n - 1] ^ moved(before, upto[at + n] - upto[at] - 1), owner[at]


def histograms(docs: DataFrame, orders: tuple[int, int], buckets: int) -> DataFrame:
    """(d, n_words, n_features, buckets, times) of every row of (d, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "t"):
            found = [words(t) for t in utf8(batch.column("t")).to_pylist()]
            counts = np.array([len(f) for f in found], np.int64)
            ends = np.concatenate([prefix_crcs(f) for f in found])
            lens = np.fromiter((len(w) for f in found for w in f), np.int64, len(ends))
            codes = []
            for n in range(orders[0], orders[1] + 1):
                crc, owner = gram_crcs(ends, lens, counts, n)
                codes.append(owner * buckets + crc % np.uint32(buckets))
            codes, times = np.unique(np.concatenate(codes), return_counts=True)
            cuts = np.searchsorted(codes, np.arange(batch.num_rows + 1) * buckets)
            places = pa.array(cuts.astype(np.int32))
            total = np.concatenate(([0], np.cumsum(times)))
            yield pa.RecordBatch.from_pydict(
                {"d": batch.column("d"), "n_words": pa.array(counts), "n_features": pa.array(np.diff(total[cuts])),
                 "buckets": pa.ListArray.from_arrays(places, pa.array((codes % buckets).astype(np.int32))),
                 "times": pa.ListArray.from_arrays(places, pa.array(times.astype(np.int32)))}
            )

    return docs.mapInArrow(run, "d long, n_words long, n_features long, buckets array<int>, times array<int>")


def _flat(column: pa.Array) -> np.ndarray:
    ends = column.offsets
    return column.values.slice(ends[0].as_py(), ends[-1].as_py() - ends[0].as_py()).to_numpy().astype(np.int64)


def bucket_counts(held: DataFrame, buckets: int) -> np.ndarray:
    """Features of all rows per bucket; tasks send one row per bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        out = np.zeros(buckets, np.int64)
        for batch in batches:
            np.add.at(out, _flat(batch.column("buckets")), _flat(batch.column("times")))
        own = np.flatnonzero(out)
        yield pa.RecordBatch.from_pydict({"b": pa.array(own), "n": pa.array(out[own])})

    out = np.zeros(buckets, np.int64)
    for r in held.mapInArrow(run, "b long, n long").groupBy("b").agg(F.sum("n").alias("n")).collect():
        out[r.b] = r.n
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares of each bucket, floored."""
    s, t, size = int(source.sum()), int(target.sum()), len(source)
    ratio = lambda a, b: (float(b) + 1) * (float(s) + size) / ((float(a) + 1) * (float(t) + size))
    return np.array([math.floor(1000 * math.log(ratio(a, b))) for a, b in zip(source.tolist(), target.tolist())], np.int64)


def _weighed(held: DataFrame, gain: np.ndarray) -> DataFrame:
    shared = held.sparkSession.sparkContext.broadcast(gain)  # one number per bucket

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            if not batch.num_rows:
                continue
            n, ends = batch.column("n_features").to_numpy(), batch.column("buckets").offsets.to_numpy().astype(np.int64)
            sums = np.concatenate(([0], np.cumsum(shared.value[_flat(batch.column("buckets"))] * _flat(batch.column("times")))))
            weight = np.diff(sums[ends - ends[0]]) // np.maximum(n, 1)
            yield pa.RecordBatch.from_pydict(
                {"d": batch.column("d"), "n_words": batch.column("n_words"), "n_features": batch.column("n_features"), "weight": pa.array(weight)}
            )

    return held.mapInArrow(run, "d long, n_words long, n_features long, weight long")


def _ranked(rows: DataFrame, drawn: str, order: list) -> DataFrame:
    """`rows` with `place`: ranks from 1 by `order`; written in sorted ranges, no global window."""
    dealt = stage(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id()), drawn)
    part = F.shiftright("at", 33)
    sizes = dealt.groupBy(part.alias("part")).agg(F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # broadcast, and the only window: one row per range
    bases = F.broadcast(sizes.select("part", before.alias("base")))
    return dealt.withColumn("part", part).join(bases, "part").withColumn("place", F.col("base") + F.col("at").bitwiseAND((1 << 33) - 1) + 1).drop("part", "base", "at")


def scored(
    docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", text: str = "text", target_text: str = "text",
    orders: tuple[int, int] = ORDERS, buckets: int = BUCKETS, least_words: int = LEAST_WORDS,
    share: tuple[int, int] = SHARE, seed: int = SEED,
) -> DataFrame:
    """Per row: doc_id, n_features, weight, score, rank (null where not drawn)."""
    held = stage(histograms(docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")), orders, buckets), "histograms")
    wanted = histograms(target.select(F.lit(None).cast("long").alias("d"), F.col(target_text).alias("t")), orders, buckets)
    gain = gains(bucket_counts(held, buckets), bucket_counts(wanted, buckets))
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("d").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))
    rows = stage(
        _weighed(held, gain).select("d", "n_features", "weight", (F.col("weight") + noise).alias("score"), (F.col("n_words") >= least_words).alias("able")),
        "weights",
    )
    draw = rows.where("able").count() * share[0] // share[1]
    ranked = _ranked(rows, "ranges", [F.desc("able"), F.desc("score"), F.asc_nulls_last("d")])
    return ranked.select(
        F.col("d").alias("doc_id"), "n_features", "weight", "score", F.when(F.col("able") & (F.col("place") <= draw), F.col("place")).alias("rank")
    )


def resample(docs: DataFrame, target: DataFrame, *, doc_id: str = "doc_id", **options) -> DataFrame:
    """The drawn rows of `docs`, whole, with their rank; rows that share a drawn id all come, with its best rank."""
    name = fresh(docs, "rank")
    drawn = scored(docs, target, doc_id=doc_id, **options).where("rank is not null")
    once = drawn.groupBy("doc_id").agg(F.min("rank").alias(name)).withColumnRenamed("doc_id", "_drawn")
    return docs.join(once, docs[doc_id].cast("long").eqNullSafe(F.col("_drawn"))).drop("_drawn")
