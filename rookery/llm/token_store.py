"""Token ids in ORC files: integer run-length encoding, row indexes, Bloom filters on document ids.

Texts are dealt by ranges of the document id and sorted, encoded in that order, and written as ORC
with one file per range. Each row holds the ids of one document, its number of ids and the ids before
it in its file, so that readers take stripes in parallel, skip them by the row index or the Bloom
filter, and get a document's place in the whole store from one row per file.

Cases: null and empty texts are the end id alone; a null document id sorts first; repeated rows are
stored each, beside each other; a very long text is one row; an empty table gives no rows; columns
other than id and text aren't stored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from rookery.llm.staging import slices
from rookery.llm.tokens import END_ID, SLICE_BYTES, encoder, vocabulary

STRIPE_BYTES = 64 << 20
ROW_INDEX_STRIDE = 1000
BLOOM_FPP = 0.01
_SCHEMA = "doc_id long, part int, before long, n_tokens long, ids array<int>"


def write(
    docs: DataFrame, path: str, *, doc_id: str = "doc_id", text: str = "text",
    vocabulary_name: str = "byte_bpe_50k.json", spaced: bool = True, end: int = END_ID,
) -> None:
    """Writes the store to `path`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, before = encoder(vocabulary(vocabulary_name), spaced, end), 0
        for batch in slices(batches, "t", SLICE_BYTES):
            ids, ends = coder.encode(batch.column("t"))
            starts = np.concatenate(([0], ends[:-1]))
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("d"),
                    "part": batch.column("p"),
                    "before": pa.array(before + starts),
                    "n_tokens": pa.array(ends - starts),
                    "ids": pa.ListArray.from_arrays(
                        pa.array(np.concatenate((starts, ends[-1:])).astype(np.int32)), pa.array(ids.astype(np.int32))
                    ),
                }
            )
            before += int(ends[-1])

    narrow = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"), F.xxhash64(F.col(text)).alias("h"))
    ordered = narrow.repartitionByRange("d", "h").sortWithinPartitions("d", "h")
    (
        ordered.select("d", "t", F.spark_partition_id().alias("p"))
        .mapInArrow(run, _SCHEMA)
        .write.option("orc.stripe.size", STRIPE_BYTES)
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", ROW_INDEX_STRIDE)
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", BLOOM_FPP)
        .option("compression", "zstd")
        .orc(path)
    )


def read(spark: SparkSession, path: str) -> DataFrame:
    """The store's rows with `start`: the ids of all documents before, over the whole store."""
    rows = spark.read.schema(_SCHEMA).orc(path)
    files = rows.groupBy("part").agg(F.sum("n_tokens").alias("n"))
    # one row per file: the only window here, and as long as the list of files
    before = F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # broadcast: a row per file, and a file per task that wrote
    return rows.join(F.broadcast(files.select("part", before.alias("base"))), "part").select(
        "doc_id", (F.col("base") + F.col("before")).alias("start"), "n_tokens", "ids"
    )


def checksums(rows: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32, from the ids that were read."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            held = batch.column("ids")
            flat = np.ascontiguousarray(held.values.to_numpy(zero_copy_only=False).astype("<u4"))
            at = held.offsets.to_numpy()
            crc = [zlib.crc32(flat[a:b]) for a, b in zip(at[:-1], at[1:])]
            yield pa.RecordBatch.from_pydict(
                {"doc_id": batch.column("doc_id"), "start": batch.column("start"),
                 "n_tokens": pa.array(np.diff(at).astype(np.int64)), "ids_crc32": pa.array(crc, pa.int64())}
            )

    return rows.mapInArrow(run, "doc_id long, start long, n_tokens long, ids_crc32 long")
