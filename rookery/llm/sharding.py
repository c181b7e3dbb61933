"""Shards by vector bin packing: bytes, tokens and rows are balanced jointly.

Rows of equal text are one group with a size vector (bytes, tokens, rows), each part as a share of
the total. A group goes where the dot product of its vector with the shards' residual capacities is
highest, larger groups first. Groups above 1/`BIG` of a shard in some part (a bounded number: their
shares sum to three) are placed first, in one list; those above 1/`CUT` of a shard are cut into pieces
of rows, so that a text that holds a third of all rows still spreads evenly. All other groups are hashed
into buckets, and every bucket fills the same shares of what the big groups left, on its own.

Cases: null text is empty (size 1, the group of empty texts); repeated rows get a slot each; an empty
table gives no rows; a null id is placed like any other; other columns aren't read.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.llm.staging import stage

SHARDS = 16
BIG, CUT = 64, 8
GROUPS_PER_BUCKET = 16_384
ROWS_PER_CHUNK = 65_536
_PARTS = ("bytes", "tokens", "rows")


def place(sizes: np.ndarray, residual: np.ndarray) -> np.ndarray:
    """A shard for each size vector; `residual` (shard x part) is used up."""
    out = np.empty(len(sizes), np.int32)
    for k in np.argsort(-sizes.max(1), kind="stable") if len(sizes) else ():
        s = out[k] = int(np.argmax(residual @ sizes[k]))
        residual[s] -= sizes[k]
    return out


def _bucket_placer(total: np.ndarray, room: np.ndarray):
    """Places the groups of one bucket; `room` is each shard's share of what is left, by part."""

    def run(_, frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("key", ignore_index=True)
        sizes = frame[list(_PARTS)].to_numpy(float) / total
        residual = room * sizes.sum(0)
        return pd.DataFrame({"key": frame["key"], "shard": place(sizes, residual)})

    return run


def shard(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shards: int = SHARDS,
    groups_per_bucket: int = GROUPS_PER_BUCKET,
) -> DataFrame:
    """doc_id, size, text_crc32, shard and slot (gapless from 0 in the shard) of every row."""
    spark = docs.sparkSession
    t = F.coalesce(F.col(text), F.lit(""))
    rows = stage(
        docs.select(
            F.col(doc_id).cast("long").alias("doc_id"), F.monotonically_increasing_id().alias("row"),
            (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"),
            F.regexp_count(t, F.lit(r"\S+")).cast("long").alias("tokens"), F.md5(t).alias("key"),
        ),
        "shard-rows",
    )
    parts = [F.sum("size").alias("bytes"), F.sum("tokens").alias("tokens"), F.count(F.lit(1)).alias("rows")]
    total = np.array([x or 0 for x in rows.agg(*parts).first()], float)
    total[total == 0] = 1
    groups = stage(rows.groupBy("key").agg(*parts), "shard-groups")

    most = F.greatest(*(F.col(p) / float(v) for p, v in zip(_PARTS, total))) * shards  # in shards
    big = {r.key: max(1, int(np.ceil(r.most * CUT))) for r in groups.where(most > 1 / BIG).select("key", most.alias("most")).collect()}
    cuts = spark.createDataFrame(list(big.items()), "key string, cuts int")
    pieces = rows.join(F.broadcast(cuts), "key").withColumn("piece", F.pmod(F.xxhash64("row"), F.col("cuts")).cast("int"))
    listed = pieces.groupBy("key", "piece").agg(*parts).orderBy("key", "piece").collect()
    residual = np.full((shards, 3), 1 / shards)
    sizes = np.array([[r[p] for p in _PARTS] for r in listed], float).reshape(-1, 3) / total
    placed = place(sizes, residual)
    first = spark.createDataFrame(
        [(r.key, r.piece, int(s)) for r, s in zip(listed, placed)], "key string, piece int, shard int"
    )

    room = np.maximum(residual, 0) + 1e-12
    room /= room.sum(0)
    n = groups.count()
    buckets = max(1, -(-n // groups_per_bucket))
    small = (
        groups.join(F.broadcast(cuts), "key", "left_anti")
        .groupBy(F.pmod(F.xxhash64("key"), F.lit(buckets)).alias("bucket"))
        .applyInPandas(_bucket_placer(total, room), "key string, shard int")
    )
    kept = ["doc_id", "row", "size", "text_crc32", "shard"]
    dealt = pieces.join(F.broadcast(first), ["key", "piece"]).select(kept).unionByName(
        rows.join(F.broadcast(cuts), "key", "left_anti").join(small, "key").select(kept)
    )
    return _slots(stage(dealt, "shard-dealt"), int(total[2]))


def _slots(dealt: DataFrame, n: int) -> DataFrame:
    """Numbers the rows of each shard from 0, in chunks that are counted first."""
    chunks = max(1, -(-n // ROWS_PER_CHUNK))
    cut = dealt.withColumn("chunk", F.pmod(F.xxhash64("row"), F.lit(chunks)))
    counts = cut.groupBy("shard", "chunk").agg(F.count(F.lit(1)).alias("n"))
    line = Window.partitionBy("shard").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("shard", "chunk", F.coalesce(F.sum("n").over(line), F.lit(0)).alias("base"))
    inside = Window.partitionBy("shard", "chunk").orderBy("doc_id", "row")
    return cut.join(base, ["shard", "chunk"]).select(
        "doc_id", "size", "text_crc32", "shard", (F.col("base") + F.row_number().over(inside) - 1).alias("slot")
    )
