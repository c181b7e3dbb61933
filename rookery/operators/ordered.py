"""Ordered operators that survive hot keys.

A plain window over (key, order) puts a whole key into one task. Here every key is cut into chunks:
`chunk` is a list of columns that is a coarse, monotone function of the order (ply div 1024, the
day of a timestamp). Rows are windowed per (key, chunk); a summary with one row per chunk is windowed
per key and its carry is joined back on (key, chunk). The only wide shuffle is on (key, chunk); the
summary is built with map-side aggregation and is smaller by the chunk length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _cols(names) -> list[Column]:
    return [F.col(c) if isinstance(c, str) else c for c in names]


def _struct(names) -> Column:
    return F.struct(*_cols(names))


def _with_chunk(df: DataFrame, chunk: list[Column]) -> DataFrame:
    return df.withColumn("_chunk", F.struct(*[c.alias(f"c{i}") for i, c in enumerate(chunk)]))


def _join_carry(df: DataFrame, carry: DataFrame, keys: list[str]) -> DataFrame:
    """Attach one carry row per (key, chunk). Keys are compared null-safely."""
    right = carry.select(*[F.col(k).alias(f"_k_{k}") for k in keys], F.col("_chunk").alias("_kc"),
                         *[c for c in carry.columns if c not in (*keys, "_chunk")])
    cond = F.col("_chunk") == F.col("_kc")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return df.join(right, cond, "left").drop(*[f"_k_{k}" for k in keys], "_kc")


def ordinal(df: DataFrame, keys: list[str], order: list, chunk: list[Column], name: str) -> DataFrame:
    """1-based position of a row inside its key."""
    df = _with_chunk(df, chunk)
    sizes = df.groupBy(*keys, "_chunk").agg(F.count(F.lit(1)).alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sizes.select(*keys, "_chunk", F.coalesce(F.sum("_sum").over(before), F.lit(0)).alias("_carry"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order))
    return (
        _join_carry(df.withColumn("_local", F.row_number().over(local)), carry, keys)
        .withColumn(name, (F.col("_local") + F.col("_carry")).cast("bigint"))
        .drop("_local", "_carry", "_chunk")
    )


def running_sum(
    df: DataFrame, keys: list[str], order: list, chunk: list[Column], value: Column, name: str
) -> DataFrame:
    """Sum of `value` over the key up to and including the row."""
    df = _with_chunk(df.withColumn("_value", value), chunk)
    sums = df.groupBy(*keys, "_chunk").agg(F.sum("_value").alias("_sum"))
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = sums.select(*keys, "_chunk", F.sum("_sum").over(before).alias("_carry"))
    local = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*_cols(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        _join_carry(df.withColumn("_local", F.sum("_value").over(local)), carry, keys)
        .withColumn(name, F.coalesce(F.col("_local"), F.lit(0)) + F.coalesce(F.col("_carry"), F.lit(0)))
        .drop("_local", "_carry", "_value", "_chunk")
    )


def last_seen(
    df: DataFrame, keys: list[str], order: list, chunk: list[Column], value: Column, name: str
) -> DataFrame:
    """Last non-NULL `value` up to and including the row."""
    df = _with_chunk(df.withColumn("_value", value), chunk)
    rank = _struct(order)
    lasts = df.groupBy(*keys, "_chunk").agg(
        F.max_by("_value", F.when(F.col("_value").isNotNull(), rank)).alias("_sum")
    )
    before = Window.partitionBy(*keys).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carry = lasts.select(*keys, "_chunk", F.last("_sum", ignorenulls=True).over(before).alias("_carry"))
    local = (
        Window.partitionBy(*keys, "_chunk")
        .orderBy(*_cols(order))
        .rowsBetween(Window.unboundedPreceding, 0)
    )
    return (
        _join_carry(
            df.withColumn("_local", F.last("_value", ignorenulls=True).over(local)), carry, keys
        )
        .withColumn(name, F.coalesce("_local", "_carry"))
        .drop("_local", "_carry", "_value", "_chunk")
    )


def neighbour(
    df: DataFrame,
    keys: list[str],
    order: list,
    chunk: list[Column],
    values: dict[str, Column],
    offset: int = 1,
) -> DataFrame:
    """Values of the next (offset=1) or the previous (offset=-1) row of the key, as new columns."""
    packed = F.struct(*[c.alias(n) for n, c in values.items()])
    df = _with_chunk(df.withColumn("_value", packed), chunk)
    rank = _struct(order)
    edge = F.min_by("_value", rank) if offset == 1 else F.max_by("_value", rank)
    edges = df.groupBy(*keys, "_chunk").agg(edge.alias("_sum"))
    per_key = Window.partitionBy(*keys).orderBy("_chunk")
    step = F.lead("_sum").over(per_key) if offset == 1 else F.lag("_sum").over(per_key)
    carry = edges.select(*keys, "_chunk", step.alias("_carry"))
    local = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order))
    near = F.lead("_value").over(local) if offset == 1 else F.lag("_value").over(local)
    out = _join_carry(df.withColumn("_local", near), carry, keys)
    out = out.withColumn("_sum", F.coalesce("_local", "_carry"))
    for n in values:
        out = out.withColumn(n, F.col("_sum")[n])
    return out.drop("_local", "_carry", "_value", "_sum", "_chunk")


def latest(df: DataFrame, keys: list[str], seq: list[str]) -> DataFrame:
    """One row per key: the last in `seq`. Combines on the map side, so copies never pile up."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.max_by(F.struct(*rest), _struct(seq)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def first(df: DataFrame, keys: list[str], order: list) -> DataFrame:
    """One row per key: the first in `order`."""
    rest = [c for c in df.columns if c not in keys]
    return (
        df.groupBy(*keys)
        .agg(F.min_by(F.struct(*rest), _struct(order)).alias("_row"))
        .select(*keys, *[F.col(f"_row.{c}").alias(c) for c in rest])
        .select(*df.columns)
    )


def top_k(
    df: DataFrame, keys: list[str], order: list[Column], k: int, name: str = "rank", salts: int = 16
) -> DataFrame:
    """First k rows of each key. Spread over `salts` sub-groups first, so that a hot key is pruned
    to salts·k rows before it meets in one task."""
    spread = F.pmod(F.xxhash64(*[F.col(c) for c in df.columns if c not in keys]), F.lit(salts))
    local = Window.partitionBy(*keys, "_salt").orderBy(*order)
    final = Window.partitionBy(*keys).orderBy(*order)
    return (
        df.withColumn("_salt", spread)
        .withColumn(name, F.row_number().over(local))
        .where(F.col(name) <= k)
        .drop("_salt")
        .withColumn(name, F.row_number().over(final))
        .where(F.col(name) <= k)
    )


def mid_ranks(df: DataFrame, value: str, by: list[str], width: float) -> DataFrame:
    """Per distinct value: its count `n` and mid-rank inside `by`, without ranking raw rows.

    Distinct values are counted first (map-side combine); the cumulative count then runs over value
    ranges of the given width, never over all values in one task.
    """
    counts = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"))
    return cumulative(counts, by, value, "n", "below", width).withColumn(
        "mid_rank", F.col("below") + (F.col("n") + 1) / 2.0
    )


def cumulative(
    df: DataFrame, by: list[str], value: str, amount: str, name: str, width: float
) -> DataFrame:
    """Sum of `amount` over strictly smaller (distinct) values of the same group.

    Values are cut into ranges of `width`; range totals are accumulated per group and rows inside
    their range.
    """
    keys = list(by) or ["_all"]
    cut = df if by else df.withColumn("_all", F.lit(0))
    chunk = [F.floor(F.col(value) / F.lit(width))]
    out = running_sum(cut, keys, [value], chunk, F.col(amount), name)
    return out.withColumn(name, F.col(name) - F.col(amount)).drop("_all")
