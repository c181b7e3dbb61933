"""Deterministic group splits."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def sha1_mod(key: Column, k: int = 10) -> Column:
    """int(sha1(key), 16) mod k. Two 80-bit halves are too wide for a bigint, so fold 4×40 bits."""
    digest = F.sha1(key.cast("binary"))
    shift = (1 << 40) % k
    out = F.lit(0).cast("bigint")
    for i in range(4):
        word = F.conv(F.substring(digest, 1 + 10 * i, 10), 16, 10).cast("bigint")
        out = F.pmod(out * shift + word, F.lit(k).cast("bigint"))
    return out


def group_split(*keys: Column, k: int = 10) -> Column:
    """test / val / train by a hash of the group key, so that no group is ever split."""
    bucket = sha1_mod(F.concat_ws(":", *[c.cast("string") for c in keys]), k)
    return (
        F.when(bucket == 0, F.lit("test")).when(bucket == 1, F.lit("val")).otherwise(F.lit("train"))
    )
