"""Position suites: sampling, scoring from given evaluations, metrics, paired comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.functions.names import name_none
from rookery.functions.numeric import clamp
from rookery.operators.candidates import contains_move
from rookery.operators.ordered import first
from rookery.operators.significance import sign_flip_test
from rookery.session import staged

DIGITS = 3  # hexadecimal digits of a hash that are counted at a time


def sample_suite(
    decisions: DataFrame,
    n: int,
    seed: int = 0,
    hard: int = K.SUITE_HARD,
    key: str = "epd",
    src: str = "src",
    loss: str = "cpl",
) -> DataFrame:
    """n labelled positions: hard ones up to n//2, then easy ones up to n in total.

    The order is a seeded hash of `src`. A position key is taken once over both pools. Both picks
    are cut by `least_hashes`, so n may be as large as the tables.
    """
    order = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col(src)).cast("binary"))
    rows = decisions.where(F.col(loss).isNotNull()).withColumn("_o", order)
    half = max(1, n // 2)
    hard_rows = staged(first(rows.where(F.col(loss) >= hard), [key], ["_o", src]), "hard-rows")
    picked = staged(least_hashes(hard_rows, "_o", half, [src]), "hard-sample")
    easy = rows.where(F.col(loss) < hard).join(picked.select(key), key, "left_anti")
    easy = staged(first(easy, [key], ["_o", src]), "easy-rows")
    filled = least_hashes(easy, "_o", max(1, n - picked.count()), [src])
    cols = decisions.columns
    return (
        picked.select(*cols, F.lit("hard").alias("pool"))
        .unionByName(filled.select(*cols, F.lit("easy").alias("pool")))
    )


def least_hashes(df: DataFrame, hash_hex: str, n: int, ties: list[str], sort_rows: int = 10_000) -> DataFrame:
    """The n rows with the least hashes (lower-case hex text, not null), equal ones by `ties`; all rows if fewer.

    Rows are counted by the next `DIGITS` digits of their hash (one small counter per value on the driver)
    until the value that holds the n-th row has at most `sort_rows` rows or no digits are left.
    All smaller values are taken whole; only rows of that one value are ordered. Reads `df` once per
    level: log of the row count to base 4096, so write it first.
    """
    prefix, room, cut = "", n, df
    width = max(1, df.select(F.max(F.length(hash_hex))).first()[0] or 1)
    while len(prefix) < width:
        part = F.substring(hash_hex, len(prefix) + 1, DIGITS).alias("part")
        sizes = sorted((r.part, r["count"]) for r in cut.groupBy(part).count().collect())  # at most 16^DIGITS rows
        if sum(size for _, size in sizes) <= room:
            break
        for value, size in sizes:
            if size >= room:
                break
            room -= size
        prefix += value
        cut = df.where(F.col(hash_hex).startswith(prefix))
        if size <= sort_rows or len(value) < DIGITS:
            break
    if not prefix:
        return df
    return df.where(F.col(hash_hex) < prefix).unionByName(cut.orderBy(hash_hex, *ties).limit(room))


def suite_candidates(decisions: DataFrame, evals: DataFrame, keys=("run_id", "game", "ply")) -> DataFrame:
    """Decisions of subject players in visible runs with the loss of their move."""
    keys = list(keys)
    visible = decisions.where(
        name_none(F.col("player")) & ~F.col("run_id").startswith("_")
    )
    return visible.join(evals.select(*keys, "cpl"), keys).withColumn("src", F.concat_ws(":", *keys))


def score_results(results: DataFrame, evals: DataFrame, key: str = "src") -> DataFrame:
    """cp_loss per answer: no move costs the cap, mate costs nothing, else best minus reached.

    `evals` has key, sf_eval (before, mover's view), after (mover's view), mates.
    """
    loss = (
        F.when(F.col("san").isNull(), F.lit(K.LOSS_CAP))
        .when(F.coalesce("mates", F.lit(False)), F.lit(0))
        .otherwise(clamp(F.col("sf_eval") - F.col("after"), 0, K.LOSS_CAP))
    )
    return results.join(evals, key, "left").withColumn("cp_loss", loss).select(*results.columns, "cp_loss")


def suite_metrics(results: DataFrame, group: list[str], own: str = "claude_candidates") -> DataFrame:
    share = lambda cond: F.avg(F.coalesce(cond, F.lit(False)).cast("double"))
    return results.groupBy(*group).agg(
        F.count(F.lit(1)).alias("positions"),
        F.avg("cp_loss").alias("mean_cp_loss"),
        share(F.col("san") == F.col("sf_best")).alias("best_move_hit"),
        share(F.col("cp_loss") >= K.SUITE_BLUNDER).alias("blunder_rate"),
        share(contains_move(F.col(own), F.col("sf_best"))).alias("proposer_recall"),
        F.sum("cost").alias("cost_usd"),
        F.avg("cost").alias("usd_per_pos"),
        F.avg("seconds").alias("s_per_pos"),
    )


def pair_on(a: DataFrame, b: DataFrame, key: list[str], value: str = "cp_loss") -> DataFrame:
    """Items answered by both arms: key, a, b, diff."""
    left = a.select(*key, F.col(value).alias("a"))
    right = b.select(*key, F.col(value).alias("b"))
    return left.join(right, key).withColumn("diff", F.col("a") - F.col("b"))


def compare_suites(a: DataFrame, b: DataFrame, key="src", n: int | None = None, seed: int = 0) -> DataFrame:
    """Paired difference with its sign-flip p, and the metrics of both arms on the common items."""
    pairs = pair_on(a, b, [key])
    test = sign_flip_test(pairs.withColumn("_c", F.lit("a-b")), ["_c"], "diff", n, seed)
    common = pairs.select(key)
    both = a.withColumn("arm", F.lit("a")).unionByName(b.withColumn("arm", F.lit("b")))
    metrics = suite_metrics(both.join(common, key, "left_semi"), ["arm"])
    wide = metrics.withColumn("_c", F.lit("a-b")).groupBy("_c").pivot("arm", ["a", "b"]).agg(
        F.first(F.struct("mean_cp_loss", "best_move_hit", "blunder_rate", "proposer_recall", "usd_per_pos"))
    )
    return test.join(wide, "_c").drop("_c")
