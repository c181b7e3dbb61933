"""Ratings: maximum likelihood, bootstrap intervals, performance rating, anchor interpolation.

Every fit works on sufficient cells (rating level, games, points), so its cost does not grow with the
number of games. The cells of a group are packed into one array; the array is as long as the number
of distinct integer levels, never as the number of games.
"""

from __future__ import annotations


import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.functions.scoring import expected_score, score_to_diff

LOW, HIGH = -10, 3210


def loglik(cells: Column, rating: Column) -> Column:
    """Σ points·ln p + (games − points)·ln(1 − p), p kept inside [1e-9, 1 − 1e-9]."""
    def term(acc, c):
        p = F.lit(1.0) / (F.pow(F.lit(10.0), (c["level"] - rating) / 400.0) + 1.0)
        p = F.least(F.greatest(p, F.lit(1e-9)), F.lit(1 - 1e-9))
        return acc + c["points"] * F.ln(p) + (c["n"] - c["points"]) * F.ln(F.lit(1.0) - p)

    return F.aggregate(cells, F.lit(0.0), term)


def pack_cells(df: DataFrame, group: list[str], level: str, n: Column, points: Column) -> DataFrame:
    """group, cells: array<struct(level, n, points)> ordered by level."""
    per_level = df.groupBy(*group, F.col(level).cast("double").alias("level")).agg(
        F.sum(n).cast("double").alias("n"), F.sum(points).cast("double").alias("points")
    )
    return spread(per_level, group).groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("level", "n", "points"))).alias("cells")
    )


def spread(cells: DataFrame, group: list[str]) -> DataFrame:
    """Hash cells by group over all cores: few bytes, but much arithmetic per group.

    This takes the place of the shuffle the grouping needs anyway; a size-based coalescing of that
    shuffle would put the fits of many thousand small groups into one task.
    """
    if not group:
        return cells
    spark = cells.sparkSession
    n = min(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))
    return cells.repartition(n, *group)


def mle_of(cells: Column) -> Column:
    """Lowest integer rating of maximum likelihood in [-10, 3210].

    The log-likelihood is concave, so the first rating that the next one does not improve is the
    maximum; twelve halvings of the range find it. Gains below 1e-13 of the value are ties.
    """
    def improves(r):
        here, there = loglik(cells, r), loglik(cells, r + 1)
        return (there - here) > F.abs(here) * 1e-13

    def step(s, _):
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        open_ = s["lo"] < s["hi"]
        up = open_ & improves(mid)
        return F.struct(
            F.when(up, mid + 1).otherwise(s["lo"]).alias("lo"),
            F.when(open_ & ~up, mid).otherwise(s["hi"]).alias("hi"),
        )

    return F.aggregate(
        F.sequence(F.lit(1), F.lit(12)),
        F.struct(F.lit(LOW).alias("lo"), F.lit(HIGH).alias("hi")),
        step,
        lambda s: s["lo"],
    )


def elo_mle(
    df: DataFrame, group: list[str], level: str = "level", score: str = "score", n: str | None = None
) -> DataFrame:
    """group, games, points, elo, loglik. With `n`, a row stands for n games of that score."""
    count = F.col(n) if n else F.lit(1)
    cells = pack_cells(df, group, level, count, F.col(score) * count)
    total = lambda f: F.aggregate("cells", F.lit(0.0), lambda a, c: a + c[f])
    return (
        cells.withColumn("elo", mle_of(F.col("cells")))
        .withColumn("loglik", loglik(F.col("cells"), F.col("elo")))
        .select(*group, total("n").cast("bigint").alias("games"), total("points").alias("points"),
                "elo", "loglik")
    )


def _multinomial(frames):
    """Rows (seed, cells, reps) in, one row per replica and cell out."""
    for pdf in frames:
        rows = []
        for group, seed, start, size, cells in zip(pdf["_g"], pdf["_seed"], pdf["_start"], pdf["_size"], pdf["_cells"]):
            n = np.array([c["n"] for c in cells], dtype=np.int64)
            rng = np.random.default_rng([int(seed) & 0xFFFFFFFF, int(start)])
            draws = rng.multinomial(int(n.sum()), n / n.sum(), size=int(size))
            for r, counts in enumerate(draws):
                for c, k in zip(cells, counts):
                    if k:
                        rows.append((group, int(start) + r, float(c["level"]), float(c["score"]), int(k)))
        yield pd.DataFrame(rows, columns=["_g", "rep", "level", "score", "n"])


def bootstrap_ci(
    df: DataFrame, group: list[str], level="level", score="score", n: int = 1000, seed: int = 0
) -> DataFrame:
    """95% interval of `elo_mle` over n resamples of the games.

    A resample of N games is a multinomial draw over the (level, score) cells of the group, so a
    replica costs one draw per cell and not one per game. Replicas are spread over tasks in blocks.
    """
    cells = (
        df.groupBy(*group, F.col(level).alias("level"), F.col(score).alias("score"))
        .agg(F.count(F.lit(1)).alias("n"))
        .groupBy(*group)
        .agg(F.array_sort(F.collect_list(F.struct("level", "score", "n"))).alias("_cells"))
    )
    block = 100
    blocks = (
        cells.withColumn("_g", F.to_json(F.struct(*group)) if group else F.lit("{}"))
        .withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(block))))
        .select(
            "_g",
            F.xxhash64("_g", F.lit(seed)).alias("_seed"),
            "_start",
            F.least(F.lit(block), F.lit(n) - F.col("_start")).alias("_size"),
            "_cells",
        )
        .repartition("_g", "_start")
    )
    reps = blocks.mapInPandas(_multinomial, "_g string, rep int, level double, score double, n bigint")
    fits = elo_mle(reps, ["_g", "rep"], n="n")
    picked = fits.groupBy("_g").agg(F.array_sort(F.collect_list("elo")).alias("_v")).select(
        "_g",
        F.element_at("_v", int(0.025 * n) + 1).alias("lo95"),
        F.element_at("_v", int(0.975 * n)).alias("hi95"),
    )
    keyed = cells.select(*group, (F.to_json(F.struct(*group)) if group else F.lit("{}")).alias("_g"))
    return keyed.join(picked, "_g").drop("_g")


def performance_rating(df: DataFrame, group: list[str], opp: str, score: str) -> DataFrame:
    """estimate, lo95, hi95 per group; an ungrouped empty input is an error.

    Solves Σ E(R − opp) = Σ score with half a drawn game against the mean opponent added, by 64
    halvings of the 2400 points around that mean (more change nothing in double precision). The fold
    runs on cells per distinct opponent rating.
    """
    cells = df.groupBy(*group, F.col(opp).cast("double").alias("opp")).agg(
        F.count(F.lit(1)).cast("double").alias("n"), F.sum(score).alias("s")
    )
    packed = spread(cells, group).groupBy(*group).agg(
        F.array_sort(F.collect_list(F.struct("opp", "n"))).alias("cells"),
        F.coalesce(F.sum("n"), F.lit(0.0)).alias("n"),
        F.sum("s").alias("s"),
        F.try_divide(F.sum(F.col("opp") * F.col("n")), F.sum("n")).alias("avg"),
    )
    avg, n, s = F.col("avg"), F.col("n"), F.col("s")

    def imbalance(r):
        won = F.aggregate(
            "cells", F.lit(0.0), lambda a, c: a + c["n"] * expected_score(r, c["opp"])
        )
        return won - s + (expected_score(r, avg) - 0.5) * 0.5

    def step(b, _):
        mid = (b["lo"] + b["hi"]) / 2.0
        high = imbalance(mid) > 0
        return F.struct(
            F.when(high, b["lo"]).otherwise(mid).alias("lo"),
            F.when(high, mid).otherwise(b["hi"]).alias("hi"),
        )

    solved = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.struct((avg - 1200.0).alias("lo"), (avg + 1200.0).alias("hi")),
        step,
        lambda b: (b["lo"] + b["hi"]) / 2.0,
    )
    p = (s + 0.5) / (n + 1)
    se = F.sqrt(F.try_divide(F.greatest(p * (F.lit(1.0) - p), F.lit(1e-9)), n))
    estimate = F.when(
        n == 0, F.raise_error(F.lit("performance_rating needs at least one game")).cast("double")
    ).otherwise(solved)
    return packed.select(
        *group,
        n.cast("bigint").alias("games"),
        estimate.alias("estimate"),
        (avg + score_to_diff(p - se * 1.96)).alias("lo95"),
        (avg + score_to_diff(p + se * 1.96)).alias("hi95"),
    )


def interpolate(df: DataFrame, x: str, pool: str, anchors: DataFrame) -> DataFrame:
    """rating, estimated, note from the nearest anchors below and above `x` in the row's pool.

    An exact anchor is measured; a value between two anchors is interpolated linearly; outside the
    anchors the rating is NULL and the note says so. Anchors (weight, bot, pool, rating) are packed
    to one short array per pool, so this is an equi-join on the pool and not a range join.
    """
    packed = anchors.groupBy(F.col("pool").alias("_pool")).agg(
        F.array_sort(F.collect_list(F.struct("weight", "rating", "bot"))).alias("_a")
    )
    v = F.col(x)
    below = F.try_element_at(F.filter("_a", lambda a: a["weight"] <= v), F.lit(-1))
    above = F.try_element_at(F.filter("_a", lambda a: a["weight"] > v), F.lit(1))
    lo, hi = F.col("_lo"), F.col("_hi")
    exact = lo["weight"] == v
    mid = lo["rating"] + (v - lo["weight"]) / (hi["weight"] - lo["weight"]) * (hi["rating"] - lo["rating"])
    word = lambda a: F.concat(
        F.lit("maia-"), a["weight"].cast("string"), F.lit(" ("),
        F.format_string("%.0f", a["rating"]), F.lit(")"),
    )
    note = (
        F.when(exact, F.concat(F.lit("measured from lichess bot "), lo["bot"]))
        .when(lo.isNotNull() & hi.isNotNull(),
              F.concat(F.lit("linearly interpolated between "), word(lo), F.lit(" and "), word(hi)))
        .otherwise(F.lit("outside the interpolation range"))
    )
    return (
        df.join(packed, F.col(pool) == F.col("_pool"), "left")
        .withColumn("_lo", below)
        .withColumn("_hi", above)
        .withColumn("rating", F.when(exact, lo["rating"]).otherwise(mid))
        .withColumn("estimated", F.when(exact, F.lit(False)).when(mid.isNotNull(), F.lit(True)))
        .withColumn("note", note)
        .drop("_a", "_pool", "_lo", "_hi")
    )


def rating_anchors(spark) -> DataFrame:
    return spark.createDataFrame(
        list(K.RATING_ANCHORS), "weight int, bot string, pool string, rating double"
    )


