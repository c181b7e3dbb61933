"""Significance tests on pre-aggregated cells.

A resampling test never touches raw rows: strata are reduced to score counts, differences to a
histogram. The null distribution of either is exact: that of a stratum is a hypergeometric one and strata
are convolved; that of sign flips is the product of cosines of its cells, summed over frequencies in
blocks spread over tasks. Probabilities below 1e-25 are left out; p-values are exact within 1e-10.
With a number of replicas, a replica is one hypergeometric (or binomial) draw per cell instead; replicas
run in blocks spread over tasks, each block returns one count, and p is within 4 sqrt(p (1 - p) / n).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.functions.numeric import binomial_two_sided_p, chi2_p, normal_two_sided_p
from rookery.operators.experiments import pair_rows
from rookery.operators.ordered import cumulative
from rookery.operators.rating import elo_mle


def _blocks(df: DataFrame, key: str, n: int, seed: int, block: int = 1000) -> DataFrame:
    """Repeat each row once per block of replicas and spread the blocks over tasks."""
    return (
        df.withColumn("_start", F.explode(F.sequence(F.lit(0), F.lit(n - 1), F.lit(block))))
        .withColumn("_size", F.least(F.lit(block), F.lit(n) - F.col("_start")))
        .withColumn("_seed", F.xxhash64(key, F.lit(seed)))
        .repartition(F.col(key), F.col("_start"))
    )


_SMALL = np.concatenate(([0.0], np.cumsum(np.log(np.arange(1.0, 256)))))


def _log_factorial(x: np.ndarray) -> np.ndarray:
    x = np.maximum(x, 0.0)
    y = np.maximum(x, 200.0) + 1
    series = (y - 0.5) * np.log(y) - y + 0.5 * math.log(2 * math.pi) + 1 / (12 * y) - 1 / (360 * y**3)
    return np.where(x < 256, _SMALL[np.minimum(x, 255).astype(int)], series)


def hypergeometric(rng, good: int, bad: int, draw: np.ndarray) -> np.ndarray:
    """Good items among `draw` of good + bad, one draw per element, exact at every size.

    Rejection for log-concave distributions: the probability falls at least geometrically on both
    sides of the mode, so a flat middle with two exponential tails lies above it.
    """
    draw = np.asarray(draw, np.float64)
    low, high = np.maximum(0.0, draw - bad), np.minimum(float(good), draw)
    mode = np.clip(np.floor((draw + 1) * ((good + 1) / (good + bad + 2))), low, high)

    def log_weight(k, m):
        parts = _log_factorial(k) + _log_factorial(good - k) + _log_factorial(m - k)
        return -(parts + _log_factorial(bad - m + k))

    total = _log_factorial(draw) + _log_factorial(good + bad - draw)
    whole = _log_factorial(np.float64(good)) + _log_factorial(np.float64(bad)) - _log_factorial(np.float64(good + bad))
    top = log_weight(mode, draw)
    peak = np.minimum(1.0, np.exp(whole + total + top))
    out, open_ = mode.copy(), np.flatnonzero(low < high)
    while len(open_):
        p = peak[open_]
        flat = 1 + p / 2
        u, v, w = rng.random((3, len(open_)))
        middle = u <= flat / (1 + flat)
        tail = rng.exponential(size=len(open_))
        y = np.where(middle, v * flat / p, (flat + tail) / p)
        k = mode[open_] + np.where(rng.random(len(open_)) < 0.5, -1, 1) * np.rint(y)
        inside = (k >= low[open_]) & (k <= high[open_])
        safe = np.where(inside, k, mode[open_])
        bound = np.log(np.maximum(w, 1e-300)) + np.minimum(0.0, flat - p * y)
        taken = inside & (bound <= log_weight(safe, draw[open_]) - top[open_])
        out[open_[taken]] = k[taken]
        open_ = open_[~taken]
    return out


def _permute(frames):
    """Count replicas at least as far apart as observed, for blocks of (pair, strata)."""
    for pdf in frames:
        out = []
        for pair, obs, na, nb, strata, start, size, seed in zip(
            pdf["pair"], pdf["obs"], pdf["na"], pdf["nb"], pdf["strata"], pdf["_start"],
            pdf["_size"], pdf["_seed"],
        ):
            rng = np.random.default_rng([int(seed) & 0xFFFFFFFF, int(start)])
            points = np.zeros(int(size))
            total = 0.0
            for s in strata:
                lost, drawn, won, take = (int(s[k]) for k in ("lost", "drawn", "won", "take"))
                wins = hypergeometric(rng, won, lost + drawn, np.full(int(size), take))
                draws = hypergeometric(rng, drawn, lost, take - wins)  # among what is left of the sample
                points += wins + 0.5 * draws
                total += won + 0.5 * drawn
            diff = points / na - (total - points) / nb
            out.append((pair, int(np.sum(np.abs(diff) >= abs(obs) - 1e-12))))
        yield pd.DataFrame(out, columns=["pair", "extreme"])


_LEAST = 1e-25
_TASKS = 64


def _laws(good: int, bad: int, draw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Good items among `draw` of good + bad: the least number that is kept and the law, a row per element.

    A law falls below 1e-25 within sqrt(m ln(1e25) / 2) of its mode, m being the least of good, bad, drawn and
    left items (Hoeffding), so a row is as wide as that. Its terms are products of the ratios of neighbours.
    """
    draw = np.asarray(draw, float)[:, None]
    low, high = np.maximum(0.0, draw - bad), np.minimum(float(good), draw)
    mode = np.clip(np.floor((draw + 1) * ((good + 1) / (good + bad + 2))), low, high)
    least = np.maximum(0.0, np.minimum(np.minimum(draw, good + bad - draw), min(good, bad))).max()
    reach = math.ceil(math.sqrt(least * -math.log(_LEAST) / 2)) + 2
    first = np.maximum(low, mode - reach)
    k = first + np.arange(2 * reach + 1)
    inside = (k > first) & (k <= high)
    ratio = np.where(inside, (good - k + 1) * (draw - k + 1), 1) / np.where(inside, k * (bad - draw + k), 1)
    steps = np.log(ratio)
    steps[k > high] = -np.inf
    log = np.cumsum(steps, axis=1)
    p = np.exp(log - log.max(axis=1, keepdims=True))
    return first[:, 0], p / p.sum(axis=1, keepdims=True)


def _stratum(lost: int, drawn: int, won: int, take: int, cells: int = 1 << 20) -> tuple[int, np.ndarray]:
    """Least half-points and their probabilities in a sample of `take` games of one stratum.

    Wins and, given the wins, draws are taken near their modes only: work grows as the games, not their square.
    """
    least, law = _laws(won, lost + drawn, np.array([take]))
    wins, likely = least[0] + np.arange(law.shape[1]), law[0]
    wins, likely = wins[likely > _LEAST], likely[likely > _LEAST]
    first = int(2 * wins[0]) + max(0, take - int(wins[-1]) - lost)
    out = np.zeros(int(2 * wins[-1]) + min(drawn, take - int(wins[0])) + 1 - first)
    wide = 2 * math.ceil(math.sqrt(min(drawn, lost) * -math.log(_LEAST) / 2)) + 5
    step = max(1, cells // wide)
    for i in range(0, len(wins), step):
        w, pw = wins[i : i + step], likely[i : i + step]
        at, draws = _laws(drawn, lost, take - w)
        p = draws * pw[:, None]
        points = (2 * w + at - first).astype(np.int64)[:, None] + np.arange(p.shape[1])
        kept = p > _LEAST
        out += np.bincount(points[kept], p[kept], len(out))
    kept = np.flatnonzero(out)
    return first + int(kept[0]), out[kept[0] : kept[-1] + 1]


def _convolved(parts: list[tuple[int, np.ndarray]]) -> tuple[int, np.ndarray]:
    first, out = 0, np.ones(1)
    for own, p in parts:
        first, out = first + own, np.convolve(out, p)
        kept = np.flatnonzero(out > _LEAST)
        first, out = first + int(kept[0]), out[kept[0] : kept[-1] + 1]
    return first, out


def _strata_laws(frames):
    for pdf in frames:
        laws = [_stratum(*map(int, r)) for r in zip(pdf["lost"], pdf["drawn"], pdf["won"], pdf["take"])]
        yield pd.DataFrame({"pair": pdf["pair"], "level": pdf["level"], "color": pdf["color"],
                            "first": [f for f, _ in laws], "law": [p for _, p in laws]})


def _permutation_p(frames):
    for pdf in frames:
        out = []
        for pair, half, total, na, nb, laws in zip(pdf["pair"], pdf["half"], pdf["total"], pdf["na"], pdf["nb"], pdf["laws"]):
            first, p = _convolved([(int(x["first"]), np.asarray(x["law"])) for x in laws])
            # the difference of means times 2 na nb, in whole numbers
            far = lambda h: abs(h * (int(na) + int(nb)) - int(total) * int(na))  # noqa: B023, E731
            out.append((pair, min(1.0, float(p[far(np.arange(first, first + len(p))) >= far(int(half))].sum()))))
        yield pd.DataFrame(out, columns=["pair", "p"])


def permutation_test(cells: DataFrame, pairs: DataFrame, n: int | None = None, seed: int = 0) -> DataFrame:
    """Stratified permutation test per pair: games, delta_score and p, exact or from `n` replicas.

    `cells` as of experiments.arm_cells. Labels move only inside a (level, colour) stratum, so the points
    of side a are a hypergeometric sum per stratum. Strata get their laws in tasks; a pair's are convolved.
    p of replicas = (extreme + 1) / (n + 1). A pair that one side doesn't play has null delta_score and p.
    """
    rows = pair_rows(cells, pairs)
    take = lambda cond: F.coalesce(F.sum(F.when(cond, F.col("n"))), F.lit(0))
    a = F.col("side") == "a"
    strata = rows.groupBy("pair", "level", "color").agg(
        take(F.col("score") == 0.0).alias("lost"),
        take(F.col("score") == 0.5).alias("drawn"),
        take(F.col("score") == 1.0).alias("won"),
        take(a).alias("take"),
        take(~a).alias("rest"),
        F.coalesce(F.sum(F.when(a, F.col("n") * F.col("score"))), F.lit(0.0)).alias("pa"),
        F.coalesce(F.sum(F.when(~a, F.col("n") * F.col("score"))), F.lit(0.0)).alias("pb"),
    )
    packed = strata.groupBy("pair").agg(
        F.sum("take").alias("na"),
        F.sum("rest").alias("nb"),
        (F.sum("pa") / F.sum("take") - F.sum("pb") / F.sum("rest")).alias("obs"),
        F.array_sort(
            F.collect_list(F.struct("level", "color", "lost", "drawn", "won", "take"))
        ).alias("strata"),
    )
    if n is None:
        kinds = ", ".join(f"{c} {strata.schema[c].dataType.simpleString()}" for c in ("pair", "level", "color"))
        # a stratum's law is work enough for a task; a stated number of partitions isn't merged
        spread = strata.drop("rest", "pa", "pb").repartition(_TASKS, "pair", "level", "color")
        laws = spread.mapInPandas(_strata_laws, f"{kinds}, first bigint, law array<double>")
        # strata of a pair: its levels times two colours
        held = laws.groupBy("pair").agg(F.array_sort(F.collect_list(F.struct("level", "color", "first", "law"))).alias("laws"))
        seen = strata.groupBy("pair").agg(
            (F.sum("pa") * 2).cast("bigint").alias("half"), (F.sum(F.col("pa") + F.col("pb")) * 2).cast("bigint").alias("total"),
            F.sum("take").alias("na"), F.sum("rest").alias("nb"),
        )
        tested = seen.where("na > 0 and nb > 0").join(held, "pair").mapInPandas(_permutation_p, "pair string, p double")
    else:
        counted = _blocks(packed, "pair", n, seed).mapInPandas(_permute, "pair string, extreme bigint")
        tested = counted.groupBy("pair").agg(((F.sum("extreme") + 1) / F.lit(float(n + 1))).alias("p"))
    return packed.join(tested, "pair", "left").select(
        "pair",
        F.col("na").alias("games_a"),
        F.col("nb").alias("games_b"),
        F.col("obs").alias("delta_score"),
        F.when((F.col("na") > 0) & (F.col("nb") > 0), F.col("p")).alias("p"),
    )


def lr_test(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Likelihood ratio per pair: separate ratings against one shared rating; 1 degree of freedom."""
    rows = pair_rows(cells, pairs)
    grouped = rows.withColumn("grp", F.explode(F.array(F.col("side"), F.lit("ab"))))
    fits = elo_mle(grouped, ["pair", "grp"], n="n")
    pick = lambda g, c: F.max(F.when(F.col("grp") == g, F.col(c)))
    stat = F.greatest(
        F.lit(0.0), (pick("a", "loglik") + pick("b", "loglik") - pick("ab", "loglik")) * 2
    )
    return (
        fits.groupBy("pair")
        .agg(
            pick("a", "elo").alias("elo_a"),
            pick("b", "elo").alias("elo_b"),
            pick("ab", "elo").alias("elo_joint"),
            stat.alias("stat"),
        )
        .withColumn("p", chi2_p(F.col("stat")))
    )


def mann_whitney(df: DataFrame, by: list[str], side: str, value: str, width: float = 1.0) -> DataFrame:
    """U of side 'a', z and two-sided p per group; mid-ranks for ties, no tie term in the deviation.

    Ranks come from counts of distinct values (ordered.mid_ranks): raw rows are never sorted.
    `width` is the value range that one task accumulates.
    """
    counts = df.groupBy(*by, value).agg(
        F.count_if(F.col(side) == "a").alias("_a"), F.count_if(F.col(side) == "b").alias("_b")
    )
    counts = counts.withColumn("n", F.col("_a") + F.col("_b"))
    ranked = cumulative(counts, by, value, "n", "below", width)
    rank = F.col("below") + (F.col("n") + 1) / 2.0
    agg = ranked.groupBy(*by).agg(
        F.sum("_a").cast("double").alias("n1"),
        F.sum("_b").cast("double").alias("n2"),
        F.sum(F.col("_a") * rank).alias("r1"),
    )
    n1, n2 = F.col("n1"), F.col("n2")
    sd = F.sqrt(n1 * n2 * (n1 + n2 + 1) / 12)
    return (
        agg.where((n1 > 0) & (n2 > 0))
        .withColumn("u", F.col("r1") - n1 * (n1 + 1) / 2)
        .withColumn("z", F.when(sd > 0, (F.col("u") - n1 * n2 / 2) / sd).otherwise(F.lit(0.0)))
        .withColumn("p", normal_two_sided_p(F.col("z")))
        .select(*by, n1.cast("bigint").alias("n_a"), n2.cast("bigint").alias("n_b"), "u", "z", "p")
    )


def delta_score(rows: DataFrame, by: list[str], side: str, value: str) -> DataFrame:
    """Mean of side a, mean of side b and their difference per group."""
    a = F.avg(F.when(F.col(side) == "a", F.col(value)))
    b = F.avg(F.when(F.col(side) == "b", F.col(value)))
    return rows.groupBy(*by).agg(a.alias("mean_a"), b.alias("mean_b"), (a - b).alias("delta"))


def _flip(frames):
    for pdf in frames:
        out = []
        for g, obs, total, cells, start, size, seed in zip(
            pdf["_g"], pdf["obs"], pdf["n"], pdf["cells"], pdf["_start"], pdf["_size"], pdf["_seed"]
        ):
            rng = np.random.default_rng([int(seed) & 0xFFFFFFFF, int(start)])
            acc = np.zeros(int(size))
            for c in cells:
                k = int(c["n"])
                acc += float(c["d"]) * (2.0 * rng.binomial(k, 0.5, size=int(size)) - k)
            out.append((g, int(np.sum(np.abs(acc / total) >= abs(obs) - 1e-9))))
        yield pd.DataFrame(out, columns=["_g", "extreme"])


_FREQUENCIES = 1 << 16


def _frequencies(frames):
    """Each block's part of P(|sum| < seen): the characteristic function against the kernel of that interval."""
    for pdf in frames:
        out = []
        for g, seen, length, cells, start, size in zip(pdf["_g"], pdf["seen"], pdf["length"], pdf["cells"], pdf["_start"], pdf["_size"]):
            j = np.arange(int(start), int(start) + int(size))
            theta = 2 * np.pi * j / int(length)
            log, odd = np.zeros(len(j)), np.zeros(len(j), bool)
            for c in cells:
                wave = np.cos(theta * float(c["d"]))
                log += int(c["n"]) * np.log(np.maximum(np.abs(wave), 1e-300))
                odd ^= (wave < 0) & (int(c["n"]) % 2 == 1)
            with np.errstate(invalid="ignore", divide="ignore"):
                kernel = np.sin((2 * int(seen) - 1) * theta / 2) / np.sin(theta / 2)
            kernel[j == 0] = 2 * int(seen) - 1
            out.append((g, float(np.sum(np.where(odd, -1.0, 1.0) * np.exp(log) * kernel))))
        yield pd.DataFrame(out, columns=["_g", "part"])


def _exact_flips(packed: DataFrame) -> DataFrame:
    """(_g, p): one frequency per value that the sum can take within twelve deviations of what was seen."""
    reach = F.aggregate("cells", F.lit(0).cast("bigint"), lambda a, c: a + c["d"] * c["n"])
    spread = F.sqrt(F.aggregate("cells", F.lit(0.0), lambda a, c: a + c["d"] * c["d"] * c["n"]))
    length = F.least(2 * reach + 1, F.col("seen") + F.ceil(12 * spread) + 1)
    lines = (
        packed.select("_g", "cells", F.abs("total").alias("seen")).where("seen > 0").withColumn("length", length)
        .withColumn("_start", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("length") - 1, F.lit(_FREQUENCIES))))
        .withColumn("_size", F.least(F.lit(_FREQUENCIES), F.col("length") - F.col("_start")))
        .repartition("_g", "_start")
    )
    parts = lines.mapInPandas(_frequencies, "_g string, part double").groupBy("_g").agg(F.sum("part").alias("inside"))
    lengths = lines.groupBy("_g").agg(F.max("length").alias("length"))
    return parts.join(lengths, "_g").select("_g", F.greatest(F.lit(0.0), 1 - F.col("inside") / F.col("length")).alias("p"))


def sign_flip_test(
    pairs: DataFrame, by: list[str], diff: str, n: int | None = None, seed: int = 0
) -> DataFrame:
    """Paired sign-flip test on integer differences: pairs, mean difference, p, exact or from `n` replicas.

    Differences are reduced to a histogram of |d|. Flipping k equal differences is one binomial draw, whose
    characteristic function is cos(d t) ** k. Losses are capped integers, so a histogram has at most cap+1
    cells. A sum of 0 has p = 1.
    """
    hist = pairs.groupBy(*by, F.abs(diff).cast("bigint").alias("d")).agg(
        F.count(F.lit(1)).alias("n"), F.sum(diff).cast("bigint").alias("s")
    ).where("d is not null")
    packed = (
        hist.groupBy(*by)
        .agg(
            F.sum("n").alias("n"),
            F.sum("s").alias("total"),
            (F.sum("s") / F.sum("n")).alias("obs"),
            F.array_sort(F.collect_list(F.struct("d", "n"))).alias("cells"),
        )
        .withColumn("_g", F.to_json(F.struct(*by)) if by else F.lit("{}"))
    )
    if n is None:
        tested = _exact_flips(packed)
    else:
        counted = _blocks(packed.drop(*by), "_g", n, seed).mapInPandas(_flip, "_g string, extreme bigint")
        tested = counted.groupBy("_g").agg(((F.sum("extreme") + 1) / F.lit(float(n + 1))).alias("p"))
    return packed.join(tested, "_g", "left").select(
        *by,
        F.col("n").alias("pairs"),
        F.col("obs").alias("mean_diff"),
        F.coalesce("p", F.lit(1.0)).alias("p"),
    )


def mcnemar(pairs: DataFrame, by: list[str], flag_a: str, flag_b: str) -> DataFrame:
    """Exact McNemar test: a_only, b_only and the two-sided binomial p."""
    agg = pairs.groupBy(*by).agg(
        F.count_if(F.col(flag_a) & ~F.col(flag_b)).alias("a_only"),
        F.count_if(~F.col(flag_a) & F.col(flag_b)).alias("b_only"),
    )
    low = F.least("a_only", "b_only")
    return agg.withColumn("p", binomial_two_sided_p(low, F.col("a_only") + F.col("b_only")))

