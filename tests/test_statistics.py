"""Rating fits and tests against published results, brute force and properties."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.operators import experiments as ex
from rookery.operators import ordered as od
from rookery.operators import rating as ra
from rookery.operators import significance as sig
from rookery.operators import suite as su

# (level, colour, score, mean loss) of 80 games, five configurations
GAMES = {
    "sonnet-harness": [
        (1100, "b", 0.5, 41.451), (1100, "b", 1, 24.771), (1100, "w", 0.5, 63.792), (1100, "w", 1, 32.846),
        (1300, "b", 0.5, 37.292), (1300, "b", 1, 49.158), (1300, "w", 0, 49.232), (1300, "w", 1, 34.083),
        (1500, "b", 0, 51.162), (1500, "b", 0.5, 31.896), (1500, "w", 1, 14.654), (1500, "w", 1, 52.87),
        (1700, "b", 0, 56.611), (1700, "b", 0, 76.021), (1700, "w", 0.5, 23.143), (1700, "w", 1, 48.552),
        (1900, "b", 0.5, 33.692), (1900, "b", 0.5, 47.156), (1900, "w", 0, 71.75), (1900, "w", 0, 82.522),
    ],
    "sonnet-naive": [
        (1100, "b", 0, 85.312), (1100, "b", 0, 140.308), (1100, "w", 0, 103.167), (1100, "w", 0, 135.0),
        (1500, "b", 0, 46.125), (1500, "b", 0, 130.304), (1500, "w", 0, 131.0), (1500, "w", 0, 146.0),
        (1900, "b", 0, 82.0), (1900, "b", 0, 192.235), (1900, "w", 0, 86.722), (1900, "w", 0, 101.444),
    ],
    "haiku-harness": [
        (1100, "b", 0, 135.0), (1100, "b", 1, 57.628), (1100, "w", 0, 71.25), (1100, "w", 1, 22.75),
        (1500, "b", 0.5, 32.048), (1500, "b", 1, 86.259), (1500, "w", 0, 76.808), (1500, "w", 1, 85.75),
        (1900, "b", 0, 109.429), (1900, "b", 1, 44.45), (1900, "w", 0, 77.897), (1900, "w", 1, 62.824),
    ],
    "haiku-naive": [
        (1100, "b", 0, 87.211), (1100, "b", 0, 107.5), (1100, "b", 0, 139.1), (1100, "b", 0, 326.125),
        (1100, "w", 0, 102.667), (1100, "w", 0, 144.75), (1100, "w", 0, 290.2), (1100, "w", 0, 290.2),
        (1500, "b", 0, 107.957), (1500, "b", 0, 164.333), (1500, "b", 0, 198.667), (1500, "b", 0, 229.2),
        (1500, "w", 0, 144.545), (1500, "w", 0, 180.9), (1500, "w", 0, 371.643), (1500, "w", 0, 389.5),
        (1900, "b", 0, 164.111), (1900, "b", 0, 219.0), (1900, "b", 0, 224.273), (1900, "b", 0, 263.4),
        (1900, "w", 0, 101.067), (1900, "w", 0, 254.5), (1900, "w", 0, 296.6), (1900, "w", 0, 299.182),
    ],
    "haiku-harness-ctx3": [
        (1100, "b", 0.5, 49.913), (1100, "b", 1, 82.97), (1100, "w", 1, 39.842), (1100, "w", 1, 46.8),
        (1500, "b", 0, 109.257), (1500, "b", 1, 32.0), (1500, "w", 0, 58.829), (1500, "w", 0, 110.079),
        (1900, "b", 1, 48.357), (1900, "b", 1, 56.926), (1900, "w", 0, 189.105), (1900, "w", 1, 40.393),
    ],
}


@pytest.fixture(scope="module")
def games(spark):
    rows = [
        (cfg, cfg.split("-")[0], lv, col, float(s), a, 0.1)
        for cfg, gs in GAMES.items() for lv, col, s, a in gs
    ]
    return spark.createDataFrame(
        rows, "config string, model string, level int, color string, score double, acpl double, cost_usd double"
    ).cache()


def test_published_ratings(games):
    got = {r.config: (r.elo, r.games) for r in ra.elo_mle(games, ["config"]).collect()}
    assert got == {
        "haiku-harness": (1552, 12), "haiku-harness-ctx3": (1659, 12), "haiku-naive": (-10, 24),
        "sonnet-harness": (1528, 20), "sonnet-naive": (-10, 12),
    }


def test_published_likelihood_ratios(games):
    got = {r.pair: r.stat for r in sig.lr_test(ex.arm_cells(games), ex.harness_pairs(games)).collect()}
    want = {"haiku": 23.6011, "haiku ctx3": 29.5227, "haiku ctx3 vs ctx2": 0.3062, "sonnet": 16.3448}
    assert set(got) == set(want)
    assert all(abs(got[k] - v) < 1e-3 for k, v in want.items())


def test_published_mann_whitney(games):
    rows = ex.pair_rows(games, ex.harness_pairs(games), arm="config")
    got = {r.pair: (r.z, r.p) for r in sig.mann_whitney(rows, ["pair"], "side", "acpl", width=8.0).collect()}
    want = {"haiku": (-4.49675, 6.900e-06), "haiku ctx3": (-4.12761, 3.666e-05),
            "haiku ctx3 vs ctx2": (-0.57735, 0.56370), "sonnet": (-3.75278, 1.7489e-04)}
    for k, (z, p) in want.items():
        assert abs(got[k][0] - z) < 1e-4 and abs(got[k][1] - p) < 1e-3 * max(p, 1e-3)


def test_published_permutation(games):
    got = {r.pair: (r.delta_score, r.p) for r in sig.permutation_test(ex.arm_cells(games), ex.harness_pairs(games)).collect()}
    want = {"haiku": (0.541667, 4.5e-4), "haiku ctx3": (0.625, 5e-5), "haiku ctx3 vs ctx2": (0.083333, 0.848),
            "sonnet": (0.541667, 1.05e-3)}
    for k, (d, p) in want.items():
        assert abs(got[k][0] - d) < 1e-6
        assert abs(got[k][1] - p) < 4 * math.sqrt(p * (1 - p) / 20000) + 2e-4


def test_published_intervals_are_near(games):
    got = {r.config: (r.lo95, r.hi95) for r in ra.bootstrap_ci(games, ["config"], n=1000, seed=1).collect()}
    want = {"haiku-harness": (1153, 1960), "sonnet-harness": (1332, 1716), "haiku-harness-ctx3": (1321, 2043)}
    for k, (lo, hi) in want.items():
        assert abs(got[k][0] - lo) <= 60 and abs(got[k][1] - hi) <= 80
    assert got["haiku-naive"] == (-10, -10)


def test_rating_edges(spark):
    rows = [("even", 1500, s) for s in (1.0, 0.0, 1.0, 0.0)] + [("won", 1500, 1.0)] * 4
    got = {r.g: r.elo for r in ra.elo_mle(spark.createDataFrame(rows, "g string, level int, score double"), ["g"]).collect()}
    assert abs(got["even"] - 1500) <= 10 and got["won"] == 3210


def test_permutation_matches_brute_force(spark):
    """Exact p by enumerating label assignments of a small fixture."""
    from itertools import combinations

    a, b = [1.0, 1.0, 0.5, 1.0], [0.0, 0.5, 0.0, 0.5]
    pool = a + b
    obs = sum(a) / 4 - sum(b) / 4
    hits = [abs(sum(pool[i] for i in c) / 4 - (sum(pool) - sum(pool[i] for i in c)) / 4) >= obs - 1e-12 for c in combinations(range(8), 4)]
    exact = sum(hits) / len(hits)
    rows = [("A", 1500, "white", s) for s in a] + [("B", 1500, "white", s) for s in b]
    g = spark.createDataFrame(rows, "config string, level int, color string, score double").withColumns(
        {"cost_usd": F.lit(0.0), "acpl": F.lit(1.0)}
    )
    pairs = spark.createDataFrame([("p", "A", "B")], "pair string, a string, b string")
    cells = ex.arm_cells(g)
    assert abs(sig.permutation_test(cells, pairs).first().p - exact) < 1e-12
    assert abs(sig.permutation_test(cells, pairs, n=20000).first().p - exact) < 4 * math.sqrt(exact * (1 - exact) / 20000) + 1e-4


def test_exact_law_of_a_stratum_adds_up_at_every_size():
    for lost, drawn, won, take in ((3, 2, 4, 5), (0, 0, 7, 3), (5, 0, 0, 5), (40_000, 3_000, 55_000, 47_000)):
        first, p = sig._stratum(lost, drawn, won, take)
        half = first + np.arange(len(p))
        assert abs(p.sum() - 1) < 1e-8 and abs((p * half).sum() - take * (2 * won + drawn) / (lost + drawn + won)) < 1e-3


def test_sign_flip_matches_brute_force(spark):
    from itertools import product

    d = [3, -1, 4, 4, -2, 6, 3, 0, 5]
    obs = abs(sum(d) / len(d))
    exact = sum(abs(sum(s * x for s, x in zip(f, d))) / len(d) >= obs - 1e-9 for f in product((1, -1), repeat=len(d))) / 2 ** len(d)
    df = spark.createDataFrame([("x", v) for v in d], "g string, d int")
    row = sig.sign_flip_test(df, ["g"], "d").first()
    assert row.pairs == 9 and abs(row.p - exact) < 1e-10
    drawn = sig.sign_flip_test(df, ["g"], "d", n=40000).first()
    assert abs(drawn.p - exact) < 4 * math.sqrt(exact * (1 - exact) / 40000) + 1e-4


def test_sign_flip_edges(spark):
    rows = [("zero", 0), ("zero", 0), ("even", 3), ("even", -3), ("far", 7), ("null", None)] + [("big", 1000)] * 60
    got = {r.g: (r.pairs, r.p) for r in sig.sign_flip_test(spark.createDataFrame(rows, "g string, d int"), ["g"], "d").collect()}
    assert got["zero"] == (2, 1.0) and got["even"] == (2, 1.0) and abs(got["far"][1] - 1) < 1e-12 and "null" not in got
    assert got["big"][0] == 60 and got["big"][1] < 1e-9


def test_suite_comparison(spark):
    cols = "src string, san string, sf_best string, claude_candidates array<string>, cost double, seconds double, cp_loss int"
    a = spark.createDataFrame([(str(i), "e4", "e4", ["e4"], 0.01, 1.0, 0) for i in range(20)], cols)
    b = spark.createDataFrame([(str(i), "a3", "e4", ["a3"], 0.01, 1.0, 150) for i in range(20)], cols)
    row = su.compare_suites(a, b, n=2000).first()
    assert row.mean_diff == -150 and row.p < 0.01 and row.a.proposer_recall == 1.0


@pytest.mark.parametrize("n, sort_rows", [(1, 10), (70, 3), (300, 10_000), (2000, 5), (5000, 5)])
def test_least_hashes_are_those_of_a_sort(spark, n, sort_rows):
    df = spark.range(2000).select(F.col("id"), F.md5((F.col("id") % 900).cast("string").cast("binary")).alias("h"))
    want = {r.id for r in df.orderBy("h", "id").limit(n).collect()}
    got = [r.id for r in su.least_hashes(df, "h", n, ["id"], sort_rows).collect()]
    assert len(got) == len(want) and set(got) == want


def test_suite_sample_takes_a_key_once(spark):
    rows = [(f"s{i}", f"k{i % 40}", 200 if i % 3 == 0 else None if i % 7 == 0 else 10) for i in range(400)]
    df = spark.createDataFrame(rows, "src string, epd string, cpl int")
    for n in (1, 10, 50, 1_000_000):
        got = su.sample_suite(df, n, seed=3).collect()
        hard = [r for r in got if r.pool == "hard"]
        assert len({r.epd for r in got}) == len(got) and len(hard) == min(max(1, n // 2), 40)
        assert all((r.cpl >= 150) == (r.pool == "hard") for r in got) and len(got) <= max(n, 2)


def test_performance_rating(spark):
    rows = [(f"n{n}", 1500.0, 0.5) for n in (4, 10, 40) for _ in range(n)]
    df = spark.createDataFrame(rows, "g string, opp double, score double")
    got = {r.g: (round(r.estimate), round(r.lo95), round(r.hi95)) for r in ra.performance_rating(df, ["g"], "opp", "score").collect()}
    assert got == {"n4": (1500, 702, 2298), "n10": (1500, 1248, 1752), "n40": (1500, 1389, 1611)}
    empty = spark.createDataFrame([], "opp double, score double")
    with pytest.raises(Exception, match="at least one game"):
        ra.performance_rating(empty, [], "opp", "score").collect()


def test_performance_rating_is_monotone(spark):
    rows = [(k, 1500.0, s) for k, s in (("lo", 0.0), ("mid", 0.5), ("hi", 1.0)) for _ in range(10)]
    df = spark.createDataFrame(rows, "g string, opp double, score double")
    got = {r.g: r.estimate for r in ra.performance_rating(df, ["g"], "opp", "score").collect()}
    assert got["lo"] < got["mid"] < got["hi"]


def test_interpolation(spark):
    df = spark.createDataFrame([(1100, "rapid"), (1300, "rapid"), (500, "rapid"), (1900, "blitz")], "x int, pool string")
    got = {(r.x, r.pool): (r.rating, r.estimated) for r in ra.interpolate(df, "x", "pool", ra.rating_anchors(spark)).collect()}
    assert got[(1100, "rapid")] == (1494.0, False) and got[(1900, "blitz")] == (1612.0, False)
    assert got[(1300, "rapid")] == (1559.5, True) and got[(500, "rapid")] == (None, None)


def test_hot_keys_equal_plain_windows(spark):
    """One key with a third of the rows, tiny chunks: chunked operators equal one-task windows."""
    from pyspark.sql import Window

    from rookery.operators import windows as wi

    rng = random.Random(3)
    rows, ply = [], {}
    for _ in range(900):
        k = 0 if rng.random() < 0.34 else rng.randrange(1, 30)
        ply[k] = ply.get(k, 0) + 1
        rows.append((k, ply[k], rng.choice([-900, -600, 0, 600, 700, 650]), rng.random() < 0.2))
    df = spark.createDataFrame(rows, "k int, ply int, v int, hit boolean").repartition(5)
    w = Window.partitionBy("k").orderBy("ply")
    up = w.rowsBetween(Window.unboundedPreceding, 0)
    chunk = wi.ply_chunk(size=7)
    hit = F.when(F.col("hit"), F.col("ply"))
    same = lambda a, b: sorted(map(tuple, a.collect()), key=str) == sorted(map(tuple, b.collect()), key=str)
    assert same(od.ordinal(df, ["k"], ["ply"], chunk, "x").select("k", "ply", "x"), df.select("k", "ply", F.row_number().over(w).alias("x")))
    assert same(od.last_seen(df, ["k"], ["ply"], chunk, hit, "x").select("k", "ply", "x"), df.select("k", "ply", F.last(hit, True).over(up).alias("x")))
    assert same(od.running_sum(df, ["k"], ["ply"], chunk, F.col("v"), "x").select("k", "ply", "x"), df.select("k", "ply", F.sum("v").over(up).alias("x")))
    for off, fn in ((1, F.lead), (-1, F.lag)):
        assert same(od.neighbour(df, ["k"], ["ply"], chunk, {"x": F.col("v")}, off).select("k", "ply", "x"), df.select("k", "ply", fn("v").over(w).alias("x")))
    want, run = [], {}
    for k, p, v, _ in sorted(rows):
        s = 1 if v >= 500 else -1 if v <= -500 else 0
        side, n = run.get(k, (0, 0))
        run[k] = (s, n + 1 if s and s == side else (1 if s else 0))
        want.append((k, p, run[k][1]))
    got = wi.streaks(df, ["k"], ["ply"], wi.side_of(F.col("v"), 500), chunk).select("k", "ply", "streak")
    assert sorted(map(tuple, got.collect())) == sorted(want)
    best = od.top_k(df, ["k"], [F.desc("v"), F.asc("ply")], 4)
    plain = df.withColumn("rank", F.row_number().over(Window.partitionBy("k").orderBy(F.desc("v"), F.asc("ply")))).where("rank <= 4")
    assert same(best.select("k", "ply", "rank"), plain.select("k", "ply", "rank"))


def test_hypergeometric_draws_small_and_huge():
    import numpy as np

    rng = np.random.default_rng(8)
    got = np.bincount(sig.hypergeometric(rng, 6, 9, np.full(200_000, 7)).astype(int), minlength=7) / 200_000
    want = [math.comb(6, k) * math.comb(9, 7 - k) / math.comb(15, 7) for k in range(7)]
    assert np.abs(got - want).max() < 0.005
    for good, bad, draw in ((2 * 10**9, 10, 10**9), (10**10, 3 * 10**10, 10**10), (3, 10**10, 10**9), (0, 5, 3), (5, 0, 3)):
        x = sig.hypergeometric(rng, good, bad, np.full(20_000, draw))
        n = good + bad
        mean = draw * good / n
        sd = math.sqrt(draw * (good / n) * (bad / n) * (n - draw) / max(n - 1, 1))
        assert x.min() >= max(0, draw - bad) and x.max() <= min(good, draw)
        assert abs(x.mean() - mean) <= 5 * sd / math.sqrt(20_000) + 1e-9 * n and abs(x.std() - sd) <= 0.05 * sd + 1e-9


def test_large_stratum_is_exact_and_as_wide_as_its_spread():
    first, p = sig._stratum(60_000, 60_000, 60_000, 90_000)
    half = first + np.arange(len(p))
    assert abs(p.sum() - 1) < 1e-13 and abs((p * half).sum() - 90_000) < 1e-7
    assert len(p) < 10_000 and p[0] > 0 and p[-1] > 0
