"""Scalar rules against fixed cases."""

import hashlib
import math
import random

from pyspark.sql import functions as F

from rookery.functions import names, numeric, scoring, splits, text
from rookery.sources import tables


def values(spark, col, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(col).collect()]


def test_half_even_equals_python_round(spark):
    rng = random.Random(5)
    xs = [2.45, 2.25, 2.35, 2.675, 0.5, 1.5, -2.5, -0.25, 1e-9, 0.0, 1234567.125]
    xs += [rng.uniform(-500, 500) for _ in range(300)] + [rng.randrange(-4000, 4000) / 40 for _ in range(300)]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    for d in (0, 1, 2, 3):
        got = [r[0] for r in df.select(numeric.half_even(F.col("x"), d)).collect()]
        assert got == [float(round(x, d)) for x in xs]


def test_fixed_text(spark):
    got = values(spark, numeric.fixed_text(F.col("x"), 0), [(0.5,), (1.5,), (66.5,), (None,)], "x double")
    assert got == ["0", "2", "66", None]


def test_erfc_and_p_values(spark):
    xs = [0.0, 0.1, 1.0, 2.5, 5.0]
    got = values(spark, numeric.erfc(F.col("x")), [(x,) for x in xs], "x double")
    assert got == [math.erfc(x) for x in xs]


def test_binomial_p(spark):
    rows = [(3, 25), (4, 14), (0, 0), (5, 10), (0, 40), (480, 1000)]
    got = values(spark, numeric.binomial_two_sided_p(F.col("k"), F.col("n")), rows, "k bigint, n bigint")
    want = [min(1.0, 2 * sum(math.comb(n, i) for i in range(k + 1)) / 2**n) if n else 1.0 for k, n in rows]
    assert all(abs(a - b) < 1e-9 for a, b in zip(got, want))
    assert abs(got[0] - 1.57e-4) < 1e-6 and abs(got[1] - 0.180) < 1e-3


def test_bands(spark):
    got = values(spark, scoring.band(F.col("x")), [(None,), (10,), (60,), (150,), (400,)], "x int")
    assert got == [None, "ok", "inaccuracy", "mistake", "blunder"]


def test_player_names(spark):
    rows = [
        ("engine-ctx(d1,sonnet)",), ("stockfish(elo1320)",), ("random#A",), ("naive(haiku)#B",),
        ("stockfish(skill5,full)",), ("random",),
    ]
    got = values(spark, names.parse_player(F.col("n")), rows, "n string")
    assert [(g.kind, g.model, g.config) for g in got] == [
        ("engine-ctx", "sonnet", {"depth": "1"}), ("stockfish", None, {"elo": "1320"}), ("random", None, {}),
        ("naive", "haiku", {}), ("stockfish", None, {"skill": "5", "strength": "full"}), ("random", None, {}),
    ]


def test_started_at(spark):
    rows = [("20260924_215601_exp1",), ("label",), ("20261399_000000_x",)]
    got = values(spark, names.started_at(F.col("n")).cast("string"), rows, "n string")
    assert got == ["2026-09-24 21:56:01", None, None]


def test_json_inside_text(spark):
    rows = [
        ('{"a": 1}',), ('```json\n{"a": 1}\n```',), ('Sure: {"a": 1} done',), ('{"a": 1}\nextra {"b": 2}',),
        ('use {braces} then {"a": 1}',), ("plain prose",), (None,), ('[1, {"a": 1}]',),
    ]
    got = values(spark, F.get_json_object(text.extract_json(F.col("t")), "$.a"), rows, "t string")
    assert got == ["1"] * 5 + [None, None, "1"]


def test_split_equals_hash_rule(spark):
    rows = [(f"run{i % 7}", i) for i in range(200)]
    got = values(spark, splits.group_split(F.col("r"), F.col("g")), rows, "r string, g int")
    rule = lambda r, g: int(hashlib.sha1(f"{r}:{g}".encode()).hexdigest(), 16) % 10
    assert got == [{0: "test", 1: "val"}.get(rule(*x), "train") for x in rows]


def test_score_wording(spark):
    rows = [(None,), (9500,), (-9500,), (0,), (-500,), (125,)]
    got = values(spark, scoring.score_wording(F.col("x")), rows, "x int")
    assert got == ["?", "mates", "gets mated", "material level", "loses 5.0 pawns", "wins 1.2 pawns"]


def test_tablebase_reply(spark):
    doc = (
        '{"category": "win", "dtz": 1, "moves": [{"san": "Kd6", "category": "loss", "dtz": -19},'
        '{"san": "Kf6", "category": "loss", "dtz": -7}, {"san": "Kd4", "category": "draw", "dtz": 0}]}'
    )
    df = tables.parse_tablebase(spark.createDataFrame([(doc,), ('{"category": "x"}',)], "j string"), "j")
    row = df.select("wdl", tables.verdict(F.col("wdl")).alias("v"), tables.best_moves(F.col("moves")).alias("b")).collect()
    assert [(r.wdl, r.v, r.b) for r in row] == [(2, "WIN", ["Kf6", "Kd6"])]


def test_claims_and_names(spark):
    legal = F.array(F.lit("O-O"), F.lit("e4"))
    got = values(spark, text.check_claim(F.col("t"), legal), [(" e4! ",), ("0-0",), ("",), ("Ke2",)], "t string")
    assert [(g.move, g.reason) for g in got] == [
        ("e4", ""), ("O-O", ""), (None, "empty move"), (None, "illegal in this position")
    ]


def test_binomial_tail_at_all_sizes(spark):
    rows = [(k, n) for n in (0, 1, 2, 3, 10, 37, 200, 1001) for k in sorted({0, n // 7, n // 3, n // 2}) if k <= n // 2]
    df = spark.createDataFrame(rows, "k long, n long")
    got = df.select("k", "n", numeric.binomial_two_sided_p(F.col("k"), F.col("n")).alias("p")).collect()
    for r in got:
        want = min(1.0, 2 * sum(math.comb(r.n, j) for j in range(r.k + 1)) / 2**r.n)
        assert math.isclose(r.p, want, rel_tol=1e-9), (r, want)
    n, z = 10**10, 3.0
    huge = spark.createDataFrame([(n // 2 - int(z * math.sqrt(n) / 2), n)], "k long, n long")
    p = huge.select(numeric.binomial_two_sided_p(F.col("k"), F.col("n"))).first()[0]
    assert math.isclose(p, math.erfc(z / math.sqrt(2)), rel_tol=1e-3)


def test_long_prefixes_count(spark):
    from rookery.operators.retrieval import longest_prefix

    plans = spark.createDataFrame([("red", "short"), ("red widget large", "long")], "prefix string, plan string")
    names_ = spark.createDataFrame([("red widget large set",), ("red sea",), ("blue",)], "name string")
    assert {r.name: r.plan for r in longest_prefix(names_, "name", plans).collect()} == {
        "red widget large set": "long", "red sea": "short", "blue": None}
