"""Ratings and significance tests."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, py_round, query
from catalog.experiments import EXP, PAIRED, exp_games, pairs
from rookery.functions.numeric import half_even
from rookery.functions.scoring import expected_score, score_to_diff
from rookery.operators import experiments as ex
from rookery.operators import rating as ra
from rookery.operators import significance as sig


def _fit(cells: str, key: str) -> str:
    """CTEs fit(key, elo, ll, games, points) by scanning the whole rating grid."""
    p = "least(greatest(1.0 / (1 + pow(10.0, (level - r) / 400.0)), 1e-9), 1 - 1e-9)"
    return f"""
    grid AS (SELECT {key}, r, sum(points * ln({p}) + (n - points) * ln(1 - {p})) AS ll,
                    sum(n) AS games, sum(points) AS points
             FROM {cells}, (SELECT CAST(range AS INTEGER) AS r FROM range(-10, 3211)) GROUP BY ALL),
    fit AS (SELECT {key}, min(r) AS elo, arg_min(ll, r) AS ll, any_value(games) AS games, any_value(points) AS points
            FROM (SELECT *, max(ll) OVER (PARTITION BY {key}) AS m FROM grid)
            WHERE ll >= m - 1e-13 * abs(m) GROUP BY ALL)"""


@query(
    "elo_fit",
    "X01 X02 J13",
    f"""WITH {EXP}, cells AS (SELECT config, level, count(*) AS n, sum(score) AS points FROM eg GROUP BY ALL),
    {_fit('cells', 'config')}
    SELECT config, CAST(games AS BIGINT) AS games, points, elo, {py_round('ll', 6)} AS loglik FROM fit""",
)
def elo_fit(t: Tables):
    out = ra.elo_mle(exp_games(t), ["config"])
    return out.withColumn("loglik", half_even(F.col("loglik"), 6))


@query(
    "elo_fit_per_player",
    "X01 J13",
    f"""WITH cells AS (SELECT o_custkey AS player, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 200 + 900 AS level,
       count(*) AS n, sum(CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END) AS points
      FROM orders GROUP BY ALL),
    {_fit('cells', 'player')}
    SELECT player, CAST(games AS BIGINT) AS games, points, elo FROM fit""",
)
def elo_fit_per_player(t: Tables):
    g = t.orders.select(
        F.col("o_custkey").alias("player"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 200 + 900).alias("level"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1.0))
        .when(F.col("o_orderstatus") == "O", F.lit(0.0))
        .otherwise(F.lit(0.5))
        .alias("score"),
    )
    return ra.elo_mle(g, ["player"]).drop("loglik")


@query("elo_bootstrap", "X03")
def elo_bootstrap(t: Tables):
    """Interval per configuration; draws are random, so checked against brute force in tests."""
    return ra.bootstrap_ci(exp_games(t), ["config"], n=1000)


_CHOOSE = "lgamma({n} + 1) - lgamma({k} + 1) - lgamma({n} - {k} + 1)"


@query(
    "permutation_test",
    "X04",
    f"""WITH RECURSIVE {PAIRED},
    strata AS (
      SELECT pair, count(*) FILTER (score = 0) AS lost, count(*) FILTER (score = 0.5) AS drawn, count(*) FILTER (score = 1) AS won,
        count(*) FILTER (side = 'a') AS take, row_number() OVER (PARTITION BY pair ORDER BY level, color) AS k
      FROM paired GROUP BY pair, level, color),
    laws AS (
      SELECT pair, k, 2 * w + d AS h, sum(exp({_CHOOSE.format(n="won", k="w")} + {_CHOOSE.format(n="drawn", k="d")}
          + {_CHOOSE.format(n="lost", k="(take - w - d)")} - ({_CHOOSE.format(n="(won + drawn + lost)", k="take")}))) AS p
      FROM strata, unnest(range(0, won + 1)) AS t(w), unnest(range(0, drawn + 1)) AS u(d)
      WHERE w + d <= take AND take - w - d <= lost GROUP BY ALL HAVING p > 1e-20),
    folds AS (
      SELECT DISTINCT pair, CAST(0 AS BIGINT) AS k, CAST(0 AS BIGINT) AS h, 1.0::DOUBLE AS p FROM strata
      UNION ALL SELECT f.pair, f.k + 1, f.h + l.h, sum(f.p * l.p) FROM folds AS f JOIN laws AS l ON l.pair = f.pair AND l.k = f.k + 1
      WHERE f.p > 1e-20 GROUP BY ALL),
    seen AS (
      SELECT pair, count(*) FILTER (side = 'a') AS na, count(*) FILTER (side = 'b') AS nb, CAST(2 * sum(score) AS BIGINT) AS total,
        CAST(2 * sum(score) FILTER (side = 'a') AS BIGINT) AS half FROM paired GROUP BY pair),
    ends AS (SELECT pair, max(k) AS k FROM strata GROUP BY pair),
    tails AS (
      SELECT pair, sum(p) FILTER (abs(h * (na + nb) - total * na) >= abs(half * (na + nb) - total * na)) AS p
      FROM folds JOIN ends USING (pair, k) JOIN seen USING (pair) GROUP BY pair)
    SELECT pair, na AS games_a, nb AS games_b, {py_round("half / 2.0 / na - (total - half) / 2.0 / nb", 9)} AS delta_score,
      {py_round("least(p, 1.0)", 8)} AS p FROM seen JOIN tails USING (pair)""",
)
def permutation_test(t: Tables):
    """Exact p by convolution of the strata."""
    out = sig.permutation_test(ex.arm_cells(exp_games(t)), pairs(t))
    return out.withColumns({"delta_score": half_even(F.col("delta_score"), 9), "p": half_even(F.col("p"), 8)})


@query(
    "arm_difference",
    "X04 X11 J06",
    f"""WITH {PAIRED} SELECT pair, {py_round("avg(score) FILTER (side = 'a')", 9)} AS mean_a,
      {py_round("avg(score) FILTER (side = 'b')", 9)} AS mean_b,
      {py_round("avg(score) FILTER (side = 'a') - avg(score) FILTER (side = 'b')", 9)} AS delta
    FROM paired GROUP BY 1""",
)
def arm_difference(t: Tables):
    rows = ex.pair_rows(exp_games(t), pairs(t), arm="config")
    out = sig.delta_score(rows, ["pair"], "side", "score")
    return out.select("pair", *[half_even(F.col(c), 9).alias(c) for c in ("mean_a", "mean_b", "delta")])


# erfc by the all-positive series of erf, in log space; |error| < 1e-12
_ERFC = (
    "CASE WHEN {x} = 0 THEN 1.0::DOUBLE WHEN {x} > 6 THEN 0.0::DOUBLE ELSE 1 - 2 / sqrt(pi()) * exp(-{x} * {x}) * "
    "list_sum(list_transform(range(0, 200), lambda k: exp(k * ln(2) + (2 * k + 1) * ln({x}) "
    "- (lgamma(2 * k + 2) - k * ln(2) - lgamma(k + 1))))) END"
)


@query(
    "likelihood_ratio",
    "X05 U01",
    f"""WITH {PAIRED},
    cells AS (SELECT pair, grp, level, count(*) AS n, sum(score) AS points FROM (
        SELECT pair, side AS grp, level, score FROM paired UNION ALL SELECT pair, 'ab', level, score FROM paired)
      GROUP BY ALL),
    {_fit('cells', 'pair, grp')},
    s AS (SELECT pair, max(elo) FILTER (grp = 'a') AS elo_a, max(elo) FILTER (grp = 'b') AS elo_b,
            max(elo) FILTER (grp = 'ab') AS elo_joint,
            greatest(0.0::DOUBLE, 2 * (max(ll) FILTER (grp = 'a') + max(ll) FILTER (grp = 'b') - max(ll) FILTER (grp = 'ab'))) AS stat
          FROM fit GROUP BY 1),
    x AS (SELECT *, sqrt(stat / 2) AS x FROM s)
    SELECT pair, elo_a, elo_b, elo_joint, {py_round('stat', 5)} AS stat, {py_round(_ERFC.format(x='x'), 5)} AS p FROM x""",
)
def likelihood_ratio(t: Tables):
    out = sig.lr_test(ex.arm_cells(exp_games(t)), pairs(t))
    return out.withColumn("stat", half_even(F.col("stat"), 5)).withColumn("p", half_even(F.col("p"), 5))


@query(
    "mann_whitney",
    "X06 W05 U01",
    f"""WITH {PAIRED},
    r AS (SELECT pair, side, rank() OVER (PARTITION BY pair ORDER BY acpl)
            + (count(*) OVER (PARTITION BY pair, acpl) - 1) / 2.0::DOUBLE AS rk FROM paired WHERE acpl IS NOT NULL),
    a AS (SELECT pair, CAST(count(*) FILTER (side = 'a') AS DOUBLE) AS n1, CAST(count(*) FILTER (side = 'b') AS DOUBLE) AS n2,
            sum(rk) FILTER (side = 'a') AS r1 FROM r GROUP BY 1),
    z AS (SELECT *, r1 - n1 * (n1 + 1) / 2 AS u,
            (r1 - n1 * (n1 + 1) / 2 - n1 * n2 / 2) / sqrt(n1 * n2 * (n1 + n2 + 1) / 12) AS z FROM a),
    x AS (SELECT *, abs(z) / sqrt(2.0) AS x FROM z)
    SELECT pair, CAST(n1 AS BIGINT) AS n_a, CAST(n2 AS BIGINT) AS n_b, u, {py_round('z', 6)} AS z,
      {py_round(_ERFC.format(x='x'), 6)} AS p FROM x""",
)
def mann_whitney(t: Tables):
    rows = ex.pair_rows(exp_games(t), pairs(t), arm="config").where("acpl IS NOT NULL")
    out = sig.mann_whitney(rows, ["pair"], "side", "acpl", width=16.0)
    return out.withColumn("z", half_even(F.col("z"), 6)).withColumn("p", half_even(F.col("p"), 6))


def _event_pairs(t: Tables):
    """Losses of two arms on the same item: clicks against views of a user on a day."""
    key = ["user_id", "day"]
    e = t.events.select(
        "user_id", F.date_format("ts", "yyyy-MM-dd").alias("day"), "event_type",
        F.floor("value").alias("loss"),
    )
    a = e.where("event_type = 'click'").groupBy(*key).agg(F.max("loss").alias("a_loss"))
    b = e.where("event_type = 'view'").groupBy(*key).agg(F.max("loss").alias("b_loss"))
    return a.join(b, key)


EVENT_PAIRS = """
e AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, event_type, CAST(floor(value) AS BIGINT) AS loss FROM events),
ep AS (SELECT user_id, day, a_loss, b_loss FROM
  (SELECT user_id, day, max(loss) AS a_loss FROM e WHERE event_type = 'click' GROUP BY ALL)
  JOIN (SELECT user_id, day, max(loss) AS b_loss FROM e WHERE event_type = 'view' GROUP BY ALL) USING (user_id, day))"""


def flip_sql(pairs: str) -> str:
    """CTEs flip(n, total, p) of the differences d of the table `pairs`: the inverse transform of the product of cosines."""
    return f"""
    cell AS (SELECT abs(d) AS d, count(*) AS n FROM {pairs} WHERE d <> 0 GROUP BY 1),
    whole AS (SELECT count(d) AS n, CAST(coalesce(sum(d), 0) AS BIGINT) AS total FROM {pairs}),
    span AS (SELECT least(2 * CAST(sum(d * n) AS BIGINT) + 1, (SELECT abs(total) FROM whole) + CAST(ceil(12 * sqrt(sum(d * d * n))) AS BIGINT) + 1) AS m FROM cell),
    wave AS (
      SELECT j, 2 * pi() * j / m AS x, exp(sum(n * ln(abs(cos(d * (2 * pi() * j / m)))))) AS size,
        sum(CASE WHEN cos(d * (2 * pi() * j / m)) < 0 THEN n ELSE 0 END) % 2 AS odd
      FROM span, unnest(range(0, m)) AS t(j), cell GROUP BY j, m),
    flip AS (
      SELECT n, total, CASE WHEN total = 0 THEN 1.0::DOUBLE ELSE greatest(0.0::DOUBLE, 1 - (
        SELECT sum(CASE WHEN odd = 1 THEN -size ELSE size END
          * CASE WHEN j = 0 THEN 2 * abs(total) - 1 ELSE sin((2 * abs(total) - 1) * x / 2) / sin(x / 2) END) / any_value(m) FROM wave, span)) END AS p
      FROM whole)"""


@query(
    "sign_flip_test",
    "X07",
    f"""WITH {EVENT_PAIRS}, dp AS (SELECT a_loss - b_loss AS d FROM ep), {flip_sql("dp")}
    SELECT 'click-view' AS arm, n AS pairs, {py_round("total / n", 9)} AS mean_diff, {py_round("p", 8)} AS p FROM flip""",
)
def sign_flip_test(t: Tables):
    """Exact p by the characteristic function."""
    p = _event_pairs(t).withColumn("d", F.col("a_loss") - F.col("b_loss"))
    out = sig.sign_flip_test(p.withColumn("arm", F.lit("click-view")), ["arm"], "d")
    return out.withColumns({"mean_diff": half_even(F.col("mean_diff"), 9), "p": half_even(F.col("p"), 8)})


@query(
    "paired_difference",
    "X07 J07",
    f"WITH {EVENT_PAIRS} SELECT count(*) AS pairs, {py_round('avg(a_loss - b_loss)', 9)} AS mean_diff FROM ep",
)
def paired_difference(t: Tables):
    d = F.col("a_loss") - F.col("b_loss")
    return _event_pairs(t).agg(
        F.count(F.lit(1)).alias("pairs"), half_even(F.avg(d), 9).alias("mean_diff")
    )


@query(
    "mcnemar",
    "X08",
    f"""WITH {EVENT_PAIRS},
    c AS (SELECT pmod2 AS arm, count(*) FILTER (a_loss >= 20 AND b_loss < 20) AS a_only,
                 count(*) FILTER (a_loss < 20 AND b_loss >= 20) AS b_only
          FROM (SELECT *, user_id % 7 AS pmod2 FROM ep) GROUP BY 1)
    SELECT arm, a_only, b_only, CASE WHEN a_only + b_only = 0 THEN 1.0::DOUBLE ELSE
      {py_round('''least(1.0, 2 * list_sum(list_transform(range(0, least(a_only, b_only) + 1),
        lambda k: exp(lgamma(a_only + b_only + 1) - lgamma(k + 1) - lgamma(a_only + b_only - k + 1)
          - (a_only + b_only) * ln(2)))))''', 9)} END AS p FROM c""",
)
def mcnemar(t: Tables):
    p = _event_pairs(t).select(
        F.pmod("user_id", F.lit(7)).alias("arm"), (F.col("a_loss") >= 20).alias("fa"),
        (F.col("b_loss") >= 20).alias("fb"),
    )
    return sig.mcnemar(p, ["arm"], "fa", "fb").withColumn("p", half_even(F.col("p"), 9))


@query(
    "expected_scores",
    "X09",
    f"""SELECT o_orderkey, {py_round('1 / (1 + pow(10.0, (o_totalprice / 200 - 1500) / 400.0))', 9)} AS e,
      {py_round("-400 * log10(1 / least(greatest(o_totalprice / 500000, 0.01), 0.99) - 1)", 6)} AS diff FROM orders""",
)
def expected_scores(t: Tables):
    return t.orders.select(
        "o_orderkey",
        half_even(expected_score(F.lit(1500.0), F.col("o_totalprice") / 200), 9).alias("e"),
        half_even(score_to_diff(F.col("o_totalprice") / 500000), 6).alias("diff"),
    )


@query(
    "performance_rating",
    "X10",
    f"""WITH RECURSIVE
    g AS (SELECT o_custkey AS player, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 200 + 900 AS opp,
      CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS s FROM orders),
    k AS (SELECT player, opp, count(*) AS n, sum(s) AS s FROM g GROUP BY ALL),
    b AS (SELECT player, list({{'o': opp, 'n': n}} ORDER BY opp) AS cells, CAST(sum(n) AS DOUBLE) AS n, sum(s) AS s,
            CAST(sum(opp * n) AS DOUBLE) / sum(n) AS avg FROM k GROUP BY 1),
    it AS (SELECT 0 AS i, player, avg - 1200 AS lo, avg + 1200 AS hi, cells, s, avg, n FROM b
      UNION ALL
      SELECT i + 1, player,
        CASE WHEN list_sum(list_transform(cells, lambda c: c.n / (1 + pow(10.0, (c.o - (lo + hi) / 2) / 400.0)))) - s
          + 0.5 * (1 / (1 + pow(10.0, (avg - (lo + hi) / 2) / 400.0)) - 0.5) > 0 THEN lo ELSE (lo + hi) / 2 END,
        CASE WHEN list_sum(list_transform(cells, lambda c: c.n / (1 + pow(10.0, (c.o - (lo + hi) / 2) / 400.0)))) - s
          + 0.5 * (1 / (1 + pow(10.0, (avg - (lo + hi) / 2) / 400.0)) - 0.5) > 0 THEN (lo + hi) / 2 ELSE hi END,
        cells, s, avg, n FROM it WHERE i < 60),
    f AS (SELECT *, (s + 0.5) / (n + 1) AS p FROM it WHERE i = 60),
    h AS (SELECT *, sqrt(greatest(p * (1 - p), 1e-9) / n) AS se FROM f)
    SELECT player, CAST(n AS BIGINT) AS games, {py_round('(lo + hi) / 2', 5)} AS estimate,
      {py_round('avg - 400 * log10(1 / least(greatest(p - 1.96 * se, 0.01), 0.99) - 1)', 5)} AS lo95,
      {py_round('avg - 400 * log10(1 / least(greatest(p + 1.96 * se, 0.01), 0.99) - 1)', 5)} AS hi95 FROM h""",
)
def performance_rating(t: Tables):
    g = t.orders.select(
        F.col("o_custkey").alias("player"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 200 + 900).alias("opp"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1.0))
        .when(F.col("o_orderstatus") == "O", F.lit(0.0))
        .otherwise(F.lit(0.5))
        .alias("s"),
    )
    out = ra.performance_rating(g, ["player"], "opp", "s")
    return out.select(
        "player", "games", *[half_even(F.col(c), 5).alias(c) for c in ("estimate", "lo95", "hi95")]
    )


@query(
    "rating_interpolation",
    "J12",
    """WITH a AS (SELECT * FROM (VALUES (1100, 'maia1', 'blitz', 1387.0::DOUBLE), (1100, 'maia1', 'rapid', 1494.0),
      (1100, 'maia1', 'classical', 1651.0), (1500, 'maia5', 'blitz', 1453.0), (1500, 'maia5', 'rapid', 1625.0),
      (1500, 'maia5', 'classical', 1720.0), (1900, 'maia9', 'blitz', 1612.0), (1900, 'maia9', 'rapid', 1773.0),
      (1900, 'maia9', 'classical', 1731.0)) v(w, bot, pool, rating)),
    iv AS (SELECT *, lead(w) OVER q AS w2, lead(rating) OVER q AS r2 FROM a WINDOW q AS (PARTITION BY pool ORDER BY w)),
    x AS (SELECT event_id, 1000 + 50 * CAST(floor(value) AS BIGINT) AS x,
      CASE user_id % 3 WHEN 0 THEN 'blitz' WHEN 1 THEN 'rapid' ELSE 'classical' END AS pool FROM events)
    SELECT event_id, x.x, x.pool, CASE WHEN x.x = w THEN rating WHEN w2 IS NOT NULL THEN rating + (x.x - w) / CAST(w2 - w AS DOUBLE) * (r2 - rating) END AS rating,
      CASE WHEN x.x = w THEN false WHEN w2 IS NOT NULL THEN true END AS estimated,
      CASE WHEN x.x = w THEN 'measured from lichess bot ' || bot
        WHEN w2 IS NOT NULL THEN 'linearly interpolated between maia-' || w || printf(' (%.0f)', rating) || ' and maia-' || w2 || printf(' (%.0f)', r2)
        ELSE 'outside the interpolation range' END AS note
    FROM x LEFT JOIN iv ON iv.pool = x.pool AND x.x >= w AND (x.x < w2 OR (w2 IS NULL))""",
)
def rating_interpolation(t: Tables):
    pool = (
        F.when(F.col("user_id") % 3 == 0, F.lit("blitz"))
        .when(F.col("user_id") % 3 == 1, F.lit("rapid"))
        .otherwise(F.lit("classical"))
    )
    x = t.events.select("event_id", (F.floor("value") * 50 + 1000).alias("x"), pool.alias("pool"))
    return ra.interpolate(x, "x", "pool", ra.rating_anchors(t.spark))
