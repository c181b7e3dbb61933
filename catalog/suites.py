"""Suite sampling, scoring, metrics, comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, py_round, query
from catalog.tests import flip_sql
from rookery.functions.numeric import half_even
from rookery.operators import suite as su
from rookery.operators.ordered import first


@query(
    "suite_sample",
    "O04",
    """WITH r AS (SELECT event_type || ':' || event_id AS src, user_id || '/' || CAST(floor(value / 4) AS BIGINT) AS epd,
        CAST(floor(value * 10) AS BIGINT) AS cpl, md5('7:' || event_type || ':' || event_id) AS o FROM events),
      h AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY epd ORDER BY o, src) AS k FROM r WHERE cpl >= 150) WHERE k = 1 ORDER BY o, src LIMIT 50),
      e AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY epd ORDER BY o, src) AS k FROM r WHERE cpl < 150 AND epd NOT IN (SELECT epd FROM h)) WHERE k = 1
            ORDER BY o, src LIMIT 100 - (SELECT count(*) FROM h))
    SELECT src, 'hard' AS pool FROM h UNION ALL SELECT src, 'easy' FROM e""",
)
def suite_sample(t: Tables):
    d = t.events.select(
        F.concat_ws(":", "event_type", "event_id").alias("src"),
        F.concat_ws("/", "user_id", F.floor(F.col("value") / 4)).alias("epd"),
        F.floor(F.col("value") * 10).alias("cpl"),
    )
    return su.sample_suite(d, 100, seed=7).select("src", "pool")


def _results(t: Tables):
    return t.events.select(
        "event_id", "event_type", F.concat(F.lit("m"), F.pmod("user_id", F.lit(4)).cast("string")).alias("san"),
        F.concat(F.lit("m"), F.pmod("event_id", F.lit(4)).cast("string")).alias("sf_best"),
        F.array(F.lit("m0"), F.concat(F.lit("m"), F.pmod("user_id", F.lit(3)).cast("string"))).alias("claude_candidates"),
        F.col("value").alias("cost"), (F.col("value") * 2).alias("seconds"),
        F.floor(F.col("value") * 20).alias("cp_loss"),
    )


@query(
    "suite_metrics",
    "A10 J17 S09",
    f"""SELECT event_type, count(*) AS positions, {py_round('avg(CAST(floor(value * 20) AS BIGINT))', 6)} AS mean_cp_loss,
      {py_round('avg(CAST(user_id % 4 = event_id % 4 AS INT))', 6)} AS best_move_hit,
      {py_round('avg(CAST(floor(value * 20) >= 200 AS INT))', 6)} AS blunder_rate,
      {py_round('avg(CAST(event_id % 4 = 0 OR event_id % 4 = user_id % 3 AS INT))', 6)} AS proposer_recall,
      {py_round('sum(value)', 4)} AS cost_usd, {py_round('avg(value)', 6)} AS usd_per_pos, {py_round('avg(value * 2)', 6)} AS s_per_pos
    FROM events GROUP BY 1""",
)
def suite_metrics(t: Tables):
    out = su.suite_metrics(_results(t), ["event_type"])
    r = lambda c, d=6: half_even(F.col(c), d).alias(c)
    return out.select(
        "event_type", "positions", r("mean_cp_loss"), r("best_move_hit"), r("blunder_rate"),
        r("proposer_recall"), r("cost_usd", 4), r("usd_per_pos"), r("s_per_pos"),
    )


@query(
    "suite_scores",
    "A10",
    """SELECT event_id, CAST(CASE WHEN event_type = 'error' THEN 1000 WHEN event_type = 'purchase' THEN 0
      ELSE greatest(0, least(1000, CAST(floor(value * 50) AS BIGINT) - user_id * 5)) END AS BIGINT) AS cp_loss FROM events""",
)
def suite_scores(t: Tables):
    res = t.events.select("event_id", F.when(F.col("event_type") != "error", F.lit("e4")).alias("san"))
    ev = t.events.select(
        "event_id", F.floor(F.col("value") * 50).alias("sf_eval"), (F.col("user_id") * 5).alias("after"),
        (F.col("event_type") == "purchase").alias("mates"),
    )
    return su.score_results(res, ev, "event_id").select("event_id", F.col("cp_loss").cast("bigint").alias("cp_loss"))


@query(
    "suite_pairs",
    "J07",
    """WITH a AS (SELECT user_id, max(CAST(floor(value) AS BIGINT)) AS v FROM events WHERE event_type = 'click' GROUP BY 1),
      b AS (SELECT user_id, max(CAST(floor(value) AS BIGINT)) AS v FROM events WHERE event_type = 'purchase' GROUP BY 1)
    SELECT user_id, a.v AS a, b.v AS b, a.v - b.v AS diff FROM a JOIN b USING (user_id)""",
)
def suite_pairs(t: Tables):
    arm = lambda k: t.events.where(F.col("event_type") == k).groupBy("user_id").agg(
        F.max(F.floor("value")).alias("cp_loss")
    )
    return su.pair_on(arm("click"), arm("purchase"), ["user_id"])


@query(
    "suite_comparison",
    "X07 A10",
    f"""WITH r AS (
      SELECT user_id || '/' || CAST(floor(event_id / 100) AS BIGINT) AS src, event_type, CAST(floor(value * 20) AS BIGINT) AS loss,
        row_number() OVER (PARTITION BY event_type, user_id, CAST(floor(event_id / 100) AS BIGINT) ORDER BY event_id) AS k
      FROM events WHERE event_type IN ('click', 'view')),
    both_arms AS (
      SELECT a.loss AS a, b.loss AS b, a.loss - b.loss AS d FROM r AS a JOIN r AS b USING (src)
      WHERE a.event_type = 'click' AND b.event_type = 'view' AND a.k = 1 AND b.k = 1), {flip_sql("both_arms")}
    SELECT n AS pairs, {py_round("total / n", 9)} AS mean_diff, {py_round("p", 8)} AS p,
      (SELECT {py_round("avg(a)", 6)} FROM both_arms) AS mean_a, (SELECT {py_round("avg(b)", 6)} FROM both_arms) AS mean_b FROM flip""",
)
def suite_comparison(t: Tables):
    """Click against view answers of the same user and hour, with an exact p."""
    key = F.concat_ws("/", "user_id", F.floor(F.col("event_id") / 100))
    arm = lambda k: (
        _results(t).join(t.events.select("event_id", key.alias("src")), "event_id")
        .where(F.col("event_type") == k).transform(lambda d: first(d, ["src"], ["event_id"]))
    )
    r = lambda c, d: half_even(F.col(c), d)
    return su.compare_suites(arm("click"), arm("view")).select(
        "pairs", r("mean_diff", 9).alias("mean_diff"), r("p", 8).alias("p"),
        r("a.mean_cp_loss", 6).alias("mean_a"), r("b.mean_cp_loss", 6).alias("mean_b"),
    )
