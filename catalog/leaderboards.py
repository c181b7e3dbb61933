"""Leaderboards, run summaries, both-sides unpivot, semi joins, totals."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, py_round, query
from catalog.standins import GAMES, MOVES, games, moves, runs
from rookery.functions.numeric import half_even
from rookery.operators import leaderboard as lb
from rookery.operators.store import ingest_totals

_STATS = f"""
WITH {GAMES}, {MOVES},
g AS (SELECT games.* FROM games JOIN runs USING (run_id) WHERE {{filter}}),
sides AS (
  SELECT white AS player, CASE result WHEN '1-0' THEN 1.0 WHEN '0-1' THEN 0.0 ELSE 0.5 END AS s FROM g
  UNION ALL
  SELECT black, CASE result WHEN '1-0' THEN 0.0 WHEN '0-1' THEN 1.0 ELSE 0.5 END FROM g),
a AS (SELECT player, count(*) AS games, count(*) FILTER (s = 1) AS w, count(*) FILTER (s = 0.5) AS d,
             count(*) FILTER (s = 0) AS l, CAST(sum(s) AS DOUBLE) AS score FROM sides GROUP BY 1),
m AS (SELECT player, count(*) AS moves, coalesce(sum(cp_loss), 0) AS loss,
             count(*) FILTER (cp_loss >= 300) AS blunders, count(*) FILTER (illegal) AS illegal_moves,
             count(*) FILTER (forced_random) AS forced_random, sum(llm_calls) AS llm_calls,
             sum(cost_usd) AS cost_usd, sum(seconds) AS seconds
      FROM moves JOIN g USING (game_id) WHERE NOT book GROUP BY 1)
SELECT coalesce(a.player, m.player) AS player, coalesce(games, 0) AS games, coalesce(w, 0) AS w,
       coalesce(d, 0) AS d, coalesce(l, 0) AS l, coalesce(score, 0.0) AS score,
       coalesce(moves, 0) AS moves, coalesce(blunders, 0) AS blunders,
       coalesce(illegal_moves, 0) AS illegal_moves, coalesce(forced_random, 0) AS forced_random,
       CAST(coalesce(llm_calls, 0) AS BIGINT) AS llm_calls,
       {py_round('coalesce(cost_usd, 0)', 4)} AS cost_usd,
       {py_round('coalesce(seconds, 0)', 4)} AS seconds,
       CASE WHEN moves > 0 THEN {py_round('CAST(loss AS DOUBLE) / moves', 1)} END AS acpl,
       CASE WHEN moves > 0 THEN {py_round('CAST(blunders AS DOUBLE) / moves', 3)} END AS blunder_rate,
       CASE WHEN moves > 0 THEN {py_round('CAST(illegal_moves AS DOUBLE) / moves', 3)} END AS illegal_rate
FROM a FULL JOIN m ON a.player = m.player
"""


def _stats(t: Tables, **kw):
    out = lb.player_stats(moves(t), games(t), runs(t), **kw)
    return out.withColumn("seconds", half_even(F.col("seconds"), 4))


@query("player_leaderboard", "A01 J04 J16 O01", _STATS.format(filter="valid AND NOT aborted"))
def player_leaderboard(t: Tables):
    return _stats(t)


@query("player_leaderboard_all", "A01", _STATS.format(filter="true"))
def player_leaderboard_all(t: Tables):
    return _stats(t, include_invalid=True, include_aborted=True)


@query(
    "side_scores",
    "J16 P09",
    f"""WITH {GAMES}
    SELECT player, side, count(*) AS games, CAST(sum(s) AS DOUBLE) AS score FROM (
      SELECT white AS player, 'white' AS side,
             CASE result WHEN '1-0' THEN 1.0 WHEN '0-1' THEN 0.0 ELSE 0.5 END AS s FROM games
      UNION ALL SELECT black, 'black',
             CASE result WHEN '0-1' THEN 1.0 WHEN '1-0' THEN 0.0 ELSE 0.5 END FROM games)
    GROUP BY 1, 2""",
)
def side_scores(t: Tables):
    return (
        lb.both_sides(games(t))
        .groupBy("player", "side")
        .agg(F.count(F.lit(1)).alias("games"), F.sum("score").alias("score"))
    )


@query(
    "research_moves_by_ply",
    "J04",
    f"""WITH {GAMES}, {MOVES}
    SELECT ply, count(*) AS moves, count(cp_loss) AS known, CAST(sum(cp_loss) AS BIGINT) AS loss
    FROM moves JOIN games USING (game_id) JOIN runs USING (run_id)
    WHERE valid AND NOT aborted AND NOT book GROUP BY 1""",
)
def research_moves_by_ply(t: Tables):
    return (
        lb.research_moves(moves(t), games(t), runs(t))
        .groupBy("ply")
        .agg(
            F.count(F.lit(1)).alias("moves"),
            F.count("cp_loss").alias("known"),
            F.sum("cp_loss").alias("loss"),
        )
    )


@query(
    "finished_decisions",
    "J05",
    """SELECT l_linenumber AS ply, count(*) AS decisions FROM lineitem
    WHERE EXISTS (SELECT 1 FROM orders WHERE o_orderkey = l_orderkey AND o_orderstatus <> 'P')
    GROUP BY 1""",
)
def finished_decisions(t: Tables):
    done = t.orders.where("o_orderstatus <> 'P'").select(F.col("o_orderkey").alias("game"))
    decisions = t.lineitem.select(F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("ply"))
    return (
        lb.finished_only(decisions, done, keys=["game"])
        .groupBy("ply")
        .agg(F.count(F.lit(1)).alias("decisions"))
    )


@query(
    "run_games_list",
    "A03",
    f"""WITH {GAMES} SELECT game_id AS round, white, black, result, termination,
        coalesce(CASE WHEN level > 1300 THEN 'line-' || CAST(level AS VARCHAR) END, '') AS opening
        FROM games""",
)
def run_games_list(t: Tables):
    opening = F.when(F.col("level") > 1300, F.concat(F.lit("line-"), F.col("level").cast("string")))
    return lb.run_games(
        games(t).withColumn("idx", F.col("game_id")).withColumn("opening_name", opening)
    )


@query(
    "run_summary",
    "A02 P13 P22",
    f"""WITH {GAMES},
    sides AS (
      SELECT white AS player, result, CASE result WHEN '1-0' THEN 1.0 WHEN '0-1' THEN 0.0 WHEN '1/2-1/2' THEN 0.5 END AS s
      FROM (SELECT white, CASE WHEN aborted THEN '*' ELSE result END AS result FROM games)
      UNION ALL
      SELECT black, result, CASE result WHEN '0-1' THEN 1.0 WHEN '1-0' THEN 0.0 WHEN '1/2-1/2' THEN 0.5 END
      FROM (SELECT black, CASE WHEN aborted THEN '*' ELSE result END AS result FROM games)),
    a AS (SELECT player, count(s) AS games, count(*) FILTER (s = 1) AS w, count(*) FILTER (s = 0.5) AS d,
             count(*) FILTER (s = 0) AS l, CAST(coalesce(sum(s), 0) AS DOUBLE) AS score,
             count(*) FILTER (s IS NULL) AS aborted FROM sides GROUP BY 1),
    e AS (SELECT 'clerk-' || CAST(l_suppkey % 5 + 1 AS VARCHAR) AS player, count(*) AS moves, sum(c) AS loss,
             count(*) FILTER (c >= 50 AND c < 100) AS inaccuracies,
             count(*) FILTER (c >= 100 AND c < 300) AS mistakes, count(*) FILTER (c >= 300) AS blunders
          FROM (SELECT *, CAST(floor(l_extendedprice) AS BIGINT) % 1001 AS c FROM lineitem) GROUP BY 1),
    d AS (SELECT 'buyer-' || CAST(user_id % 97 AS VARCHAR) AS player, count(*) AS decisions,
             sum(CASE WHEN event_type = 'error' THEN 2 ELSE 0 END) AS illegal_attempts,
             count(*) FILTER (event_type = 'error') AS moves_with_illegal,
             count(*) FILTER (event_type = 'signup') AS forfeits,
             sum(CAST(floor(value) AS BIGINT)) AS llm_calls, sum(value) AS cost, sum(value) * 2 AS seconds
          FROM events GROUP BY 1)
    SELECT coalesce(a.player, e.player, d.player) AS player, coalesce(games, 0) AS games,
      coalesce(w, 0) AS w, coalesce(d.d0, 0) AS d, coalesce(l, 0) AS l, coalesce(score, 0.0) AS score,
      coalesce(aborted, 0) AS aborted, coalesce(moves, 0) AS moves,
      coalesce(inaccuracies, 0) AS inaccuracies, coalesce(mistakes, 0) AS mistakes,
      coalesce(blunders, 0) AS blunders, coalesce(decisions, 0) AS decisions,
      CAST(coalesce(illegal_attempts, 0) AS BIGINT) AS illegal_attempts,
      coalesce(moves_with_illegal, 0) AS moves_with_illegal, coalesce(forfeits, 0) AS forfeits,
      CAST(coalesce(llm_calls, 0) AS BIGINT) AS llm_calls,
      CASE WHEN moves > 0 THEN {py_round('CAST(loss AS DOUBLE) / moves', 1)} END AS acpl,
      CASE WHEN moves > 0 THEN CAST(CAST(printf('%.0f', 3100 * exp(-0.01 * CAST(loss AS DOUBLE) / moves)) AS DOUBLE) AS INTEGER) END AS rough_elo,
      {py_round('coalesce(CAST(moves_with_illegal AS DOUBLE), 0) / greatest(coalesce(decisions, 0), 1)', 3)} AS illegal_rate,
      {py_round('coalesce(CAST(illegal_attempts AS DOUBLE), 0) / greatest(coalesce(decisions, 0), 1)', 3)} AS illegal_per_move,
      {py_round('coalesce(CAST(llm_calls AS DOUBLE), 0) / greatest(coalesce(decisions, 0), 1)', 2)} AS calls_per_move,
      {py_round('coalesce(cost, 0)', 4)} AS cost_usd
    FROM (SELECT player, games, w, d AS d1, l, score, aborted FROM a) a
    FULL JOIN e ON a.player = e.player
    FULL JOIN (SELECT *, NULL AS d0 FROM d) d ON coalesce(a.player, e.player) = d.player""".replace(
        "coalesce(d.d0, 0) AS d", "coalesce(d1, 0) AS d"
    ),
)
def run_summary(t: Tables):
    g = games(t).withColumn("result", F.when(F.col("aborted"), F.lit("*")).otherwise(F.col("result")))
    evals = t.lineitem.select(
        F.concat(F.lit("clerk-"), (F.pmod("l_suppkey", F.lit(5)) + 1).cast("string")).alias("player"),
        F.pmod(F.floor("l_extendedprice"), F.lit(1001)).alias("cpl"),
    )
    bad = F.when(F.col("event_type") == "error", F.array(F.lit("a"), F.lit("b"))).otherwise(
        F.array().cast("array<string>")
    )
    decisions = t.events.select(
        F.concat(F.lit("buyer-"), F.pmod("user_id", F.lit(97)).cast("string")).alias("player"),
        bad.alias("illegal_attempts"),
        F.when(F.col("event_type") != "signup", F.lit("e2e4")).alias("uci"),
        F.floor("value").alias("calls"),
        F.col("value").alias("cost"),
        (F.col("value") * 2).alias("seconds"),
    )
    out = lb.run_summary(g, evals, decisions)
    return out.drop("seconds", "avg_seconds")


@query(
    "ingest_totals",
    "K10",
    "SELECT (SELECT count(*) FROM customer) AS runs, (SELECT count(*) FROM orders) AS games, "
    "(SELECT count(*) FROM lineitem) AS moves",
)
def totals(t: Tables):
    return ingest_totals(t.customer, t.orders, t.lineitem)
