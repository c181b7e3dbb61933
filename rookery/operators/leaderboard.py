"""Leaderboards and run summaries."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.functions.numeric import half_even
from rookery.functions.scoring import rough_elo, side_score


def both_sides(games: DataFrame, white="white", black="black", result="result") -> DataFrame:
    """Each game yields one row per side: player, side, score (NULL when undecided)."""
    sides = F.array(
        F.struct(F.col(white).alias("player"), F.lit("white").alias("side")),
        F.struct(F.col(black).alias("player"), F.lit("black").alias("side")),
    )
    return games.withColumn("_s", F.explode(sides)).select(
        *games.columns,
        F.col("_s.player").alias("player"),
        F.col("_s.side").alias("side"),
        side_score(F.col(result), F.col("_s.side")).alias("score"),
    )


def research_games(
    games: DataFrame, runs: DataFrame, include_invalid=False, include_aborted=False
) -> DataFrame:
    """Games of valid runs that were not aborted (either filter can be lifted)."""
    keep = runs if include_invalid else runs.where(F.col("valid"))
    out = games if include_aborted else games.where(~F.col("aborted"))
    return out.join(keep.select("run_id"), "run_id", "left_semi")


def research_moves(
    moves: DataFrame, games: DataFrame, runs: DataFrame, include_invalid=False, include_aborted=False
) -> DataFrame:
    """Moves chosen by a player (not from the book) in the games of `research_games`."""
    keep = research_games(games, runs, include_invalid, include_aborted)
    chosen = moves.where(~F.col("book"))
    if not include_invalid and "run_id" in moves.columns:  # prunes the partitions of other runs
        chosen = chosen.join(runs.where(F.col("valid")).select("run_id"), "run_id", "left_semi")
    return chosen.join(keep.select("game_id"), "game_id", "left_semi")


def record(sides: DataFrame) -> DataFrame:
    """games, w, d, l, score per player."""
    return sides.groupBy("player").agg(
        F.count(F.lit(1)).alias("games"),
        F.count_if(F.col("score") == 1.0).alias("w"),
        F.count_if(F.col("score") == 0.5).alias("d"),
        F.count_if(F.col("score") == 0.0).alias("l"),
        F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"),
    )


def player_stats(
    moves: DataFrame, games: DataFrame, runs: DataFrame, include_invalid=False, include_aborted=False
) -> DataFrame:
    """Per player: record, accuracy, illegal moves, cost.

    Mean loss divides the known losses by all chosen moves. Both halves are reduced per player on
    the map side before they meet, so a player seen in every game is no hot key.
    """
    g = research_games(games, runs, include_invalid, include_aborted)
    left = record(both_sides(g).where(F.col("player").isNotNull() & (F.col("player") != "")))
    m = research_moves(moves, games, runs, include_invalid, include_aborted)
    right = (
        m.where(F.col("player").isNotNull() & (F.col("player") != ""))
        .groupBy("player")
        .agg(
            F.count(F.lit(1)).alias("moves"),
            F.coalesce(F.sum("cp_loss"), F.lit(0)).alias("_loss"),
            F.count_if(F.col("classification") == "blunder").alias("blunders"),
            F.count_if(F.size("illegal_attempts") > 0).alias("illegal_moves"),
            F.count_if(F.col("forced_random")).alias("forced_random"),
            F.coalesce(F.sum("llm_calls"), F.lit(0)).alias("llm_calls"),
            F.coalesce(F.sum("cost_usd"), F.lit(0.0)).alias("cost_usd"),
            F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
        )
    )
    zero = ["games", "w", "d", "l", "moves", "blunders", "illegal_moves", "forced_random", "llm_calls"]
    both = left.join(right, "player", "full").fillna(0, zero).fillna(0.0, ["score", "cost_usd", "seconds"])
    n = F.col("moves")
    share = lambda c, d: F.when(n > 0, half_even(F.col(c) / n, d))
    return leaderboard_order(
        both.select(
            "player", "games", "w", "d", "l", "score", "moves", "blunders", "illegal_moves",
            "forced_random", "llm_calls",
            half_even(F.col("cost_usd"), 4).alias("cost_usd"),
            "seconds",
            share("_loss", 1).alias("acpl"),
            share("blunders", 3).alias("blunder_rate"),
            share("illegal_moves", 3).alias("illegal_rate"),
        )
    )


def leaderboard_order(df: DataFrame, score: str = "score", name: str = "player") -> DataFrame:
    return df.orderBy(F.desc(score), F.asc(name))


def finished_only(decisions: DataFrame, games: DataFrame, keys=("run_id", "game")) -> DataFrame:
    """Decisions of games that have a result row."""
    return decisions.join(games.select(*keys).distinct(), list(keys), "left_semi")


def run_games(games: DataFrame) -> DataFrame:
    return games.select(
        F.col("idx").alias("round"), "white", "black", "result", "termination",
        F.coalesce("opening_name", F.lit("")).alias("opening"),
    )


def run_summary(games: DataFrame, evals: DataFrame, decisions: DataFrame, by=()) -> DataFrame:
    """Per player of a run: record, loss bands, illegal attempts, cost, rough strength.

    Aborted games count only in `aborted`. Mean loss divides by analysed moves. Columns of `by`
    (for example run_id) make it one summary per run.
    """
    keys = [*by, "player"]
    side = both_sides(games)
    decided = F.col("result").isin(*K.DECIDED)
    rec = side.groupBy(*keys).agg(
        F.count_if(decided).alias("games"),
        F.count_if(F.col("score") == 1.0).alias("w"),
        F.count_if(F.col("score") == 0.5).alias("d"),
        F.count_if(F.col("score") == 0.0).alias("l"),
        F.coalesce(F.sum("score"), F.lit(0.0)).alias("score"),
        F.count_if(~F.coalesce(decided, F.lit(False))).alias("aborted"),
    )
    loss = F.col("cpl")
    acc = evals.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("moves"),
        F.sum("cpl").alias("_loss"),
        F.count_if((loss >= 50) & (loss < 100)).alias("inaccuracies"),
        F.count_if((loss >= 100) & (loss < 300)).alias("mistakes"),
        F.count_if(loss >= 300).alias("blunders"),
    )
    bad = F.coalesce(F.size("illegal_attempts"), F.lit(0))
    dec = decisions.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("decisions"),
        F.sum(F.greatest(bad, F.lit(0))).alias("illegal_attempts"),
        F.count_if(bad > 0).alias("moves_with_illegal"),
        F.count_if(F.col("uci").isNull()).alias("forfeits"),
        F.coalesce(F.sum("calls"), F.lit(0)).alias("llm_calls"),
        F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost_usd"),
        F.coalesce(F.sum("seconds"), F.lit(0.0)).alias("seconds"),
    )
    joined = rec.join(acc, keys, "full").join(dec, keys, "full")
    counts = [
        "games", "w", "d", "l", "aborted", "moves", "inaccuracies", "mistakes", "blunders",
        "decisions", "illegal_attempts", "moves_with_illegal", "forfeits", "llm_calls",
    ]
    joined = joined.fillna(0, counts).fillna(0.0, ["score", "cost_usd", "seconds"])
    mean = F.when(F.col("moves") > 0, F.col("_loss") / F.col("moves"))
    nd = F.greatest(F.col("decisions"), F.lit(1))
    return joined.select(
        *keys, "games", "w", "d", "l", "score", "aborted", "moves", "inaccuracies", "mistakes",
        "blunders", "decisions", "illegal_attempts", "moves_with_illegal", "forfeits", "llm_calls",
        "seconds",
        half_even(mean, 1).alias("acpl"),
        rough_elo(mean).alias("rough_elo"),
        half_even(F.col("moves_with_illegal") / nd, 3).alias("illegal_rate"),
        half_even(F.col("illegal_attempts") / nd, 3).alias("illegal_per_move"),
        half_even(F.col("llm_calls") / nd, 2).alias("calls_per_move"),
        half_even(F.col("seconds") / nd, 2).alias("avg_seconds"),
        half_even(F.col("cost_usd"), 4).alias("cost_usd"),
    )
