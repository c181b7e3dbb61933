"""Run folders to store tables, for a whole root at once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery import schemas
from rookery.operators import store as st
from rookery.session import shared_dir
from rookery.sources import logs


def read_runs(spark: SparkSession, root: str, include_invalid: bool = True) -> dict[str, DataFrame]:
    """All logs below a root: meta, pgn, games, decisions, traces, evals."""
    path = lambda file: logs.run_globs(root, file, include_invalid)
    return {
        "meta": logs.read_meta(spark, root, include_invalid),
        "pgn": logs.read_pgn(spark, path("games.pgn")),
        "games": logs.read_log(spark, path("games.jsonl"), schemas.GAMES_LOG),
        "decisions": logs.read_log(spark, path("decisions.jsonl"), schemas.DECISIONS_LOG),
        "traces": logs.read_log(spark, path("traces.jsonl"), schemas.TRACES_LOG),
        "evals": logs.read_log(spark, path("move_analysis.jsonl"), schemas.EVALS_LOG),
    }


def ingest_all(spark: SparkSession, root: str, store: str, include_invalid: bool = True,
               commit: str | None = None) -> DataFrame:
    """(Re)ingest every run with a meta.json; returns one row of totals.

    Running it again, or after analysis files were added, changes no row counts.
    """
    src = read_runs(spark, root, include_invalid)
    known = src["meta"].select("run_id")
    # parsed once: games and moves are both made of the staged rows
    parsed = shared_dir(spark, "parsed-games")
    src["pgn"].join(known, "run_id", "left_semi").write.parquet(parsed)
    pgn = spark.read.schema(src["pgn"].schema).parquet(parsed)
    games = st.game_rows(pgn)
    moves = st.move_rows(st.plies_of(pgn), src["decisions"], src["evals"], games)
    runs = logs.run_rows(src["meta"], commit)
    st.merge_into(spark, store, "runs", runs)
    st.merge_into(spark, store, "players", st.player_dim(games))
    st.merge_into(spark, store, "games", games)
    st.merge_into(spark, store, "moves", moves)
    stored = lambda table: st.read_table(spark, store, table).join(known, "run_id", "left_semi")
    return st.ingest_totals(src["meta"], stored("games"), stored("moves"))


def player_stats(spark: SparkSession, store: str, **kw) -> DataFrame:
    from rookery.operators.leaderboard import player_stats as stats

    read = lambda name: st.read_table(spark, store, name)
    return stats(read("moves"), read("games"), read("runs"), **kw)


def run_summary(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame]:
    """(players per run, games per run) of all runs, from logs and given evaluations."""
    from rookery.operators import leaderboard as lb

    src = read_runs(spark, root)
    games = st.game_rows(src["pgn"])
    keys = games.select("run_id", F.col("idx").alias("game"))
    done = lambda df: lb.finished_only(df, keys)
    players = lb.run_summary(games, done(src["evals"]), done(src["decisions"]), by=("run_id",))
    return players, games.select("run_id", *[c for c in games.columns if c != "run_id"])
