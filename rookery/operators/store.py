"""The runs / players / games / moves store: upserts, row builders, export, views.

Tables are delta tables (`operators.deltas`): a merge writes only what it brings, re-ingest is idempotent,
and a write that broke off changes nothing. There is one writer per table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from rookery import schemas
from rookery.functions import names, scoring
from rookery.operators.deltas import DeltaTable
from rookery.operators.ordered import latest

TABLES = {
    "runs": (schemas.STORE_RUNS, ["run_id"], None),
    "players": (schemas.STORE_PLAYERS, ["name"], None),
    "games": (schemas.STORE_GAMES, ["run_id", "game_id"], "run_id"),
    "moves": (schemas.STORE_MOVES, ["run_id", "game_id", "ply"], "run_id"),
}


def _order(seq: str | None, columns: list[str]) -> list[Column]:
    """Newest update first by `seq`; updates that tie in it are told apart by a hash of their values."""
    by = F.col(seq).cast("bigint") if seq else F.lit(0).cast("bigint")
    return [by.alias("_s"), F.xxhash64(F.to_json(F.struct(*columns))).alias("_h")]


# --- pure merges --------------------------------------------------------------------------------
def upsert(target: DataFrame, updates: DataFrame, keys: list[str], seq: str | None = None) -> DataFrame:
    """Last write wins on the natural key; among updates the highest `seq` wins.

    One shuffle on the keys: both sides are stacked and the newest row of a key is kept with
    max_by, which combines before the shuffle.
    """
    cols = target.columns
    old = target.select(*cols, F.lit(0).alias("_gen"), F.lit(0).cast("bigint").alias("_s"), F.lit(0).cast("bigint").alias("_h"))
    new = updates.select(*cols, F.lit(1).alias("_gen"), *_order(seq, cols))
    return latest(old.unionByName(new), keys, ["_gen", "_s", "_h"]).select(*cols)


def upsert_sticky(
    target: DataFrame,
    updates: DataFrame,
    keys: list[str],
    sticky: list[str],
    seq: str | None = None,
) -> DataFrame:
    """As `upsert`, but a sticky column keeps its last non-NULL value.

    Every other column is overwritten, also with NULL. Still one shuffle: the newest row and the
    newest non-NULL sticky values come out of the same aggregation.
    """
    cols = target.columns
    plain = [c for c in cols if c not in keys and c not in sticky]
    old = target.select(*cols, F.lit(0).alias("_gen"), F.lit(0).cast("bigint").alias("_s"), F.lit(0).cast("bigint").alias("_h"))
    new = updates.select(*cols, F.lit(1).alias("_gen"), *_order(seq, cols))
    rank = F.struct("_gen", "_s", "_h")
    aggs = [F.max_by(F.struct(*plain), rank).alias("_row")] if plain else []
    aggs += [F.max_by(c, F.when(F.col(c).isNotNull(), rank)).alias(c) for c in sticky]
    merged = old.unionByName(new).groupBy(*keys).agg(*aggs)
    return merged.select(
        *[F.col(f"_row.{c}").alias(c) if c in plain else F.col(c) for c in cols]
    )


# --- stored tables ------------------------------------------------------------------------------
def delta_table(spark: SparkSession, root: str, table: str) -> DeltaTable:
    schema, keys, partition = TABLES[table]
    sticky = schemas.STICKY_MOVE_COLUMNS if table == "moves" else ()
    return DeltaTable(spark, f"{root}/{table}", schema, tuple(keys), partition, tuple(sticky))


def read_table(spark: SparkSession, root: str, table: str) -> DataFrame:
    """The stored table, empty where nothing was merged yet."""
    return delta_table(spark, root, table).read()


def merge_into(spark: SparkSession, root: str, table: str, updates: DataFrame, seq: str | None = None) -> None:
    """Last write wins on the table's key; analysis columns of moves keep their last known value."""
    stored = delta_table(spark, root, table)
    stored.append(updates, seq)
    stored.compact()


def register_views(spark: SparkSession, root: str) -> None:
    """Temp views runs, players, games, moves for ad-hoc spark.sql."""
    for table in TABLES:
        read_table(spark, root, table).createOrReplaceTempView(table)


# --- row builders -------------------------------------------------------------------------------
def game_rows(pgn: DataFrame) -> DataFrame:
    """`games` rows out of header maps (columns run_id, idx, headers, pgn)."""
    def header(name: str):
        return F.try_element_at("headers", F.lit(name))

    result = F.coalesce(header("Result"), F.lit("*"))
    termination = F.coalesce(header("Termination"), F.lit(""))
    return pgn.select(
        F.concat_ws(":", "run_id", "idx").alias("game_id"),
        "run_id",
        "idx",
        header("White").alias("white"),
        header("Black").alias("black"),
        result.alias("result"),
        termination.alias("termination"),
        scoring.is_aborted(result, termination).alias("aborted"),
        header("Opening").alias("opening_name"),
        F.lit(None).cast("string").alias("opening_eco"),
        F.coalesce(header("BookPlies").try_cast("int"), F.lit(0)).alias("book_plies"),
        F.coalesce(header("PlyCount").try_cast("int"), F.lit(0)).alias("plies"),
        scoring.adjudication_cp(termination).alias("adjudication_cp"),
        "pgn",
    )


def player_dim(games: DataFrame, white: str = "white", black: str = "black") -> DataFrame:
    """One row per distinct player name on either side, parsed."""
    both = games.select(F.explode(F.array(F.col(white), F.col(black))).alias("name"))
    known = both.where(F.col("name").isNotNull() & (F.col("name") != "")).distinct()
    return known.withColumn("_p", names.parse_player(F.col("name"))).select("name", "_p.*")


def plies_of(pgn: DataFrame) -> DataFrame:
    """Every ply of every game: run_id, game, ply, side, san."""
    ply = F.col("_pos") + 1
    return pgn.select(
        "run_id", F.col("idx").alias("game"), F.posexplode("sans").alias("_pos", "san")
    ).select(
        "run_id",
        "game",
        ply.alias("ply"),
        F.when(ply % 2 == 1, F.lit("white")).otherwise(F.lit("black")).alias("side"),
        "san",
    )


def move_rows(
    plies: DataFrame, decisions: DataFrame, evals: DataFrame, games: DataFrame
) -> DataFrame:
    """`moves` rows: all plies ⟕ last decision ⟕ last eval of (run, game, ply), with defaults."""
    keys = ["run_id", "game", "ply"]
    d = latest(decisions, keys, ["_seq"]).select(
        *keys,
        F.lit(True).alias("_d"),
        F.col("player").alias("d_player"),
        F.col("fen").alias("fen_before"),
        "uci",
        F.col("calls").alias("llm_calls"),
        F.col("cost").alias("cost_usd"),
        "seconds",
        F.coalesce("illegal_attempts", F.array().cast("array<string>")).alias("illegal_attempts"),
        F.coalesce("forced_random", F.lit(False)).alias("forced_random"),
        "candidates",
        "note",
        "own_eval",
    )
    e = latest(evals, keys, ["_seq"]).select(
        *keys,
        F.col("eval_before").alias("sf_eval_before"),
        F.col("eval_after").alias("sf_eval_after"),
        F.col("cpl").alias("cp_loss"),
        scoring.band(F.col("cpl")).alias("classification"),
        F.col("best_move").alias("sf_best_move"),
    )
    g = games.select("run_id", F.col("idx").alias("game"), "game_id", "white", "black", "book_plies")
    has = F.coalesce("_d", F.lit(False))
    none = F.array().cast(dict(decisions.dtypes)["candidates"])
    return (
        plies.join(d, keys, "left")
        .join(e, keys, "left")
        .join(g, ["run_id", "game"], "left")
        .select(
            "game_id",
            "run_id",
            "ply",
            "fen_before",
            "san",
            "uci",
            F.when(has, F.col("d_player"))
            .otherwise(F.when(F.col("side") == "white", F.col("white")).otherwise(F.col("black")))
            .alias("player"),
            "side",
            (F.col("ply") <= F.coalesce("book_plies", F.lit(0))).alias("book"),
            F.lit(None).cast("string").alias("phase"),
            F.lit(None).cast("string").alias("opening"),
            F.when(has, F.col("llm_calls")).otherwise(F.lit(0)).alias("llm_calls"),
            F.when(has, F.col("cost_usd")).otherwise(F.lit(0.0)).alias("cost_usd"),
            F.when(has, F.col("seconds")).otherwise(F.lit(0.0)).alias("seconds"),
            F.coalesce("illegal_attempts", F.array().cast("array<string>")).alias("illegal_attempts"),
            F.coalesce("forced_random", F.lit(False)).alias("forced_random"),
            F.coalesce("candidates", none).alias("candidates"),
            "note",
            "own_eval",
            "sf_eval_before",
            "sf_eval_after",
            "cp_loss",
            "classification",
            "sf_best_move",
        )
    )


def export_rows(
    games: DataFrame, runs: DataFrame, player: str | None = None, include_invalid: bool = False
) -> DataFrame:
    """Games to export, in (run_id, idx) order."""
    keep = runs if include_invalid else runs.where(F.col("valid"))
    out = games.join(keep.select("run_id"), "run_id", "left_semi")
    if player:
        out = out.where((F.col("white") == player) | (F.col("black") == player))
    return out.orderBy("run_id", "idx")


def export_pgn(games, runs, path, player=None, include_invalid=False) -> int:
    """Write the notation of the chosen games and return how many were written."""
    rows = export_rows(games, runs, player, include_invalid)
    seen = Observation()
    text = rows.select(F.concat("pgn", F.lit("\n")).alias("value")).observe(seen, F.count(F.lit(1)).alias("n"))
    text.write.mode("overwrite").text(path)
    return seen.get["n"]


def ingest_totals(runs: DataFrame, games: DataFrame, moves: DataFrame) -> DataFrame:
    """One row: runs, games, moves."""
    counts = [
        df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table"), "n")
        for name, df in (("runs", runs), ("games", games), ("moves", moves))
    ]
    stacked = counts[0].unionByName(counts[1]).unionByName(counts[2])
    return stacked.groupBy().pivot("table", ["runs", "games", "moves"]).agg(F.first("n"))
