"""Streaming queries: events are written as dated files, streamed, and compared with the batch answer."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, query
from catalog.ordered import _STREAK
from rookery.session import shared_dir
from rookery.streaming import live


def _feed(t: Tables, columns, parts: int = 3, files: int = 0) -> tuple[str, str]:
    """Write the events as `parts` successive file drops in time order; folder and schema.

    With `files`, each drop is dealt over so many files by a hash, so that none of them is in order.
    """
    folder = shared_dir(t.spark, "feed")
    e = t.events.select(*columns)
    bounds = e.select(F.min(F.to_date("ts")).alias("a"), F.datediff(F.max("ts"), F.min("ts")).alias("n"))
    part = F.least(
        F.floor(F.datediff(F.to_date("ts"), F.col("a")) * parts / F.greatest(F.col("n"), F.lit(1))), F.lit(parts - 1)
    )
    marked = e.withColumn("_k", F.lit(1)).join(bounds.withColumn("_k", F.lit(1)), "_k").withColumn("_part", part)
    if files:
        marked = marked.repartition(files, F.xxhash64(*columns))
    for i in range(parts):
        marked.where(F.col("_part") == i).drop("_k", "a", "n", "_part").write.mode("append").parquet(folder)
    return folder, e.schema


def _stream(t: Tables, folder: str, schema, files: int = 4):
    return t.spark.readStream.schema(schema).option("maxFilesPerTrigger", str(files)).parquet(folder)


def _games(df):
    return df.select(
        F.col("event_type").alias("config"), (F.pmod("user_id", F.lit(5)) * 200 + 1100).alias("level"),
        F.when(F.col("value") > 12, F.lit(1.0)).when(F.col("value") < 6, F.lit(0.0)).otherwise(F.lit(0.5)).alias("score"),
        F.lit(0.25).alias("cost_usd"),
    )


_BOARD = """SELECT config AS "row", level AS col, CAST(grouping(level) AS INTEGER) AS is_total, count(*) AS games, CAST(sum(score) AS DOUBLE) AS points,
      count(*) FILTER (score = 1) AS w, count(*) FILTER (score = 0.5) AS d, count(*) FILTER (score = 0) AS l, count(*) * 0.25::DOUBLE AS cost,
      printf('%.0f', sum(score) * 100 / count(*)) || '%' AS score_pct
    FROM (SELECT event_type AS config, user_id % 5 * 200 + 1100 AS level, CASE WHEN value > 12 THEN 1.0::DOUBLE WHEN value < 6 THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score FROM events)
    GROUP BY GROUPING SETS ((config, level), (config))"""


@query("board_batch", "R01 A07", _BOARD)
def board_batch(t: Tables):
    return live.board_from_cells(live.board_cells(_games(t.events))).drop("cell")


@query("board_stream", "R01 A07", _BOARD)
def board_stream(t: Tables):
    folder, schema = _feed(t, ["ts", "event_type", "user_id", "value"])
    out, check = shared_dir(t.spark, "board"), shared_dir(t.spark, "check")
    q = live.live_board(_games(_stream(t, folder, schema)), out, check, available_now=True)
    q.awaitTermination()
    return t.spark.read.parquet(out).drop("cell")


_FLAGS = ["top_played", "fail_low"]
# a game is an (event_type, user): events are its plies, those of little value its result
_LIVE = """SELECT event_type AS "row", user_id % 5 * 200 + 1100 AS col, event_type AS run, CAST(user_id AS VARCHAR) AS game, event_id AS ply,
      CASE WHEN value < 0.5 THEN user_id % 3 * 0.5 END AS score, event_id % 4 * 0.25 AS cost, value > 12 AS top_played, value > 40 AS fail_low FROM events"""


@query(
    "live_board_full",
    "R01 A07 A13 J14",
    f"""WITH rows AS ({_LIVE}),
    games AS (SELECT "row", col, run, game, max(ply) AS ply, CAST(max(score) AS DOUBLE) AS score FROM rows GROUP BY ALL),
    n AS (SELECT count(score) AS n FROM games),
    text AS (SELECT "row", col, grouping(col) AS t, count(*) AS games, sum(score) AS points, CAST(sum(cost) AS DOUBLE) AS cost,
        count(*) FILTER (score = 1) AS w, count(*) FILTER (score = 0.5) AS d, count(*) FILTER (score = 0) AS l
      FROM (SELECT g.*, c.cost FROM games g JOIN (SELECT run, game, sum(cost) AS cost FROM rows GROUP BY ALL) c USING (run, game) WHERE score IS NOT NULL)
      GROUP BY GROUPING SETS (("row", col), ("row"))),
    rest AS (SELECT "row", col, CAST(sum(cost) AS DOUBLE) AS cost FROM rows WHERE ("row", col) IN (SELECT "row", col FROM games WHERE score IS NOT NULL) GROUP BY GROUPING SETS (("row", col), ("row"))),
    share AS (SELECT "row", count(*) FILTER (score IS NULL) AS moves, count(*) FILTER (top_played) AS a, count(*) FILTER (fail_low) AS b FROM rows GROUP BY 1)
    SELECT 'total' AS section, NULL AS "row", NULL AS col, NULL AS is_total, NULL AS run, NULL AS game, NULL AS ply, n AS games, NULL::DOUBLE AS points,
      (SELECT CAST(sum(cost) AS DOUBLE) FROM rows) AS cost, NULL AS cell, n * 100.0::DOUBLE / 2000 AS pct,
      CASE WHEN n > 0 THEN 3600.0::DOUBLE / n * (2000 - n) END AS eta_seconds, NULL AS flag, NULL AS moves FROM n
    UNION ALL SELECT 'cell', "row", text.col, t, NULL, NULL, NULL, games, points, rest.cost,
      CASE WHEN t = 1 THEN replace(printf('%.1f', points), '.0', '') || '/' || games
        ELSE replace(printf('%.1f', points), '.0', '') || '/' || games || ' (' || w || '-' || d || '-' || l || ')' END, NULL, NULL, NULL, NULL
      FROM text JOIN rest USING ("row") WHERE text.col IS NOT DISTINCT FROM rest.col
    UNION ALL SELECT 'open', "row", col, NULL, run, game, ply, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM games WHERE score IS NULL
    UNION ALL SELECT 'reliance', "row", NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, a * 100.0::DOUBLE / moves, NULL, 'top_played', moves FROM share WHERE moves > 0
    UNION ALL SELECT 'reliance', "row", NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, NULL, b * 100.0::DOUBLE / moves, NULL, 'fail_low', moves FROM share WHERE moves > 0""",
)
def live_board_full(t: Tables):
    """Three drops in time order, each in eight unsorted files; three commits to each table of the board."""
    from rookery.streaming import board

    folder, schema = _feed(t, ["ts", "event_id", "event_type", "user_id", "value"], files=8)
    v, user = F.col("value"), F.col("user_id")
    rows = _stream(t, folder, schema, 8).select(
        F.col("event_type").alias("row"), (F.pmod(user, F.lit(5)) * 200 + 1100).alias("col"), F.col("event_type").alias("run"),
        user.cast("string").alias("game"), F.col("event_id").alias("ply"), F.col("ts").cast("timestamp").alias("at"),
        F.when(v < 0.5, F.pmod(user, F.lit(3)) * 0.5).alias("score"), (F.pmod("event_id", F.lit(4)) * 0.25).alias("cost"),
        (v > 12).alias("top_played"), (v > 40).alias("fail_low"),
    )
    out, check = shared_dir(t.spark, "live"), shared_dir(t.spark, "check")
    q = board.live_board_full(rows, out, check, _FLAGS, late="40 days", idle=10**9, compact_every=2, available_now=True)
    q.awaitTermination()
    return board.board(t.spark, out, _FLAGS, 2000, 3600.0)


@query(
    "ingest_stream",
    "R02 K04 K02",
    """SELECT CAST(user_id % 6 AS VARCHAR) AS run_id, count(*) AS moves, count(*) FILTER (event_type = 'error') AS known FROM events GROUP BY 1""",
)
def ingest_stream(t: Tables):
    """Moves streamed without analysis, then the analysis of some merged: sticky columns stay."""
    from rookery import schemas
    from rookery.operators.store import merge_into, read_table

    def moves(df, loss):
        have = {"game_id", "run_id", "ply", "cp_loss"}
        base = df.select(
            F.lit("g").alias("game_id"), F.pmod("user_id", F.lit(6)).cast("string").alias("run_id"),
            F.col("event_id").cast("int").alias("ply"), loss.cast("int").alias("cp_loss"),
        )
        from pyspark.sql.types import StructType

        return base.select(*[
            F.col(f.name) if f.name in have else F.lit(None).cast(f.dataType).alias(f.name)
            for f in StructType.fromDDL(schemas.STORE_MOVES).fields
        ])

    folder, schema = _feed(t, ["ts", "event_id", "event_type", "user_id", "value"], parts=2)
    root, check = shared_dir(t.spark, "store"), shared_dir(t.spark, "check")
    merge_into(t.spark, root, "moves", moves(t.events.where("event_type = 'error'"), F.lit(40)))
    q = live.live_ingest(
        moves(_stream(t, folder, schema), F.lit(None)), root, "moves", check, compact_every=2, available_now=True
    )
    q.awaitTermination()
    return read_table(t.spark, root, "moves").groupBy("run_id").agg(
        F.count(F.lit(1)).alias("moves"), F.count("cp_loss").alias("known")
    )


@query(
    "streak_stream",
    "R03 W02",
    f"""WITH {_STREAK} SELECT user_id, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS event_id,
      min(streak) FILTER (streak >= 3) AS streak FROM k WHERE streak >= 3 GROUP BY 1""",
)
def streak_stream(t: Tables):
    """Each drop holds a third of the time in 24 unsorted files; an empty game an age later ends the feed."""
    folder, schema = _feed(t, ["ts", "event_id", "user_id", "value"], files=24)
    # wall-clock times without a zone count as UTC
    at = F.concat(F.col("ts").cast("string"), F.lit("Z")).cast("timestamp")
    span = t.events.select(F.datediff(F.max("ts"), F.min("ts"))).first()[0] or 0
    end = t.events.agg(F.max("ts").alias("ts")).select(
        (F.col("ts") + F.expr(f"INTERVAL {4 * span + 8} DAYS")).alias("ts"), F.lit(None).cast("bigint").alias("event_id"),
        F.lit(None).cast("bigint").alias("user_id"), F.lit(None).cast("double").alias("value"),
    )
    end.write.mode("append").parquet(folder)
    s = _stream(t, folder, schema, 24).select(
        "user_id", at.alias("at"), "event_id", F.round((F.col("value") - 10) * 100).cast("bigint").alias("cp")
    )
    out, check = shared_dir(t.spark, "streaks"), shared_dir(t.spark, "check")
    hits = live.streak_stream(s, "user_id", "at", ["event_id"], "cp", 500, 3, late=f"{span + 1} days")
    with live.rocksdb_state(t.spark):
        q = (
            hits.writeStream.outputMode("append").format("parquet").option("checkpointLocation", check)
            .trigger(availableNow=True).start(out)
        )
    q.awaitTermination()
    return t.spark.read.schema("user_id bigint, at timestamp, event_id bigint, streak bigint, side int").parquet(
        out
    ).select("user_id", "event_id", "streak")
