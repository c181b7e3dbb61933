"""Log and table files written from the driver tables and scanned back."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, query
from rookery.session import shared_dir
from rookery.sources import logs, sinks, tables


@query(
    "jsonl_round_trip",
    "K06 K07 S03",
    "SELECT conv_id, turn, role, md5(text) AS digest FROM conversations",
)
def jsonl_round_trip(t: Tables):
    path = shared_dir(t.spark, "jsonl")
    sinks.write_jsonl(t.conversations, path, compression="gzip")
    back = logs.read_log(
        t.spark, path, "conv_id bigint, turn bigint, role string, text string", mode="strict", with_run=False
    )
    return back.select("conv_id", "turn", "role", F.md5(F.col("text").cast("binary")).alias("digest"))


@query(
    "tolerant_log_scan",
    "S02 S13",
    """SELECT user_id AS game, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids FROM events WHERE event_type NOT IN ('error', 'signup') GROUP BY 1""",
)
def tolerant_log_scan(t: Tables):
    """Lines of which some are cut off and some are blank; the game key is text in the file."""
    line = F.concat(
        F.lit('{"game": "'), F.col("user_id").cast("string"), F.lit('", "id": '), F.col("event_id").cast("string"), F.lit("}")
    )
    damaged = (
        F.when(F.col("event_type") == "error", F.expr("substr(line, 1, length(line) - 3)"))
        .when(F.col("event_type") == "signup", F.lit(""))
        .otherwise(F.col("line"))
    )
    path = shared_dir(t.spark, "lines")
    sinks.write_text(t.events.withColumn("line", line).withColumn("value", damaged), path)
    back = logs.read_log(t.spark, path, "game string, id bigint", with_run=False)
    return back.groupBy(F.col("game").cast("bigint").alias("game")).agg(
        F.count(F.lit(1)).alias("n"), F.sum("id").alias("ids")
    )


@query(
    "games_csv_round_trip",
    "K08 S10",
    """SELECT o_orderkey AS game, 'said ''x'', y' AS termination, CASE WHEN o_orderkey % 3 <> 0 THEN o_totalprice END AS acpl,
      o_orderkey % 2 = 0 AS harness FROM orders""",
)
def games_csv_round_trip(t: Tables):
    g = t.orders.select(
        F.lit("r").alias("run"), F.col("o_orderkey").cast("int").alias("game"), F.lit("c").alias("config"), F.lit("m").alias("model"),
        (F.col("o_orderkey") % 2 == 0).alias("harness"), F.lit(1100).alias("level"), F.lit("white").alias("color"),
        F.lit("1-0").alias("result"), F.lit(1.0).alias("score"), F.lit('said "x", y').alias("termination"), F.lit(9).alias("plies"),
        F.when(F.col("o_orderkey") % 3 != 0, F.col("o_totalprice")).alias("acpl"), F.lit(0.1).alias("cost_usd"),
        F.lit(3).alias("claude_moves"), F.lit(1.5).alias("claude_seconds"),
    )
    path = shared_dir(t.spark, "csv")
    sinks.write_games_csv(g, path)
    return tables.read_games_csv(t.spark, path).select(
        F.col("game").cast("bigint").alias("game"), "termination", "acpl", "harness"
    )
