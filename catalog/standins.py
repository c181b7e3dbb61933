"""Driver tables in the roles of games, moves, decisions and evals, for Spark and for SQL.

games      <- orders     run = customer, white = buyer, black = clerk of the priority
moves      <- lineitem   game = order, mover by line number parity
runs       <- customer   valid = non-negative balance
decisions  <- events     one decision per event, nested fields built from value and props
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from catalog.base import Tables
from rookery.functions.scoring import band, is_aborted


def runs(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").cast("string").alias("run_id"),
        F.col("c_name").alias("label"),
        (F.col("c_acctbal") >= 0).alias("valid"),
        "c_nationkey",
        "c_mktsegment",
    )


def games(t: Tables) -> DataFrame:
    result = (
        F.when(F.col("o_orderstatus") == "F", F.lit("1-0"))
        .when(F.col("o_orderstatus") == "O", F.lit("0-1"))
        .otherwise(F.lit("1/2-1/2"))
    )
    termination = F.when(F.col("o_totalprice") < 20000, F.lit("aborted (outage)")).otherwise(
        F.lit("checkmate")
    )
    return t.orders.select(
        F.col("o_orderkey").alias("game_id"),
        F.col("o_custkey").cast("string").alias("run_id"),
        F.concat(F.lit("buyer-"), F.pmod("o_custkey", F.lit(97)).cast("string")).alias("white"),
        F.concat(F.lit("clerk-"), F.substring("o_orderpriority", 1, 1)).alias("black"),
        result.alias("result"),
        termination.alias("termination"),
        is_aborted(result, termination).alias("aborted"),
        (F.substring("o_orderpriority", 1, 1).cast("int") * 200 + 900).alias("level"),
        "o_totalprice",
        "o_orderdate",
        "o_custkey",
    )


GAMES = """
games AS (
  SELECT o_orderkey AS game_id, CAST(o_custkey AS VARCHAR) AS run_id,
         'buyer-' || CAST(o_custkey % 97 AS VARCHAR) AS white,
         'clerk-' || substr(o_orderpriority, 1, 1) AS black,
         CASE o_orderstatus WHEN 'F' THEN '1-0' WHEN 'O' THEN '0-1' ELSE '1/2-1/2' END AS result,
         CASE WHEN o_totalprice < 20000 THEN 'aborted (outage)' ELSE 'checkmate' END AS termination,
         o_totalprice < 20000 AS aborted,
         CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 200 + 900 AS level,
         o_totalprice, o_orderdate, o_custkey
  FROM orders),
runs AS (
  SELECT CAST(c_custkey AS VARCHAR) AS run_id, c_acctbal >= 0 AS valid, c_nationkey, c_mktsegment
  FROM customer)"""


def moves(t: Tables) -> DataFrame:
    """Moves without the mover; join games for the names."""
    loss = F.when(
        F.col("l_linestatus") == "F", F.pmod(F.floor("l_extendedprice"), F.lit(1001)).cast("int")
    )
    return t.lineitem.select(
        F.col("l_orderkey").alias("game_id"),
        F.col("l_linenumber").alias("ply"),
        F.concat(
            F.when(F.col("l_linenumber") % 2 == 1, F.lit("clerk-")).otherwise(F.lit("buyer-")),
            (F.pmod("l_suppkey", F.lit(5)) + 1).cast("string"),
        ).alias("player"),
        (F.col("l_linenumber") <= 2).alias("book"),
        loss.alias("cp_loss"),
        band(loss).alias("classification"),
        F.when(F.col("l_returnflag") == "R", F.array(F.lit("x"))).otherwise(
            F.array().cast("array<string>")
        ).alias("illegal_attempts"),
        (F.col("l_discount") >= 0.09).alias("forced_random"),
        F.col("l_quantity").cast("int").alias("llm_calls"),
        F.col("l_tax").alias("cost_usd"),
        F.col("l_discount").alias("seconds"),
    )


MOVES = """
moves AS (
  SELECT l_orderkey AS game_id, l_linenumber AS ply,
         CASE WHEN l_linenumber % 2 = 1 THEN 'clerk-' ELSE 'buyer-' END
           || CAST(l_suppkey % 5 + 1 AS VARCHAR) AS player,
         l_linenumber <= 2 AS book,
         CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice) AS BIGINT) % 1001 END AS cp_loss,
         l_returnflag = 'R' AS illegal,
         l_discount >= 0.09 AS forced_random,
         CAST(l_quantity AS BIGINT) AS llm_calls, l_tax AS cost_usd, l_discount AS seconds
  FROM lineitem)"""
