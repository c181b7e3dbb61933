"""Store merges, row builders and exports."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, query
from catalog.standins import GAMES, games, runs
from rookery.functions import names
from rookery.operators import store as st
from rookery.session import shared_dir


def _batches(t: Tables):
    """Orders as a target, and a later batch that changes some rows and brings new keys."""
    target = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    changed = target.where(F.col("o_totalprice") > 200000).select(
        (F.col("o_orderkey") + F.when(F.col("o_orderstatus") == "P", 1000000).otherwise(0)).alias("o_orderkey"),
        F.when(F.col("o_custkey") % 3 != 0, F.col("o_custkey")).alias("o_custkey"),
        F.lit("U").alias("o_orderstatus"),
        F.when(F.col("o_custkey") % 2 == 0, F.col("o_totalprice") + 1).alias("o_totalprice"),
    )
    return target, changed


_CHANGED = """
ch AS (SELECT o_orderkey + CASE WHEN o_orderstatus = 'P' THEN 1000000 ELSE 0 END AS o_orderkey,
  CASE WHEN o_custkey % 3 <> 0 THEN o_custkey END AS o_custkey, 'U' AS o_orderstatus,
  CASE WHEN o_custkey % 2 = 0 THEN o_totalprice + 1 END AS o_totalprice
  FROM orders WHERE o_totalprice > 200000)"""


@query(
    "upsert",
    "K01",
    f"""WITH {_CHANGED} SELECT * FROM ch UNION ALL
    SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders
    WHERE o_orderkey NOT IN (SELECT o_orderkey FROM ch)""",
)
def upsert(t: Tables):
    return st.upsert(*_batches(t), ["o_orderkey"])


@query(
    "upsert_in_batch_order",
    "K01",
    """SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS r
      FROM events) WHERE r = 1""",
)
def upsert_in_batch_order(t: Tables):
    """Many updates of one key in a batch: the last in sequence wins."""
    target = t.events.where("event_type = 'signup'").select("user_id", "event_id", "event_type")
    up = t.events.select("user_id", "event_id", "event_type")
    return st.upsert(target, up, ["user_id"], seq="event_id")


_STICKY = f"""WITH {_CHANGED}
    SELECT coalesce(c.o_orderkey, o.o_orderkey) AS o_orderkey,
      CASE WHEN c.o_orderkey IS NOT NULL THEN c.o_custkey ELSE o.o_custkey END AS o_custkey,
      CASE WHEN c.o_orderkey IS NOT NULL THEN c.o_orderstatus ELSE o.o_orderstatus END AS o_orderstatus,
      coalesce(c.o_totalprice, o.o_totalprice) AS o_totalprice
    FROM orders o FULL JOIN ch c ON c.o_orderkey = o.o_orderkey"""


@query("upsert_sticky", "K02", _STICKY)
def upsert_sticky(t: Tables):
    return st.upsert_sticky(*_batches(t), ["o_orderkey"], ["o_totalprice"])


@query("upsert_twice", "K03", _STICKY)
def upsert_twice(t: Tables):
    """Applying the same batch again changes nothing."""
    target, changed = _batches(t)
    once = st.upsert_sticky(target, changed, ["o_orderkey"], ["o_totalprice"])
    return st.upsert_sticky(once, changed, ["o_orderkey"], ["o_totalprice"])


@query(
    "stored_merge",
    "K01 K03",
    f"WITH {GAMES} SELECT run_id, count(*) AS games, CAST(max(level) AS INTEGER) AS plies FROM games GROUP BY 1",
)
def stored_merge(t: Tables):
    """Games written to the store twice (the second time only half of the runs) and read back."""
    g = games(t)
    rows = g.select(
        F.concat_ws(":", "run_id", F.col("game_id").cast("string")).alias("game_id"), "run_id",
        F.col("game_id").cast("int").alias("idx"), "white", "black", "result", "termination", "aborted",
        F.lit(None).cast("string").alias("opening_name"), F.lit(None).cast("string").alias("opening_eco"),
        F.lit(0).alias("book_plies"), F.col("level").alias("plies"),
        F.lit(None).cast("int").alias("adjudication_cp"), F.lit("").alias("pgn"), "o_custkey",
    )
    # few large partitions: the run is the customer group here
    root = shared_dir(t.spark, "store")
    grouped = rows.withColumn("run_id", F.pmod("o_custkey", F.lit(8)).cast("string")).drop("o_custkey")
    st.merge_into(t.spark, root, "games", grouped.withColumn("plies", F.lit(0)))
    st.merge_into(t.spark, root, "games", grouped)
    st.merge_into(t.spark, root, "games", grouped.where("run_id < '4'"))
    back = st.read_table(t.spark, root, "games")
    return (
        back.select(F.split_part("game_id", F.lit(":"), F.lit(1)).alias("run_id"), "plies")
        .groupBy("run_id")
        .agg(F.count(F.lit(1)).alias("games"), F.max("plies").alias("plies"))
    )


@query(
    "export_rows",
    "K05 O02",
    f"""WITH {GAMES} SELECT game_id, games.run_id, white, black FROM games JOIN runs ON runs.run_id = games.run_id
    WHERE valid AND (white = 'clerk-2' OR black = 'clerk-2')""",
)
def export_rows(t: Tables):
    g = games(t).withColumn("idx", F.col("game_id"))
    return st.export_rows(g, runs(t), player="clerk-2").select("game_id", "run_id", "white", "black")


@query(
    "export_pgn",
    "K05 S05",
    f"""WITH {GAMES} SELECT CAST(game_id AS INTEGER) AS round, white, CAST(3 AS INTEGER) AS plies
    FROM games JOIN runs ON runs.run_id = games.run_id WHERE valid""",
)
def export_pgn(t: Tables):
    """Games written as text and read back with the game scan; one row per exported game."""
    from rookery.sources.logs import read_pgn

    g = games(t).withColumn("idx", F.col("game_id")).withColumn(
        "pgn",
        F.format_string('[Event "x"]\n[Round "%d"]\n[White "%s"]\n\n1. e4 e5 2. Nf3 %s\n',
                        F.col("game_id"), F.col("white"), F.col("result")),
    )
    path = shared_dir(t.spark, "export")
    st.export_pgn(g, runs(t), path)
    back = read_pgn(t.spark, path)
    return back.select("round", F.col("headers")["White"].alias("white"), F.size("sans").alias("plies"))


@query(
    "player_dim",
    "P03 P02",
    f"""WITH {GAMES}, n AS (SELECT DISTINCT unnest([white || '(d' || level || ',mod)', black || '(elo' || level || ')']) AS name FROM games)
    SELECT name, split_part(name, '(', 1) AS kind, CASE WHEN name LIKE '%,mod)' THEN 'mod' END AS model,
      CAST(CASE WHEN name LIKE 'buyer%' THEN regexp_extract(name, '\\(d(\\d+)', 1) END AS INTEGER) AS depth,
      CAST(CASE WHEN name LIKE 'clerk%' THEN regexp_extract(name, '\\(elo(\\d+)', 1) END AS INTEGER) AS elo FROM n""",
)
def player_dim(t: Tables):
    lv = F.col("level").cast("string")
    g = games(t).select(
        F.concat("white", F.lit("(d"), lv, F.lit(",mod)")).alias("white"),
        F.concat("black", F.lit("(elo"), lv, F.lit(")")).alias("black"),
    )
    return st.player_dim(g).select("name", "kind", "model", "depth", "elo")


@query(
    "game_rows",
    "P04 P05",
    """SELECT o_custkey || ':' || o_orderkey AS game_id, CASE WHEN o_totalprice < 20000 THEN '*' WHEN o_orderstatus = 'F' THEN '1-0'
      WHEN o_orderstatus = 'O' THEN '0-1' ELSE '1/2-1/2' END AS result,
      o_totalprice < 20000 OR o_totalprice > 480000 AS aborted,
      CAST(CASE WHEN o_totalprice < 20000 OR o_totalprice > 480000 THEN NULL WHEN o_orderstatus = 'P' THEN -(o_orderkey % 900)
           WHEN o_orderstatus = 'F' THEN o_orderkey % 900 END AS INTEGER) AS adjudication_cp,
      CAST(o_custkey % 9 AS INTEGER) AS book_plies FROM orders""",
)
def game_rows(t: Tables):
    o = t.orders
    cp = F.pmod("o_orderkey", F.lit(900)).cast("string")
    result = (
        F.when(F.col("o_totalprice") < 20000, F.lit("*"))
        .when(F.col("o_orderstatus") == "F", F.lit("1-0"))
        .when(F.col("o_orderstatus") == "O", F.lit("0-1"))
        .otherwise(F.lit("1/2-1/2"))
    )
    term = (
        F.when((F.col("o_totalprice") < 20000) | (F.col("o_totalprice") > 480000), F.lit("aborted (outage)"))
        .when(F.col("o_orderstatus") == "P", F.concat(F.lit("adjudication (ply cap 9, SF eval -"), cp, F.lit("cp)")))
        .when(F.col("o_orderstatus") == "F", F.concat(F.lit("adjudication (ply cap 9, SF eval +"), cp, F.lit("cp)")))
        .otherwise(F.lit("checkmate"))
    )
    pgn = o.select(
        F.col("o_custkey").cast("string").alias("run_id"), F.col("o_orderkey").alias("idx"), F.lit("").alias("pgn"),
        F.create_map(F.lit("Result"), result, F.lit("Termination"), term, F.lit("BookPlies"),
                     F.pmod("o_custkey", F.lit(9)).cast("string")).alias("headers"),
    )
    return st.game_rows(pgn).select("game_id", "result", "aborted", "adjudication_cp", "book_plies")


@query(
    "move_rows",
    "P07 J01 J02",
    """WITH d AS (SELECT l_orderkey, l_linenumber, arg_max(struct_pack(c := CAST(l_quantity AS INTEGER), t := l_tax),
           struct_pack(a := l_partkey, b := l_suppkey, c := l_extendedprice)) AS v FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2),
      e AS (SELECT l_orderkey, l_linenumber, max(CAST(floor(l_extendedprice) AS BIGINT)) % 1001 AS cpl FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2)
    SELECT o_custkey || ':' || o_orderkey AS game_id, ply,
      CASE WHEN v IS NOT NULL THEN 'agent' WHEN ply % 2 = 1 THEN 'W' || o_custkey ELSE 'B' END AS player,
      ply <= 2 AS book, coalesce(v.c, 0) AS llm_calls, coalesce(v.t, 0.0) AS cost_usd, CAST(cpl AS INTEGER) AS cp_loss,
      CASE WHEN cpl >= 300 THEN 'blunder' WHEN cpl >= 100 THEN 'mistake' WHEN cpl >= 50 THEN 'inaccuracy' WHEN cpl >= 0 THEN 'ok' END AS classification
    FROM orders CROSS JOIN (SELECT CAST(range AS INTEGER) AS ply FROM range(1, 8)) p
    LEFT JOIN d ON d.l_orderkey = o_orderkey AND d.l_linenumber = ply
    LEFT JOIN e ON e.l_orderkey = o_orderkey AND e.l_linenumber = ply""",
)
def move_rows(t: Tables):
    run = F.col("o_custkey").cast("string").alias("run_id")
    owner = t.orders.select(F.col("o_orderkey").alias("game"), run)
    plies = t.orders.select(
        run, F.col("o_orderkey").alias("game"), F.explode(F.sequence(F.lit(1), F.lit(7))).alias("ply")
    ).select("run_id", "game", "ply", F.lit("e4").alias("san"),
             F.when(F.col("ply") % 2 == 1, F.lit("white")).otherwise(F.lit("black")).alias("side"))
    games_ = t.orders.select(
        run, F.col("o_orderkey").alias("idx"), F.concat_ws(":", "o_custkey", "o_orderkey").alias("game_id"),
        F.concat(F.lit("W"), F.col("o_custkey").cast("string")).alias("white"), F.lit("B").alias("black"),
        F.lit(2).alias("book_plies"),
    )
    cand = "array<struct<san:string,reason:string,prior:double,score_cp:double,line:array<string>>>"
    li = t.lineitem.join(owner.withColumnRenamed("game", "l_orderkey"), "l_orderkey")
    decisions = li.where("l_returnflag <> 'N'").select(
        "run_id", F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("ply"),
        F.lit("agent").alias("player"), F.lit("fen").alias("fen"), F.lit("e2e4").alias("uci"),
        F.col("l_quantity").cast("int").alias("calls"), F.col("l_tax").alias("cost"),
        F.col("l_discount").alias("seconds"), F.lit(None).cast("array<string>").alias("illegal_attempts"),
        F.lit(False).alias("forced_random"), F.lit(None).cast(cand).alias("candidates"),
        F.lit("").alias("note"), F.lit(None).cast("double").alias("own_eval"),
        F.struct("l_partkey", "l_suppkey", "l_extendedprice").alias("_seq"),
    )
    evals = li.where("l_linestatus = 'F'").select(
        "run_id", F.col("l_orderkey").alias("game"), F.col("l_linenumber").alias("ply"),
        F.lit(0).alias("eval_before"), F.lit(0).alias("eval_after"), F.lit("e4").alias("best_move"),
        F.pmod(F.floor("l_extendedprice"), F.lit(1001)).cast("int").alias("cpl"),
        F.floor("l_extendedprice").alias("_seq"),
    )
    return st.move_rows(plies, decisions, evals, games_).select(
        "game_id", "ply", "player", "book", "llm_calls", "cost_usd", "cp_loss", "classification"
    )


@query(
    "run_rows",
    "P01",
    """SELECT event_id, CASE WHEN event_type = 'error' THEN '_invalid/' || f ELSE f END AS run_id,
      CASE WHEN user_id % 5 = 0 THEN NULL ELSE strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS started
    FROM (SELECT *, CASE WHEN user_id % 5 = 0 THEN 'x' ELSE '' END || strftime(ts, '%Y%m%d_%H%M%S') || '_' || event_type AS f FROM events)""",
)
def run_rows(t: Tables):
    folder = F.concat(
        F.when(F.col("user_id") % 5 == 0, F.lit("x")).otherwise(F.lit("")),
        F.date_format("ts", "yyyyMMdd_HHmmss"), F.lit("_"), F.col("event_type"),
    )
    return t.events.select(
        "event_id",
        names.run_id(folder, F.col("event_type") == "error").alias("run_id"),
        F.date_format(names.started_at(folder), "yyyy-MM-dd HH:mm:ss").alias("started"),
    )


@query(
    "adhoc_sql",
    "Q01",
    f"""WITH {GAMES} SELECT white, count(*) AS n FROM games JOIN runs USING (run_id) WHERE valid GROUP BY 1""",
)
def adhoc_sql(t: Tables):
    runs(t).createOrReplaceTempView("runs")
    games(t).createOrReplaceTempView("games")
    return t.spark.sql(
        "SELECT white, count(*) AS n FROM games JOIN runs USING (run_id) WHERE valid GROUP BY white"
    )


