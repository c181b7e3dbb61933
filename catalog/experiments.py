"""Experiment frames: per-game roll-up, reliance, cross tables, ratios, arm comparison."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, py_round, query
from rookery.functions.numeric import half_even
from rookery.operators import experiments as ex


def exp_games(t: Tables):
    """Orders as scored games of five configurations (customer segments)."""
    c = t.customer.select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("config"))
    return t.orders.join(c, "o_custkey").select(
        "o_orderkey",
        "config",
        (F.substring("o_orderpriority", 1, 1).cast("int") * 200 + 900).alias("level"),
        F.when(F.col("o_orderkey") % 2 == 0, F.lit("white")).otherwise(F.lit("black")).alias("color"),
        F.when(F.col("o_orderstatus") == "F", F.lit(1.0))
        .when(F.col("o_orderstatus") == "O", F.lit(0.0))
        .otherwise(F.lit(0.5))
        .alias("score"),
        (F.col("o_totalprice") / 100000).alias("cost_usd"),
        F.pmod("o_custkey", F.lit(40)).alias("claude_moves"),
        F.pmod("o_custkey", F.lit(7)).cast("double").alias("claude_seconds"),
        F.when(F.col("o_orderkey") % 10 != 0, F.pmod(F.floor("o_totalprice"), F.lit(1001)).cast("double"))
        .alias("acpl"),
    )


EXP = """
eg AS (
  SELECT o_orderkey, c_mktsegment AS config, CAST(substr(o_orderpriority, 1, 1) AS INTEGER) * 200 + 900 AS level,
         CASE WHEN o_orderkey % 2 = 0 THEN 'white' ELSE 'black' END AS color,
         CASE o_orderstatus WHEN 'F' THEN 1.0::DOUBLE WHEN 'O' THEN 0.0::DOUBLE ELSE 0.5::DOUBLE END AS score,
         o_totalprice / 100000 AS cost_usd, o_custkey % 40 AS claude_moves,
         CAST(o_custkey % 7 AS DOUBLE) AS claude_seconds,
         CASE WHEN o_orderkey % 10 <> 0 THEN CAST(CAST(floor(o_totalprice) AS BIGINT) % 1001 AS DOUBLE) END AS acpl
  FROM orders JOIN customer ON o_custkey = c_custkey)"""

PAIRS = (
    ("auto-build", "AUTOMOBILE", "BUILDING"),
    ("auto-house", "AUTOMOBILE", "HOUSEHOLD"),
    ("furn-mach", "FURNITURE", "MACHINERY"),
)


def pairs(t: Tables):
    return t.spark.createDataFrame(list(PAIRS), "pair string, a string, b string")


PAIRS_SQL = "pairs AS (SELECT * FROM (VALUES " + ", ".join(str(p) for p in PAIRS) + ") v(pair, a, b))"
# rows of both arms at levels both played
PAIRED = f"""{EXP}, {PAIRS_SQL},
both_arms AS (
  SELECT pair, 'a' AS side, eg.* FROM pairs JOIN eg ON config = a
  UNION ALL SELECT pair, 'b', eg.* FROM pairs JOIN eg ON config = b),
paired AS (SELECT * FROM both_arms x WHERE
  EXISTS (SELECT 1 FROM both_arms y WHERE y.pair = x.pair AND y.level = x.level AND y.side = 'a') AND
  EXISTS (SELECT 1 FROM both_arms y WHERE y.pair = x.pair AND y.level = x.level AND y.side = 'b'))"""


def cell_sql(score="score", n="games"):
    return (f"regexp_replace(printf('%.1f', {score}), '\\.0$', '') || '/' || {n} || ' (' || w || '-' || d "
            "|| '-' || l || ')'")


@query(
    "cross_table",
    "A07",
    f"""WITH {EXP}
    SELECT *, {cell_sql()} AS cell, printf('%.0f', score * 100 / games) || '%' AS score_pct FROM (
      SELECT config, level, CAST(grouping(level) AS INTEGER) AS is_total, count(*) AS games, sum(score) AS score,
             count(*) FILTER (score = 1) AS w, count(*) FILTER (score = 0.5) AS d,
             count(*) FILTER (score = 0) AS l
      FROM eg GROUP BY GROUPING SETS ((config, level), (config)))""",
)
def cross_table(t: Tables):
    return ex.crosstab(exp_games(t))


_LEVELS = (1100, 1300, 1500, 1700, 1900)


@query(
    "cross_table_wide",
    "A07",
    f"""WITH {EXP}, c AS (
      SELECT config, level, count(*) AS games, sum(score) AS score, count(*) FILTER (score = 1) AS w,
             count(*) FILTER (score = 0.5) AS d, count(*) FILTER (score = 0) AS l
      FROM eg GROUP BY 1, 2),
    x AS (SELECT *, {cell_sql()} AS cell FROM c)
    SELECT config, {', '.join(f'''coalesce(max(cell) FILTER (level = {v}), '–') AS "{v}"''' for v in _LEVELS)},
      regexp_replace(printf('%.1f', sum(score)), '\\.0$', '') || '/' || sum(games) AS total,
      printf('%.0f', sum(score) * 100 / sum(games)) || '%' AS score_pct
    FROM x GROUP BY config""",
)
def cross_table_wide(t: Tables):
    return ex.crosstab_wide(ex.crosstab(exp_games(t)), list(_LEVELS))


@query(
    "cost_ratios",
    "A08",
    f"""WITH {EXP} SELECT config, games, {py_round('usd', 4)} AS cost_usd, CAST(mv AS BIGINT) AS claude_moves,
      {py_round('usd / games', 6)} AS usd_per_game, {py_round('usd / greatest(1, mv)', 6)} AS usd_per_move,
      {py_round('sec / greatest(1, mv)', 6)} AS seconds_per_move
    FROM (SELECT config, count(*) AS games, sum(cost_usd) AS usd, sum(claude_moves) AS mv,
                 sum(claude_seconds) AS sec FROM eg GROUP BY 1)""",
)
def cost_ratios(t: Tables):
    out = ex.cost_ratios(exp_games(t), ["config"])
    return out.select(
        "config", "games", half_even(F.col("cost_usd"), 4).alias("cost_usd"), "claude_moves",
        *[half_even(F.col(c), 6).alias(c) for c in ("usd_per_game", "usd_per_move", "seconds_per_move")],
    )


@query(
    "arm_comparison",
    "A09 J06 X11",
    f"""WITH {PAIRED}
    SELECT pair, games_a, games_b, score_a, score_b,
      {py_round('score_a / games_a - score_b / games_b', 6)} AS delta_score,
      {py_round('ca / games_a', 6)} AS usd_per_game_a, {py_round('cb / games_b', 6)} AS usd_per_game_b,
      {py_round('acpl_a', 6)} AS acpl_a, {py_round('acpl_b', 6)} AS acpl_b,
      CASE WHEN score_a / games_a - score_b / games_b > 0 THEN
        {py_round('(ca / games_a - cb / games_b) / (score_a / games_a - score_b / games_b)', 4)} END AS usd_per_point
    FROM (SELECT pair, count(*) FILTER (side = 'a') AS games_a, count(*) FILTER (side = 'b') AS games_b,
       sum(score) FILTER (side = 'a') AS score_a, sum(score) FILTER (side = 'b') AS score_b,
       sum(cost_usd) FILTER (side = 'a') AS ca, sum(cost_usd) FILTER (side = 'b') AS cb,
       avg(acpl) FILTER (side = 'a') AS acpl_a, avg(acpl) FILTER (side = 'b') AS acpl_b
     FROM paired GROUP BY 1)""",
)
def arm_comparison(t: Tables):
    out = ex.compare_arms(ex.arm_cells(exp_games(t)), pairs(t))
    r = lambda c, d=6: half_even(F.col(c), d).alias(c)
    return out.select(
        "pair", "games_a", "games_b", "score_a", "score_b", r("delta_score"), r("usd_per_game_a"),
        r("usd_per_game_b"), r("acpl_a"), r("acpl_b"), r("usd_per_point", 4),
    )


@query(
    "arm_common_levels",
    "J06 E03",
    """SELECT DISTINCT o_orderpriority AS level FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_mktsegment = 'AUTOMOBILE'
    INTERSECT
    SELECT o_orderpriority FROM orders JOIN customer ON o_custkey = c_custkey
       WHERE c_mktsegment <> 'AUTOMOBILE'""",
)
def arm_common_levels(t: Tables):
    sold = t.orders.join(
        t.customer.withColumnRenamed("c_custkey", "o_custkey"), "o_custkey"
    ).withColumnRenamed("o_orderpriority", "level")
    return ex.common_levels(
        sold.where("c_mktsegment = 'AUTOMOBILE'"), sold.where("c_mktsegment <> 'AUTOMOBILE'")
    )


@query(
    "label_sets",
    "A18",
    f"""WITH {EXP} SELECT (SELECT string_agg(config, ',' ORDER BY config) FROM (SELECT DISTINCT config FROM eg)) AS configs,
    (SELECT string_agg(CAST(level AS VARCHAR), ',' ORDER BY level) FROM (SELECT DISTINCT level FROM eg)) AS levels""",
)
def label_sets(t: Tables):
    out = ex.label_sets(exp_games(t), ["config", "level"])
    return out.select(
        F.array_join("config", ",").alias("configs"),
        F.array_join(F.col("level").cast("array<string>"), ",").alias("levels"),
    )


# --- experiment roll-up on the real log schemas --------------------------------------------------
def exp_meta(t: Tables):
    """Customers as runs: specs built from segment and nation."""
    subject = F.when(F.col("c_nationkey") % 3 == 0, F.lit("naive")).otherwise(F.lit("hybrid-ctx"))
    level = (F.pmod("c_nationkey", F.lit(5)) * 200 + 1100).cast("string")
    foe = F.when(F.col("c_nationkey") == 7, F.lit("maia")).otherwise(F.concat(F.lit("maia:"), level))
    white_first = F.col("c_custkey") % 2 == 0
    model = (
        F.when(F.col("c_mktsegment") == "BUILDING", F.lit("x-haiku-1"))
        .when(F.col("c_mktsegment") == "MACHINERY", F.lit("x-sonnet-1"))
        .otherwise(F.col("c_mktsegment"))
    )
    return t.customer.select(
        F.concat(F.lit("run-"), F.col("c_custkey").cast("string")).alias("run_id"),
        F.when(white_first, subject).otherwise(foe).alias("white_spec"),
        F.when(white_first, foe).otherwise(subject).alias("black_spec"),
        model.alias("model"),
        F.when(F.col("c_acctbal") > 5000, F.lit(3)).when(F.col("c_acctbal") > 2000, F.lit(0)).alias("ctx_version"),
    )


_META = """
meta AS (
  SELECT 'run-' || c_custkey AS run_id, c_custkey,
    CASE WHEN c_nationkey % 3 = 0 THEN 'naive' ELSE 'hybrid-ctx' END AS spec,
    CASE WHEN c_nationkey = 7 THEN NULL ELSE (c_nationkey % 5) * 200 + 1100 END AS level,
    CASE c_mktsegment WHEN 'BUILDING' THEN 'haiku' WHEN 'MACHINERY' THEN 'sonnet' ELSE c_mktsegment END AS model,
    CASE WHEN c_acctbal > 5000 THEN 3 END AS v
  FROM customer),
conf AS (
  SELECT run_id, c_custkey, CAST(level AS INTEGER) AS level, model, spec <> 'naive' AS harness,
    model || CASE WHEN spec <> 'naive' THEN '-harness' || coalesce('-ctx' || v, '') ELSE '-naive' END AS config
  FROM meta WHERE level IS NOT NULL)"""


@query(
    "experiment_configs",
    "P12",
    f"WITH {_META} SELECT run_id, level, model, harness, config FROM conf",
)
def experiment_configs(t: Tables):
    return ex.config_of(exp_meta(t))


def _decisions(t: Tables):
    """Line items as logged decisions with a nested search record."""
    entry = "struct<source:string,prior:double,vetoed:boolean,threat_verified:boolean>"
    li = t.lineitem
    p = F.pmod("l_partkey", F.lit(10)) / 10.0
    cand = F.map_from_entries(
        F.array(
            F.struct(F.lit("m1").alias("k"), F.struct(F.lit("claude").alias("source"), p.alias("prior"),
                     (F.col("l_returnflag") == "R").alias("vetoed"), F.lit(None).cast("boolean").alias("threat_verified")).cast(entry).alias("v")),
            F.struct(F.lit("m2").alias("k"), F.struct(F.lit("claude").alias("source"), F.lit(0.5).alias("prior"),
                     F.lit(False).alias("vetoed"), (F.col("l_linestatus") == "O").alias("threat_verified")).cast(entry).alias("v")),
            F.struct(F.lit("m3").alias("k"), F.struct(F.lit("engine").alias("source"), F.lit(0.0).alias("prior"),
                     F.lit(False).alias("vetoed"), F.lit(None).cast("boolean").alias("threat_verified")).cast(entry).alias("v")),
        )
    )
    searched = F.col("l_quantity") < 40
    decided = F.when(F.col("l_tax") == 0, F.lit("mate in 3 plies")).otherwise(F.lit("hybrid"))
    note = (
        F.when(F.col("l_quantity") >= 48, F.lit("only legal move"))
        .when(F.col("l_discount") == 0, F.lit("fail-low: searched all moves"))
        .otherwise(F.lit("plain"))
    )
    san = F.concat(F.lit("m"), (F.pmod("l_suppkey", F.lit(4)) + 1).cast("string"))
    return li.select(
        F.col("l_orderkey").alias("game"),
        F.when(F.col("l_linenumber") == 7, F.lit("maia-1100")).otherwise(F.lit("hybrid")).alias("player"),
        F.struct(
            F.when(searched, decided).alias("decided_by"), F.when(searched, cand).alias("candidates")
        ).alias("search"),
        note.alias("note"),
        san.alias("san"),
        F.col("l_tax").alias("cost"),
        F.col("l_discount").alias("seconds"),
        "l_returnflag",
    )


_DEC = """
dec AS (
  SELECT *, l_quantity < 40 AS searched, l_quantity >= 48 AS only_move,
    l_quantity < 48 AND l_discount = 0 AS fail_low, 'm' || (l_suppkey % 4 + 1) AS san,
    CASE WHEN (l_partkey % 10) / 10.0 >= 0.5 THEN 'm1' ELSE 'm2' END AS top
  FROM lineitem),
fl AS (
  SELECT *, 1 AS moves, CAST(searched AND san = top AS INT) AS top_played,
    CAST(searched AND CASE top WHEN 'm1' THEN l_returnflag = 'R' ELSE l_linestatus = 'O' END AS INT) AS top_overruled,
    CAST(searched AND san IN ('m1', 'm2') AS INT) AS claude_proposed,
    CAST(searched AND san = 'm3' AS INT) AS search_added, CAST(fail_low AS INT) AS fail_low_i,
    CAST(only_move OR (searched AND l_tax = 0) AS INT) AS no_claude_value
  FROM dec WHERE searched OR only_move)"""


@query(
    "reliance_by_group",
    "A05 A06 J17",
    f"""WITH {_DEC} SELECT *, {', '.join(f"printf('%.0f', {k} * 100.0 / moves) || '%' AS {k}_pct" for k in ('top_played', 'top_overruled', 'claude_proposed', 'search_added', 'fail_low', 'no_claude_value'))}
    FROM (SELECT l_returnflag, CAST(sum(moves) AS BIGINT) AS moves, CAST(sum(top_played) AS BIGINT) AS top_played,
      CAST(sum(top_overruled) AS BIGINT) AS top_overruled, CAST(sum(claude_proposed) AS BIGINT) AS claude_proposed,
      CAST(sum(search_added) AS BIGINT) AS search_added, CAST(sum(fail_low_i) AS BIGINT) AS fail_low,
      CAST(sum(no_claude_value) AS BIGINT) AS no_claude_value FROM fl GROUP BY 1)""",
)
def reliance_by_group(t: Tables):
    return ex.reliance(_decisions(t), ["l_returnflag"])


@query(
    "experiment_games",
    "A04 A05 P12",
    f"""WITH {_META}, {_DEC},
    spent AS (SELECT l_orderkey AS game, sum(l_tax) AS cost, count(*) AS n, sum(l_discount) AS sec
              FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1),
    rel AS (SELECT l_orderkey AS game, sum(moves) AS moves, sum(top_played) AS top_played, sum(search_added) AS search_added
            FROM fl WHERE l_linenumber <> 7 GROUP BY 1),
    acc AS (SELECT l_orderkey AS game, avg(least(coalesce(CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice) AS BIGINT) % 2000 END, 0), 1000)) AS acpl
            FROM lineitem WHERE l_linenumber <> 7 GROUP BY 1)
    SELECT run_id AS run, CAST(o.o_orderkey AS BIGINT) AS game, config, level,
      CASE WHEN o_orderkey % 2 = 0 THEN 'white' ELSE 'black' END AS color,
      CASE WHEN o_orderstatus = 'P' THEN 0.5::DOUBLE WHEN (o_orderstatus = 'F') = (o_orderkey % 2 = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score,
      {py_round('acpl', 6)} AS acpl, {py_round('coalesce(cost, 0)', 5)} AS cost_usd,
      coalesce(n, 0) AS claude_moves, {py_round('coalesce(sec, 0)', 1)} AS claude_seconds,
      CAST(moves AS BIGINT) AS rel_moves, CAST(top_played AS BIGINT) AS rel_top_played, CAST(search_added AS BIGINT) AS rel_added
    FROM orders o JOIN conf ON c_custkey = o_custkey LEFT JOIN spent ON spent.game = o_orderkey
    LEFT JOIN rel ON rel.game = o_orderkey LEFT JOIN acc ON acc.game = o_orderkey
    WHERE o_totalprice >= 20000""",
)
def experiment_games(t: Tables):
    run = F.concat(F.lit("run-"), F.col("o_custkey").cast("string"))
    white = F.col("o_orderkey") % 2 == 0
    games = t.orders.select(
        run.alias("run_id"),
        F.col("o_orderkey").alias("game"),
        F.when(white, F.lit("hybrid")).otherwise(F.lit("maia-1100")).alias("white"),
        F.when(white, F.lit("maia-1100")).otherwise(F.lit("hybrid")).alias("black"),
        F.when(F.col("o_totalprice") < 20000, F.lit("*"))
        .when(F.col("o_orderstatus") == "F", F.lit("1-0"))
        .when(F.col("o_orderstatus") == "O", F.lit("0-1"))
        .otherwise(F.lit("1/2-1/2"))
        .alias("result"),
        F.lit("").alias("termination"),
        F.lit(0).alias("plies"),
    )
    owner = t.orders.select(F.col("o_orderkey").alias("game"), run.alias("run_id"))
    decisions = _decisions(t).join(owner, "game")
    evals = t.lineitem.select(
        F.col("l_orderkey").alias("game"),
        F.when(F.col("l_linenumber") == 7, F.lit("maia-1100")).otherwise(F.lit("hybrid")).alias("player"),
        F.when(F.col("l_linestatus") == "F", F.pmod(F.floor("l_extendedprice"), F.lit(2000))).alias("cpl"),
    ).join(owner, "game")
    out = ex.experiment_games(exp_meta(t), games, decisions, evals)
    return out.select(
        "run", "game", "config", "level", "color", "score", half_even(F.col("acpl"), 6).alias("acpl"),
        "cost_usd", "claude_moves",
        "claude_seconds",
        F.col("reliance.moves").alias("rel_moves"),
        F.col("reliance.top_played").alias("rel_top_played"),
        F.col("reliance.search_added").alias("rel_added"),
    )


@query(
    "live_progress",
    "A13",
    """SELECT done, 20000 AS expected, done * 100.0::DOUBLE / 20000 AS pct, CAST(printf('%.4f', cost) AS DOUBLE) AS cost,
      CAST(printf('%.4f', 3600.0::DOUBLE / done * (20000 - done)) AS DOUBLE) AS eta_seconds
    FROM (SELECT (SELECT count(*) FROM events WHERE event_type = 'purchase') AS done,
                 (SELECT sum(value) FROM events) AS cost)""",
)
def live_progress(t: Tables):
    done = t.events.where("event_type = 'purchase'")
    out = ex.progress(done, t.events.select(F.col("value").alias("cost")), 20000, F.lit(3600.0))
    return out.withColumn("cost", half_even(F.col("cost"), 4)).withColumn(
        "eta_seconds", half_even(F.col("eta_seconds"), 4)
    )


@query(
    "games_in_progress",
    "J14 S11",
    """WITH x AS (SELECT event_type AS file, CAST(user_id AS VARCHAR) AS game, max(event_id) FILTER (value >= 5) AS ply,
         bool_or(value < 5) AS done FROM events GROUP BY 1, 2)
    SELECT file, game, ply, done FROM x WHERE NOT done AND ply IS NOT NULL""",
)
def games_in_progress(t: Tables):
    from rookery.sources.logs import progress_lines

    user, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    line = F.when(F.col("value") < 5, F.concat(F.lit("[g"), user, F.lit("] RESULT 1-0 after "), eid)).otherwise(
        F.concat(F.lit("[g"), user, F.lit("] ply   "), eid, F.lit("  move"))
    )
    lines = t.events.select(F.col("event_type").alias("file"), line.alias("value"))
    return ex.in_progress(progress_lines(lines))


@query(
    "progress_log",
    "S11",
    """SELECT event_type AS file, CAST(user_id AS VARCHAR) AS game, max(event_id) FILTER (value >= 5) AS ply,
         bool_or(value < 5) AS done FROM events GROUP BY 1, 2""",
)
def progress_log(t: Tables):
    from rookery.sources.logs import progress_lines

    user, eid = F.col("user_id").cast("string"), F.col("event_id").cast("string")
    line = F.when(F.col("value") < 5, F.concat(F.lit("[g"), user, F.lit("] RESULT 1-0 after "), eid)).otherwise(
        F.concat(F.lit("[g"), user, F.lit("] ply   "), eid, F.lit("  move"))
    )
    return progress_lines(t.events.select(F.col("event_type").alias("file"), line.alias("value")))


@query(
    "label_union",
    "E02",
    "SELECT c_mktsegment AS label FROM customer UNION SELECT event_type FROM events",
)
def label_union(t: Tables):
    return ex.label_union(
        t.customer.select(F.col("c_mktsegment").alias("label")),
        t.events.select(F.col("event_type").alias("label")),
        "label",
    )


@query(
    "key_intersect",
    "E03",
    "SELECT DISTINCT o_custkey AS k FROM orders INTERSECT SELECT user_id FROM events",
)
def key_intersect(t: Tables):
    return ex.key_intersect(
        t.orders.select(F.col("o_custkey").alias("k")),
        t.events.select(F.col("user_id").alias("k")),
        "k",
    )


@query(
    "union_runs",
    "E01",
    """SELECT k, count(*) AS n, count(note) AS notes FROM (
      SELECT c_nationkey AS k, c_mktsegment AS note FROM customer UNION ALL SELECT s_nationkey, NULL FROM supplier)
    GROUP BY 1""",
)
def union_runs(t: Tables):
    u = ex.union_runs(
        t.customer.select(F.col("c_nationkey").alias("k"), F.col("c_mktsegment").alias("note")),
        t.supplier.select(F.col("s_nationkey").alias("k")),
    )
    return u.groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.count("note").alias("notes"))


