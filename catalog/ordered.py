"""Windows over plies and event series, top-k, dedupe, streaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, query
from rookery.operators import ordered as od
from rookery.operators import windows as wi

_EV = "(SELECT *, CAST(round((value - 10) * 100) AS BIGINT) AS cp FROM events)"


def series(t: Tables):
    """Events as an evaluation series per user: cp = (value − 10) in hundredths."""
    return t.events.select(
        "user_id", "ts", "event_id", "event_type",
        F.round((F.col("value") - 10) * 100).cast("bigint").alias("cp"),
    )


ORDER = ["ts", "event_id"]


def by_day():
    return [F.to_date("ts")]


@query(
    "move_loss",
    "W01",
    f"""SELECT event_id, cp AS eval_before, -nx AS eval_after, greatest(0, least(1000, cp + nx)) AS cp_loss
    FROM (SELECT *, lead(cp) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS nx FROM {_EV})
    WHERE nx IS NOT NULL AND event_type <> 'signup'""",
)
def move_loss(t: Tables):
    out = wi.move_loss(
        series(t), ["user_id"], ORDER, "cp", by_day(), skip=F.col("event_type") == "signup"
    )
    return out.select("event_id", "eval_before", "eval_after", "cp_loss")


_STREAK = f"""
s AS (SELECT *, CASE WHEN cp >= 500 THEN 1 WHEN cp <= -500 THEN -1 ELSE 0 END AS side FROM {_EV}),
f AS (SELECT *, CASE WHEN side = lag(side) OVER w THEN 0 ELSE 1 END AS turn FROM s
      WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
i AS (SELECT *, sum(turn) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS island FROM f),
k AS (SELECT *, CASE WHEN side = 0 THEN 0 ELSE row_number() OVER (PARTITION BY user_id, island ORDER BY ts, event_id) END AS streak FROM i)"""


@query("streaks", "W02", f"WITH {_STREAK} SELECT event_id, streak FROM k")
def streaks(t: Tables):
    out = wi.streaks(series(t), ["user_id"], ORDER, wi.side_of(F.col("cp"), 500), by_day())
    return out.select("event_id", "streak")


@query(
    "resign_points",
    "W02",
    f"""WITH {_STREAK} SELECT user_id, arg_min(event_id, struct_pack(a := ts, b := event_id)) AS event_id,
      min(streak) FILTER (streak >= 3) AS streak FROM k WHERE streak >= 3 GROUP BY 1""",
)
def resign_points(t: Tables):
    out = wi.resign_points(series(t), ["user_id"], ORDER, "cp", 500, 3, by_day())
    return out.select("user_id", "event_id", "streak")


@query(
    "carry_forward",
    "W08",
    """SELECT event_id, last_value(CASE WHEN event_type = 'purchase' THEN event_id END IGNORE NULLS)
      OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS last_hit FROM events""",
)
def carry_forward(t: Tables):
    hit = F.when(F.col("event_type") == "purchase", F.col("event_id"))
    return wi.carry_forward(series(t), ["user_id"], ORDER, hit, "last_hit", by_day()).select(
        "event_id", "last_hit"
    )


@query(
    "repetitions",
    "W09",
    """SELECT event_id, row_number() OVER (PARTITION BY user_id, event_type, CAST(floor(value) AS BIGINT) ORDER BY ts, event_id) AS occurrence
      FROM events""",
)
def repetitions(t: Tables):
    e = t.events.select(
        "user_id", "ts", "event_id",
        F.concat_ws(" ", "event_type", F.floor("value").cast("string")).alias("position"),
    )
    out = wi.repetitions(e, ["user_id"], "position", ORDER, by_day())
    return out.select("event_id", "occurrence")


@query(
    "ply_numbers",
    "W05",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_extendedprice,
      row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS ply FROM lineitem""",
)
def ply_numbers(t: Tables):
    chunk = [F.col("l_linenumber"), F.floor(F.col("l_partkey") / 4096)]
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    out = od.ordinal(t.lineitem.select("l_orderkey", *order), ["l_orderkey"], order, chunk, "ply")
    return out.select("l_orderkey", "l_partkey", "l_suppkey", "l_extendedprice", "ply")


@query(
    "latest_rows",
    "W05 K01",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity FROM (
      SELECT *, row_number() OVER (PARTITION BY l_orderkey, l_linenumber
        ORDER BY l_shipdate DESC, l_partkey DESC, l_suppkey DESC, l_quantity DESC, l_extendedprice DESC) AS r FROM lineitem) WHERE r = 1""",
)
def latest_rows(t: Tables):
    seq = ["l_shipdate", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice"]
    out = od.latest(t.lineitem.select("l_orderkey", "l_linenumber", *seq), ["l_orderkey", "l_linenumber"], seq)
    return out.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity")


@query(
    "top_k",
    "W05",
    """SELECT o_orderpriority, o_orderkey, rank FROM (SELECT *, CAST(row_number() OVER
      (PARTITION BY o_orderpriority ORDER BY o_totalprice DESC, o_orderkey) AS INTEGER) AS rank FROM orders) WHERE rank <= 20""",
)
def top_k(t: Tables):
    o = t.orders.select("o_orderpriority", "o_orderkey", "o_totalprice")
    out = od.top_k(o, ["o_orderpriority"], [F.desc("o_totalprice"), F.asc("o_orderkey")], 20)
    return out.select("o_orderpriority", "o_orderkey", "rank")


@query(
    "mid_ranks",
    "W05",
    """SELECT DISTINCT l_returnflag, l_quantity, count(*) OVER (PARTITION BY l_returnflag, l_quantity) AS n,
      rank() OVER (PARTITION BY l_returnflag ORDER BY l_quantity)
        + (count(*) OVER (PARTITION BY l_returnflag, l_quantity) - 1) / 2.0::DOUBLE AS mid_rank FROM lineitem""",
)
def mid_ranks(t: Tables):
    return od.mid_ranks(t.lineitem, "l_quantity", ["l_returnflag"], width=8.0).select(
        "l_returnflag", "l_quantity", "n", "mid_rank"
    )


@query(
    "first_by_role",
    "W06",
    """SELECT conv_id, role, turn FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS r
      FROM conversations) WHERE r = 1""",
)
def first_by_role(t: Tables):
    c = t.conversations.select("conv_id", "role", "turn")
    return od.first(c, ["conv_id", "role"], ["turn"])


@query(
    "margin_filter",
    "W07 C01",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_extendedprice FROM (
      SELECT *, max(l_extendedprice) OVER (PARTITION BY l_orderkey) AS best FROM lineitem)
    WHERE l_extendedprice >= best - 5000""",
)
def margin_filter(t: Tables):
    li = t.lineitem.select("l_orderkey", "l_linenumber", "l_partkey", "l_extendedprice")
    return wi.margin_filter(li, ["l_orderkey"], "l_extendedprice", 5000)


@query(
    "move_history",
    "W03",
    """SELECT doc_id, ply, len(h) AS moves, md5(array_to_string(h, ' ')) AS digest FROM (
      SELECT doc_id, n_chars % 50 + 1 AS ply, regexp_split_to_array(trim(text), '[ \\n\\t]+')[1:(n_chars % 50)] AS h FROM documents)""",
)
def move_history(t: Tables):
    d = t.documents.select(
        "doc_id", (F.pmod("n_chars", F.lit(50)) + 1).alias("ply"),
        F.split(F.trim("text"), r"[ \n\t]+").alias("sans"),
    )
    return wi.history(d).select(
        "doc_id", "ply", F.size("history").alias("moves"),
        F.md5(F.array_join("history", " ").cast("binary")).alias("digest"),
    )


@query(
    "move_tail",
    "W04",
    """WITH w AS (SELECT conv_id, turn, regexp_split_to_array(trim(text), '[ \\n\\t]+') AS a FROM conversations),
    x AS (SELECT conv_id, turn, a, greatest(len(a) - 12, 0) AS s FROM w)
    SELECT conv_id, turn, md5(CASE WHEN len(a) > 12 THEN '... ' ELSE '' END || array_to_string(list_transform(range(s, len(a)),
      lambda i: CASE WHEN i % 2 = 0 THEN (i // 2 + 1) || '. ' || a[i + 1]
        WHEN i = s THEN (i // 2 + 1) || '...' || a[i + 1] ELSE a[i + 1] END), ' ')) AS digest FROM x""",
)
def move_tail(t: Tables):
    words = F.split(F.trim("text"), r"[ \n\t]+")
    return t.conversations.select(
        "conv_id", "turn", F.md5(wi.tail_text(words).cast("binary")).alias("digest")
    )


@query(
    "skip_after_abort",
    "R04",
    """SELECT event_id, coalesce(ts > min(CASE WHEN event_type = 'error' AND value > 40 THEN ts END) OVER (PARTITION BY user_id), false) AS skipped
      FROM events""",
)
def skip_after_abort(t: Tables):
    e = t.events.select("event_id", "user_id", "ts", "event_type", "value")
    bad = (F.col("event_type") == "error") & (F.col("value") > 40)
    return wi.skip_after_abort(e, "user_id", "ts", bad).select("event_id", "skipped")
