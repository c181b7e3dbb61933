"""Scalar rules applied to whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, py_round, query
from rookery.functions import names, scoring, splits, text
from rookery.functions.numeric import clamp, half_even
from rookery.operators import candidates as cd


@query(
    "player_names",
    "P02",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 3 THEN 'random' ELSE 'engine-ctx' END AS kind,
      CASE WHEN c_custkey % 4 IN (0, 1) THEN lower(c_mktsegment) END AS model,
      CAST(CASE WHEN c_custkey % 4 <> 3 THEN c_nationkey END AS INTEGER) AS depth,
      CAST(CASE WHEN c_custkey % 4 = 1 THEN c_custkey END AS INTEGER) AS elo,
      CASE WHEN c_custkey % 4 = 2 THEN 'full' END AS strength FROM customer""",
)
def player_names(t: Tables):
    k, seg, nat = F.col("c_custkey"), F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("engine-ctx(d"), nat, F.lit(","), seg, F.lit(")")))
        .when(k % 4 == 1, F.concat(F.lit("engine-ctx("), seg, F.lit(", d"), nat, F.lit(",elo"), k.cast("string"), F.lit(")#A")))
        .when(k % 4 == 2, F.concat(F.lit("engine-ctx(full,d"), nat, F.lit(")#B")))
        .otherwise(F.lit("random#A"))
    )
    p = names.parse_player(name)
    return t.customer.select("c_custkey", p.alias("p")).select(
        "c_custkey", "p.kind", "p.model", "p.depth", "p.elo", F.col("p.config")["strength"].alias("strength")
    )


@query(
    "loss_bands",
    "P08",
    """SELECT l_returnflag, cls, count(*) AS n FROM (SELECT l_returnflag, CASE WHEN c IS NULL THEN NULL WHEN c >= 300 THEN 'blunder'
      WHEN c >= 100 THEN 'mistake' WHEN c >= 50 THEN 'inaccuracy' ELSE 'ok' END AS cls FROM (
      SELECT l_returnflag, CASE WHEN l_linestatus = 'F' THEN CAST(floor(l_extendedprice) AS BIGINT) % 1001 END AS c FROM lineitem)) GROUP BY 1, 2""",
)
def loss_bands(t: Tables):
    loss = F.when(F.col("l_linestatus") == "F", F.pmod(F.floor("l_extendedprice"), F.lit(1001)))
    return t.lineitem.groupBy("l_returnflag", scoring.band(loss).alias("cls")).agg(
        F.count(F.lit(1)).alias("n")
    )


@query(
    "side_score_rule",
    "P09",
    """SELECT o_orderkey, CASE WHEN o_totalprice < 20000 THEN NULL WHEN o_orderstatus = 'P' THEN 0.5::DOUBLE
      WHEN (o_orderstatus = 'F') = (o_orderkey % 2 = 0) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS score FROM orders""",
)
def side_score_rule(t: Tables):
    result = (
        F.when(F.col("o_totalprice") < 20000, F.lit("*")).when(F.col("o_orderstatus") == "F", F.lit("1-0"))
        .when(F.col("o_orderstatus") == "O", F.lit("0-1")).otherwise(F.lit("1/2-1/2"))
    )
    color = F.when(F.col("o_orderkey") % 2 == 0, F.lit("white")).otherwise(F.lit("black"))
    return t.orders.select("o_orderkey", scoring.side_score(result, color).alias("score"))


@query(
    "subject_names",
    "P10",
    """SELECT p_partkey, p_name LIKE '%ring%' OR p_name LIKE '%bolt%' AS subject,
      NOT (p_name LIKE '%red%' OR p_name LIKE '%small%') AS not_foe FROM part""",
)
def subject_names(t: Tables):
    return t.part.select(
        "p_partkey", names.name_any(F.col("p_name"), ("ring", "bolt")).alias("subject"),
        names.name_none(F.col("p_name"), ("red", "small")).alias("not_foe"),
    )


@query(
    "drop_moveless",
    "P11",
    "SELECT event_type, count(*) AS n FROM events WHERE event_type <> 'error' AND value > 5 GROUP BY 1",
)
def drop_moveless(t: Tables):
    san = F.when(F.col("event_type") == "error", F.lit("")).when(F.col("value") > 5, F.lit("e4"))
    return (
        cd.with_move(t.events.withColumn("san", san)).groupBy("event_type").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "rough_strength",
    "P13",
    """SELECT l_suppkey, CAST(CAST(printf('%.0f', 3100 * exp(-0.01 * m)) AS DOUBLE) AS INTEGER) AS elo FROM (
      SELECT l_suppkey, CAST(sum(CAST(floor(l_extendedprice) AS BIGINT) % 1001) AS DOUBLE) / count(*) AS m FROM lineitem GROUP BY 1)""",
)
def rough_strength(t: Tables):
    loss = F.pmod(F.floor("l_extendedprice"), F.lit(1001))
    return (
        t.lineitem.groupBy("l_suppkey").agg((F.sum(loss) / F.count(F.lit(1))).alias("m"))
        .select("l_suppkey", scoring.rough_elo(F.col("m")).alias("elo"))
    )


@query(
    "token_costs",
    "P14",
    f"""SELECT conv_id, turn, {py_round("CASE role WHEN 'user' THEN (length(text) * 5.0 + turn * 25.0) / 1e6 WHEN 'assistant' THEN (length(text) * 1.0 + turn * 5.0) / 1e6 ELSE 0 END", 9)} AS usd FROM conversations""",
)
def token_costs(t: Tables):
    model = (
        F.when(F.col("role") == "user", F.lit("x-opus-1")).when(F.col("role") == "assistant", F.lit("haiku-y"))
        .otherwise(F.lit("none"))
    )
    cost = scoring.token_cost(model, F.length("text"), F.col("turn"))
    return t.conversations.select("conv_id", "turn", half_even(cost, 9).alias("usd"))


@query(
    "outage_messages",
    "P15",
    """SELECT doc_id, regexp_matches(lower(text), 'limit|429|overloaded|rate|529|quota') AS outage FROM documents""",
)
def outage_messages(t: Tables):
    return t.documents.select("doc_id", scoring.is_outage(F.col("text")).alias("outage"))


@query(
    "white_view",
    "P16 P25",
    """SELECT event_id, CASE WHEN user_id % 2 = 0 THEN v ELSE -v END AS ev,
      greatest(-800, least(800, coalesce(CASE WHEN user_id % 2 = 0 THEN v ELSE -v END, 0))) AS plot FROM (
      SELECT event_id, user_id, CASE WHEN event_type <> 'signup' THEN CAST(round((value - 10) * 100) AS BIGINT) END AS v FROM events)""",
)
def white_view(t: Tables):
    v = F.when(F.col("event_type") != "signup", F.round((F.col("value") - 10) * 100).cast("bigint"))
    ev = scoring.white_view(F.when(F.col("user_id") % 2 == 0, F.lit("white")).otherwise(F.lit("black")), v)
    return t.events.select("event_id", ev.alias("ev"), scoring.plot_value(ev).cast("bigint").alias("plot"))


@query(
    "score_wording",
    "P17",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN c IS NULL THEN '?' WHEN c >= 9000 THEN 'mates' WHEN c <= -9000 THEN 'gets mated'
      WHEN c = 0 THEN 'material level' WHEN c > 0 THEN 'wins ' || printf('%.1f', c / 100.0::DOUBLE) || ' pawns'
      ELSE 'loses ' || printf('%.1f', -c / 100.0::DOUBLE) || ' pawns' END AS words
    FROM (SELECT *, CASE WHEN l_returnflag = 'R' THEN NULL ELSE CAST(floor(l_extendedprice) AS BIGINT) % 20001 - 10000 END AS c FROM lineitem)""",
)
def score_wording(t: Tables):
    cp = F.when(F.col("l_returnflag") != "R", F.pmod(F.floor("l_extendedprice"), F.lit(20001)) - 10000)
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", scoring.score_wording(cp).alias("words")
    )


def _cands(t: Tables):
    """Three logged candidates per event out of its value."""
    v = F.col("value")
    c = lambda i, s: F.struct(F.lit(f"m{i}").alias("san"), s.alias("score_cp"))
    return t.events.select(
        "event_id", "event_type",
        F.array(c(1, v), c(2, F.when(v > 10, v * 2)), c(1, v * 3)).alias("candidates"),
        F.concat(F.lit("m"), (F.pmod("user_id", F.lit(3)) + 1).cast("string")).alias("san"),
    )


@query(
    "own_eval",
    "P18",
    """SELECT event_id, CASE user_id % 3 WHEN 0 THEN value WHEN 1 THEN CASE WHEN value > 10 THEN value * 2 END END AS own_eval FROM events""",
)
def own_eval(t: Tables):
    return _cands(t).select(
        "event_id", cd.own_eval(F.col("candidates"), F.col("san")).alias("own_eval")
    )


@query(
    "own_candidates",
    "P19",
    """SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_quantity < 20 THEN CASE WHEN l_returnflag = 'R' THEN 'a' ELSE 'a,c' END
      WHEN l_quantity < 40 THEN 'x,y' WHEN l_tax > 0 THEN 'z' ELSE '' END AS own FROM lineitem""",
)
def own_candidates(t: Tables):
    e = lambda k, s: F.struct(F.lit(k).alias("k"), F.struct(s.alias("source")).alias("v"))
    src = F.when(F.col("l_returnflag") == "R", F.lit("engine")).otherwise(F.lit("claude"))
    search = F.map_from_entries(F.array(e("a", F.lit("claude")), e("b", F.lit("engine")), e("c", src)))
    cands = F.array(F.struct(F.lit("x").alias("san")), F.struct(F.lit("y").alias("san")))
    q = F.col("l_quantity")
    own = cd.own_candidates(
        F.when(q < 20, search), F.when(q < 40, cands), F.when(F.col("l_tax") > 0, F.lit("z"))
    )
    return t.lineitem.select(
        "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", F.array_join(own, ",").alias("own")
    )


@query(
    "move_claims",
    "P20",
    """SELECT doc_id, n, CASE WHEN m IN ('the', 'of', 'and', 'O-O', 'la') THEN m END AS move,
      CASE WHEN m = '' THEN 'empty move' WHEN m IN ('the', 'of', 'and', 'O-O', 'la') THEN '' ELSE 'illegal in this position' END AS reason
    FROM (SELECT doc_id, n, replace(replace(regexp_replace(trim(w), '[.!?]+$', ''), '0-0-0', 'O-O-O'), '0-0', 'O-O') AS m FROM (
      SELECT doc_id, unnest(regexp_split_to_array(text, '[ \\n\\t]+')) AS w, generate_subscripts(regexp_split_to_array(text, '[ \\n\\t]+'), 1) AS n FROM documents))""",
)
def move_claims(t: Tables):
    words = t.documents.select("doc_id", F.posexplode(F.split("text", r"[ \n\t]+")).alias("p", "w"))
    legal = F.array(*[F.lit(x) for x in ("the", "of", "and", "O-O", "la")])
    claim = text.check_claim(F.col("w"), legal)
    return words.select("doc_id", (F.col("p") + 1).cast("bigint").alias("n"), claim.alias("c")).select(
        "doc_id", "n", "c.move", "c.reason"
    )


@query(
    "normalised_candidates",
    "P21",
    """WITH raw AS (SELECT l_orderkey, l_linenumber * 100000000 + l_partkey AS pos,
        CASE WHEN l_returnflag = 'R' AND l_tax = 0 THEN NULL ELSE 'm' || (l_suppkey % 4) END AS mv,
        CASE WHEN l_returnflag = 'A' THEN least(1.0, greatest(0.0, l_discount * 15 - 0.2)) ELSE 0.0 END AS prior, l_extendedprice FROM lineitem),
      d AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey, mv ORDER BY pos, l_extendedprice) AS r FROM raw WHERE mv IS NOT NULL)
    SELECT l_orderkey, mv AS move, CAST(printf('%.6f', CAST(prior AS DOUBLE)) AS DOUBLE) AS prior, k AS rank FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY prior DESC, pos, l_extendedprice) AS INTEGER) AS k FROM d WHERE r = 1) WHERE k <= 3""",
)
def normalised_candidates(t: Tables):
    """Items are JSON: a bare string, an object, or junk."""
    mv = F.concat(F.lit("m"), F.pmod("l_suppkey", F.lit(4)).cast("string"))
    item = (
        F.when((F.col("l_returnflag") == "R") & (F.col("l_tax") == 0), F.lit("[1, 2]"))
        .when(F.col("l_returnflag") == "R", F.concat(F.lit('"'), mv, F.lit('"')))
        .when(F.col("l_returnflag") == "N", F.concat(F.lit('{"move": "'), mv, F.lit('", "prior": "high"}')))
        .otherwise(
            F.concat(F.lit('{"move": "'), mv, F.lit('", "prior": '), (F.col("l_discount") * 15 - 0.2).cast("string"), F.lit("}"))
        )
    )
    items = t.lineitem.select(
        "l_orderkey", (F.col("l_linenumber").cast("bigint") * 100000000 + F.col("l_partkey")).alias("a"),
        F.col("l_extendedprice").alias("b"), item.alias("item"),
    )
    out = cd.normalise_candidates(items, ["l_orderkey"], "item", ["a", "b"], 3)
    return out.select("l_orderkey", "move", half_even(F.col("prior"), 6).alias("prior"), "rank")


@query(
    "illegal_flags",
    "P22",
    """SELECT event_type, count(*) FILTER (value > 15) AS illegal, count(*) FILTER (value > 40) AS forced FROM events GROUP BY 1""",
)
def illegal_flags(t: Tables):
    attempts = F.when(F.col("value") > 15, F.array(F.lit("x"))).otherwise(F.array().cast("array<string>"))
    return t.events.groupBy("event_type").agg(
        F.sum(scoring.skip_known_illegal(attempts)).alias("illegal"),
        F.count_if(F.col("value") > 40).alias("forced"),
    )


@query(
    "display_names",
    "P23",
    """SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'Claude ' || lower(c_mktsegment) || '-' || c_nationkey || ' + harness'
      WHEN 1 THEN 'Claude + harness' WHEN 2 THEN 'Claude ' || lower(c_mktsegment) || '-' || c_nationkey || '-1 (no harness)'
      ELSE 'maia-' || c_custkey END AS label FROM customer""",
)
def display_names(t: Tables):
    k, seg, nat = F.col("c_custkey"), F.lower("c_mktsegment"), F.col("c_nationkey").cast("string")
    name = (
        F.when(k % 4 == 0, F.concat(F.lit("hybrid-ctx(t2,claude-"), seg, F.lit("-"), nat, F.lit(")")))
        .when(k % 4 == 1, F.lit("engine(d1)"))
        .when(k % 4 == 2, F.concat(F.lit("naive(claude-"), seg, F.lit("-"), nat, F.lit("-1)")))
        .otherwise(F.concat(F.lit("maia-"), k.cast("string")))
    )
    return t.customer.select("c_custkey", names.display_name(name).alias("label"))


@query(
    "adjudications",
    "P24",
    """SELECT event_id, CASE WHEN cp >= 300 THEN '1-0' WHEN cp <= -300 THEN '0-1' ELSE '1/2-1/2' END AS result
      FROM (SELECT event_id, CAST(round((value - 10) * 100) AS BIGINT) AS cp FROM events)""",
)
def adjudications(t: Tables):
    cp = F.round((F.col("value") - 10) * 100).cast("bigint")
    return t.events.select("event_id", scoring.adjudicate(cp).alias("result"))


@query(
    "clamped_scores",
    "P25",
    "SELECT event_id, greatest(5.0, least(20.0, value)) AS v FROM events",
)
def clamped_scores(t: Tables):
    return t.events.select("event_id", clamp(F.col("value"), 5.0, 20.0).alias("v"))


@query(
    "adjudication_text",
    "P05",
    """SELECT doc_id, CAST(CASE WHEN n_chars % 3 = 0 THEN n_chars WHEN n_chars % 3 = 1 THEN -n_chars END AS INTEGER) AS cp FROM documents""",
)
def adjudication_text(t: Tables):
    n = F.col("n_chars").cast("string")
    note = (
        F.when(F.col("n_chars") % 3 == 0, F.concat(F.lit(" SF eval +"), n, F.lit("cp)")))
        .when(F.col("n_chars") % 3 == 1, F.concat(F.lit(" (ply cap 200, SF eval -"), n, F.lit("cp) ")))
        .otherwise(F.lit(" SF eval cp"))
    )
    return t.documents.select("doc_id", scoring.adjudication_cp(F.concat("text", note)).alias("cp"))


@query(
    "termination_kinds",
    "P06",
    "SELECT event_type AS kind, count(*) AS n FROM events GROUP BY 1",
)
def termination_kinds(t: Tables):
    term = F.concat("event_type", F.when(F.col("value") > 10, F.lit(" (detail x)")).otherwise(F.lit("")))
    return t.events.groupBy(scoring.termination_kind(term).alias("kind")).agg(F.count(F.lit(1)).alias("n"))


@query(
    "group_split",
    "D04",
    """SELECT doc_id, source, CASE d WHEN 0 THEN 'test' WHEN 1 THEN 'val' ELSE 'train' END AS split FROM (
      SELECT doc_id, source, list_reduce(list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(h, CAST(i AS INTEGER), 1)) - 1),
        lambda a, c: (a * 16 + c) % 10, CAST(0 AS BIGINT)) AS d FROM (SELECT doc_id, source, sha1(source || ':' || doc_id) AS h FROM documents))""",
)
def group_split(t: Tables):
    return t.documents.select(
        "doc_id", "source", splits.group_split(F.col("source"), F.col("doc_id")).alias("split")
    )


@query(
    "json_in_text",
    "U02",
    """SELECT event_id, CASE WHEN event_id % 5 = 4 THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS INTEGER) END AS k FROM events""",
)
def json_in_text(t: Tables):
    p, k = F.col("props"), F.col("event_id") % 5
    reply = (
        F.when(k == 0, p)
        .when(k == 1, F.concat(F.lit("Sure!\n```json\n"), p, F.lit("\n```\nbye {x}")))
        .when(k == 2, F.concat(F.lit("I {think} so: "), p, F.lit(" trailing")))
        .when(k == 3, F.concat(F.lit("```\nnot json\n``` then "), p))
        .otherwise(F.lit("no object here {really}"))
    )
    found = text.extract_json(reply)
    return t.events.select(
        "event_id", F.get_json_object(found, "$.k").cast("int").alias("k")
    )


@query(
    "html_escaped",
    "P23",
    """SELECT page_id, md5(replace(replace(replace(replace(replace(html, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), '''', '&#x27;')) AS digest FROM pages""",
)
def html_escaped(t: Tables):
    return t.pages.select("page_id", F.md5(text.html_escape(F.col("html")).cast("binary")).alias("digest"))
