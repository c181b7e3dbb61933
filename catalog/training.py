"""Training-data builders on conversations, labels and events."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, py_round, query
from rookery.functions.numeric import half_even
from rookery.functions.splits import group_split
from rookery.operators import training as tr


@query(
    "decisions_with_evals",
    "J01",
    """SELECT d.conv_id, d.turn, quality AS cpl FROM conversations d LEFT JOIN labels ON doc_id = d.conv_id * 3 + d.turn""",
)
def decisions_with_evals(t: Tables):
    d = t.conversations.select((F.col("conv_id") * 3 + F.col("turn")).alias("k"), "conv_id", "turn")
    e = t.labels.select(F.col("doc_id").alias("k"), F.col("quality").alias("cpl"))
    return tr.join_evals(d, e, ["k"]).select("conv_id", "turn", F.col("eval.cpl").alias("cpl"))


@query(
    "decisions_with_results",
    "J02 S13",
    """SELECT o_orderstatus AS result, count(*) AS n FROM lineitem LEFT JOIN orders
      ON l_orderkey = o_orderkey GROUP BY 1""",
)
def decisions_with_results(t: Tables):
    """The game key is text on one side of the logs; it is cast once, at the scan."""
    logged = t.orders.select(
        F.col("o_orderkey").cast("string").alias("game"), F.col("o_orderstatus").alias("result")
    )
    from rookery.sources.logs import _int_game

    d = t.lineitem.select(F.col("l_orderkey").cast("int").alias("game"))
    return (
        tr.join_results(d, _int_game(logged), ["game"]).groupBy("result").agg(F.count(F.lit(1)).alias("n"))
    )


@query(
    "attached_traces",
    "J03",
    """SELECT o.conv_id, coalesce(n, 0) AS calls, roles, digest FROM (SELECT DISTINCT conv_id + conv_id % 2 * 1000 AS conv_id FROM conversations) o
    LEFT JOIN (SELECT conv_id, count(*) AS n, string_agg(role, ',' ORDER BY turn) AS roles, md5(string_agg(text, '|' ORDER BY turn)) AS digest
      FROM conversations GROUP BY 1) t ON t.conv_id = o.conv_id""",
)
def attached_traces(t: Tables):
    d = t.conversations.select((F.col("conv_id") + F.col("conv_id") % 2 * 1000).alias("conv_id")).distinct()
    tr_ = t.conversations.select("conv_id", F.col("turn").alias("call"), "role", "text")
    out = tr.attach_traces(d, tr_, ["conv_id"])
    return out.select(
        "conv_id",
        F.coalesce(F.size("traces"), F.lit(0)).cast("bigint").alias("calls"),
        F.array_join(F.transform("traces", lambda x: x["role"]), ",").alias("roles"),
        F.md5(F.array_join(F.transform("traces", lambda x: x["text"]), "|").cast("binary")).alias("digest"),
    )


def nested(t: Tables):
    """Events as nested position rows with three candidates each."""
    v, u, k = F.col("value"), F.col("user_id"), F.col("event_id")
    m = lambda i: F.concat(F.lit("m"), F.pmod(k + i, F.lit(5)).cast("string"))
    entry = (
        "struct<source:string,tactical_cp:int,engine_reply:string,vetoed:boolean,threat_reply:string,"
        "threat_cp:int,threat_verified:boolean>"
    )

    def found(src, cp, reply, veto, threat):
        return F.struct(
            src.alias("source"), cp.cast("int").alias("tactical_cp"), reply.alias("engine_reply"), veto.alias("vetoed"),
            F.lit("Qh4").alias("threat_reply"), F.lit(-250).alias("threat_cp"), threat.alias("threat_verified"),
        ).cast(entry)

    cp = F.floor(v * 100) - 2000
    cands = F.map_from_entries(
        F.array(
            F.struct(m(0).alias("k"), found(F.lit("claude"), F.lit(0), F.lit(None).cast("string"), F.lit(False), F.lit(False)).alias("v")),
            F.struct(m(1).alias("k"), found(F.lit("claude"), cp, F.when(v > 3, F.lit("Nf6")), v < 12, F.lit(False)).alias("v")),
            F.struct(m(2).alias("k"), found(F.lit("claude"), cp, F.lit("a5"), F.lit(False), u % 2 == 0).alias("v")),
            F.struct(m(3).alias("k"), found(F.lit("engine"), F.lit(900), F.lit("b5"), v < 6, F.lit(False)).alias("v")),
        )
    )
    cand = lambda i, r: F.struct(m(i).alias("move"), F.lit(r).alias("reason"), F.lit(0.5).alias("prior"))
    proposer = F.struct(
        F.when(v > 8, F.lit("calm")).alias("thinking"),
        F.when(u % 7 != 0, F.array(cand(0, " solid "), cand(1, "sharp"), cand(2, "odd"))).alias("candidates"),
        F.when(u % 3 == 0, F.array(F.lit("Qxd2"), F.lit("Ra1"))).alias("threats"),
    )
    return t.events.drop("props", "ts").select(
        "event_id",
        F.concat_ws(":", "user_id", "event_id").alias("id"),
        group_split(F.lit("run"), u).alias("split"),
        F.concat(F.lit("8/8 "), F.when(u % 2 == 0, F.lit("w")).otherwise(F.lit("b")), F.lit(" - -")).alias("fen"),
        F.array(F.lit("e4"), F.lit("e5")).alias("history_san"),
        F.struct(proposer.alias("proposer"), F.struct(F.lit("plain").alias("thinking")).alias("naive")).alias("agents"),
        F.struct(F.when(v > 20, F.lit("mate in 3 plies")).otherwise(F.lit("hybrid")).alias("decided_by"), cands.alias("candidates")).alias("engine"),
        F.struct(F.when(u % 5 == 0, F.when(v > 10, F.array(F.lit("Nd4"))).otherwise(F.array().cast("array<string>"))).alias("threats_real")).alias("board_read"),
        F.struct(F.when(F.col("event_type") != "view", m(0)).otherwise(m(4)).alias("san"), F.lit(False).alias("forced_random")).alias("decision"),
        F.struct(F.when(F.col("event_type") != "error", F.floor(v * 4).cast("int")).alias("cp_loss"), F.lit(0.5).alias("game_result")).alias("labels"),
    )


_W = "CASE WHEN {c} >= 9000 THEN 'mates' WHEN {c} <= -9000 THEN 'gets mated' WHEN {c} = 0 THEN 'material level' WHEN {c} > 0 THEN 'wins ' || printf('%.1f', {c} / 100.0::DOUBLE) || ' pawns' ELSE 'loses ' || printf('%.1f', -{c} / 100.0::DOUBLE) || ' pawns' END"
_NESTED = f"""
n AS (SELECT *, CAST(floor(value * 100) AS BIGINT) - 2000 AS cp, 'm' || (event_id % 5) AS m0, 'm' || ((event_id + 1) % 5) AS m1,
  'm' || ((event_id + 2) % 5) AS m2, 'm' || ((event_id + 3) % 5) AS m3, 'm' || ((event_id + 4) % 5) AS m4,
  CASE WHEN event_type <> 'error' THEN CAST(floor(value * 4) AS INTEGER) END AS loss FROM events),
x AS (SELECT *, {_W.format(c='cp')} AS w, CASE WHEN event_type <> 'view' THEN m0 ELSE m4 END AS san FROM n)"""


@query(
    "assistant_texts",
    "D06 P17",
    f"""WITH {_NESTED} SELECT event_id, concat_ws(chr(10),
      CASE WHEN user_id % 5 = 0 THEN 'Threats [verified]: ' || CASE WHEN value > 10 THEN 'Nd4' ELSE 'none' END
           WHEN user_id % 3 = 0 THEN 'Threats: Qxd2, Ra1' END,
      'Assessment: ' || CASE WHEN value > 8 THEN 'calm' ELSE 'plain' END,
      CASE WHEN user_id % 7 <> 0 THEN 'Candidates:' || chr(10) || '- ' || m0 || ': solid [verified: material level]' || chr(10) ||
        '- ' || m1 || ': sharp' || CASE WHEN value < 12 THEN ' [verified: rejected' || CASE WHEN value > 3 THEN ' after Nf6' ELSE '' END || ', ' || w || ']' ELSE ' [verified: ' || w || ']' END || chr(10) ||
        '- ' || m2 || ': odd' || CASE WHEN user_id % 2 = 0 THEN ' [verified: rejected, Qh4 loses 2.5 pawns]' ELSE ' [verified: ' || w || ']' END END,
      '- ' || m3 || ': tactic found by search [verified: wins 9.0 pawns]',
      CASE WHEN value > 20 THEN 'Decision: mate in 3 plies.' END,
      'Best move: ' || san) AS target FROM x""",
)
def assistant_texts(t: Tables):
    c = F.col
    return nested(t).select(
        "event_id",
        tr.assistant_text(c("agents"), c("engine"), c("board_read"), c("decision.san")).alias("target"),
    )


@query(
    "sft_rows",
    "D07 D05",
    f"""WITH {_NESTED} SELECT event_type, count(*) AS n, count(*) FILTER (coalesce(loss, 0) < 100) AS sound FROM x GROUP BY 1""",
)
def sft_rows(t: Tables):
    rows = tr.sft(nested(t)).select("id", "quality.cp_loss").withColumn(
        "event_id", F.split_part("id", F.lit(":"), F.lit(2)).cast("bigint")
    )
    return (
        rows.join(t.events.select("event_id", "event_type"), "event_id")
        .groupBy("event_type")
        .agg(F.count(F.lit(1)).alias("n"), F.count_if(F.coalesce("cp_loss", F.lit(0)) < 100).alias("sound"))
    )


@query(
    "preference_pairs",
    "D08",
    f"""WITH {_NESTED},
    s AS (SELECT * FROM x WHERE user_id % 7 <> 0 AND event_type <> 'view' AND (loss IS NULL OR loss < 100))
    SELECT user_id || ':' || event_id || ':' || m1 AS id, m0 || ':  solid ' || chr(10) || 'Best move: ' || m0 AS chosen,
      m1 || ': sharp' || chr(10) || 'Best move: ' || m1 AS rejected, CASE WHEN value > 3 THEN 'Nf6' END AS reply, CAST(cp AS INTEGER) AS material
      FROM s WHERE value < 12
    UNION ALL SELECT user_id || ':' || event_id || ':' || m2, m0 || ':  solid ' || chr(10) || 'Best move: ' || m0,
      m2 || ': odd' || chr(10) || 'Best move: ' || m2, 'Qh4', -250 FROM s WHERE user_id % 2 = 0""",
)
def preference_pairs(t: Tables):
    return tr.preferences(nested(t)).select(
        "id", "chosen", "rejected", F.col("refutation.reply").alias("reply"),
        F.col("refutation.material").alias("material"),
    )


@query(
    "user_texts",
    "D05 W04",
    """WITH w AS (SELECT conv_id, turn, regexp_split_to_array(trim(text), '[ \\n\\t]+') AS a FROM conversations),
    x AS (SELECT conv_id, turn, a, greatest(len(a) - 12, 0) AS s FROM w)
    SELECT conv_id, turn, md5('FEN: 8/8 ' || CASE WHEN turn % 2 = 0 THEN 'w' ELSE 'b' END || ' - -' || chr(10) || 'Side to move: '
      || CASE WHEN turn % 2 = 0 THEN 'White' ELSE 'Black' END || chr(10) || 'Recent moves: ' ||
      CASE WHEN len(a) > 12 THEN '... ' ELSE '' END || array_to_string(list_transform(range(s, len(a)),
      lambda i: CASE WHEN i % 2 = 0 THEN (i // 2 + 1) || '. ' || a[i + 1] WHEN i = s THEN (i // 2 + 1) || '...' || a[i + 1] ELSE a[i + 1] END), ' ')
      || chr(10) || 'Analyse the position and choose the best move.') AS digest FROM x""",
)
def user_texts(t: Tables):
    fen = F.concat(F.lit("8/8 "), F.when(F.col("turn") % 2 == 0, F.lit("w")).otherwise(F.lit("b")), F.lit(" - -"))
    words = F.split(F.trim("text"), r"[ \n\t]+")
    return t.conversations.select(
        "conv_id", "turn", F.md5(tr.user_text(fen, words).cast("binary")).alias("digest")
    )


_ROLES = (
    "CASE role WHEN 'user' THEN 'proposer' WHEN 'assistant' THEN CASE WHEN turn % 3 = 1 THEN 'positional' ELSE 'threat' END ELSE 'compare' END"
)


def spoken(t: Tables):
    role = (
        F.when(F.col("role") == "user", F.lit("proposer"))
        .when(F.col("role") == "assistant", F.when(F.col("turn") % 3 == 1, F.lit("positional")).otherwise(F.lit("threat")))
        .otherwise(F.lit("compare"))
    )
    reply = F.concat(F.lit('Sure: {"thinking": "t'), F.col("turn").cast("string"), F.lit('"} ok'))
    return t.conversations.select(
        F.lit("r").alias("run_id"), F.col("conv_id").cast("int").alias("game"), F.lit(1).alias("ply"),
        F.col("turn").cast("int").alias("call"), role.alias("role"), F.lit("m").alias("model"),
        F.lit("fen").alias("fen"), F.lit("p").alias("prompt"), reply.alias("response"),
        (F.length("text") / 1000).alias("cost_usd"), F.lit(1.0).alias("seconds"),
        F.length("text").alias("input_tokens"), F.col("turn").cast("int").alias("output_tokens"),
        F.col("turn").alias("_seq"),
    )


@query(
    "agent_pivot",
    "D03 W06",
    f"""WITH s AS (SELECT conv_id, turn, {_ROLES} AS r FROM conversations)
    SELECT conv_id AS game, 't' || min(turn) FILTER (r = 'proposer') AS thinking,
      greatest(count(*) FILTER (r = 'proposer') - 1, 0) AS opponent, count(*) FILTER (r = 'positional') AS positional,
      't' || max(turn) FILTER (r = 'threat') AS threat, 't' || max(turn) FILTER (r = 'compare') AS compare
    FROM s GROUP BY 1""",
)
def agent_pivot(t: Tables):
    from rookery.functions.text import extract_json

    calls = spoken(t).withColumn("parsed", extract_json(F.col("response")))
    d = calls.select("run_id", "game", "ply").distinct()
    cand = "array<struct<san:string,reason:string,prior:double,score_cp:double,line:array<string>>>"
    both = tr.attach_traces(d, calls.select("run_id", "game", "ply", "_seq", "call", "role", "fen", "parsed"))
    a = both.select("game", tr.agents(F.col("traces"), F.lit(None).cast(cand)).alias("a"))
    other = lambda r: F.get_json_object(F.try_element_at("a.others", F.lit(r)), "$.thinking").alias(r)
    return a.select(
        F.col("game").cast("bigint").alias("game"), F.col("a.proposer.thinking").alias("thinking"),
        F.size("a.opponent_proposer").cast("bigint").alias("opponent"),
        F.size("a.positional").cast("bigint").alias("positional"), other("threat"), other("compare"),
    )


def _positions(t: Tables):
    """Full position rows out of conversations: one decision per conversation."""
    calls = spoken(t)
    cand = "array<struct<san:string,reason:string,prior:double,score_cp:double,line:array<string>>>"
    from rookery import schemas

    search, read = schemas._SEARCH, schemas._BOARD_READ
    d = calls.groupBy("run_id", "game", "ply").agg(F.max("call").alias("calls")).select(
        "run_id", "game", "ply", F.lit("fen w").alias("fen"),
        F.when(F.col("game") % 10 == 3, F.lit("maia-1100")).otherwise(F.lit("hybrid-ctx")).alias("player"),
        F.when(F.col("game") % 2 == 0, F.lit("white")).otherwise(F.lit("black")).alias("color"),
        F.when(F.col("game") % 9 != 4, F.lit("e4")).alias("san"), F.lit("e2e4").alias("uci"), F.lit(None).cast(cand).alias("candidates"),
        F.lit(None).cast("array<string>").alias("illegal_attempts"), "calls", F.lit(0.1).alias("cost"), F.lit("").alias("note"),
        F.lit(False).alias("forced_random"), F.lit(None).cast(read).alias("board_read"), F.lit(None).cast(search).alias("search"),
        F.lit(0).alias("_seq"),
    )
    evals = t.labels.select(
        F.lit("r").alias("run_id"), F.col("doc_id").cast("int").alias("game"), F.lit(1).alias("ply"),
        F.lit(0).alias("eval_before"), F.lit(0).alias("eval_after"), F.lit("d4").alias("best_move"),
        (F.col("quality") * 150).alias("cpl"), F.lit(0).alias("_seq"),
    )
    games = t.documents.select(
        F.lit("r").alias("run_id"), F.col("doc_id").cast("int").alias("game"),
        F.when(F.col("n_chars") % 3 == 0, F.lit("1-0")).when(F.col("n_chars") % 3 == 1, F.lit("0-1")).otherwise(F.lit("*")).alias("result"),
        F.lit("French").alias("opening"), F.lit(4).alias("book_plies"), F.lit(0).alias("_seq"),
    )
    meta = t.spark.createDataFrame(
        [("r", "haiku")], "run_id string, model string"
    ).select("*", *[F.lit(None).cast(ty).alias(n) for n, ty in (
        ("depth", "int"), ("tac_depth", "int"), ("tac_margin", "int"), ("search", "string"),
        ("threat_agent", "boolean"), ("thinking", "int"), ("board_read", "boolean"))])
    return tr.build_positions(d, evals, games, calls, meta), calls


_POS = """
pos AS (SELECT DISTINCT conv_id AS game FROM conversations WHERE conv_id % 10 <> 3 AND conv_id % 9 <> 4),
lab AS (SELECT p.game, quality * 150 AS cp_loss,
   CASE n_chars % 3 WHEN 0 THEN CASE WHEN p.game % 2 = 0 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END WHEN 1 THEN CASE WHEN p.game % 2 = 0 THEN 0.0::DOUBLE ELSE 1.0::DOUBLE END END AS game_result
   FROM pos p LEFT JOIN labels l ON l.doc_id = p.game LEFT JOIN documents d ON d.doc_id = p.game)"""


@query(
    "position_rows",
    "D01 J01 J02 J03",
    f"""WITH {_POS} SELECT 'r:' || game || ':1' AS id, CAST(cp_loss AS INTEGER) AS cp_loss, game_result,
      (SELECT min(turn) FROM conversations c WHERE c.conv_id = lab.game AND role = 'user') IS NOT NULL AS proposed FROM lab""",
)
def position_rows(t: Tables):
    p, _ = _positions(t)
    return p.select(
        "id", F.col("labels.cp_loss").alias("cp_loss"), F.col("labels.game_result").alias("game_result"),
        F.col("agents.proposer").isNotNull().alias("proposed"),
    )


@query(
    "move_histories",
    "D01",
    """SELECT a.conv_id AS game, a.turn + 1 AS ply, coalesce((SELECT string_agg(md5(b.text), ' ' ORDER BY b.turn)
      FROM conversations b WHERE b.conv_id = a.conv_id AND b.turn < a.turn), '') AS history FROM conversations a""",
)
def move_histories(t: Tables):
    """Turns as plies; each was logged twice, the second time right."""
    twice = F.array(
        F.struct(F.lit(1).alias("_seq"), F.lit("lost").alias("uci")), F.struct(F.lit(2).alias("_seq"), F.md5("text").alias("uci"))
    )
    plies = t.conversations.select(
        F.lit("r").alias("run_id"), F.col("conv_id").alias("game"), (F.col("turn") + 1).alias("ply"), F.explode(twice).alias("m")
    ).select("run_id", "game", "ply", "m.*")
    games = plies.select("run_id", "game", F.lit("Ruy Lopez").alias("opening"), F.lit(0).alias("book_plies")).distinct()
    return tr.histories(plies, games).select("game", "ply", F.array_join("history_uci", " ").alias("history"))


@query(
    "call_rows",
    "D02",
    f"""WITH {_POS} SELECT 'r:' || conv_id || ':1' AS position_id, CAST(turn AS INTEGER) AS call, {_ROLES} AS role FROM conversations
      WHERE conv_id IN (SELECT game FROM pos)""",
)
def call_rows(t: Tables):
    p, calls = _positions(t)
    return tr.build_calls(p, calls).select("position_id", "call", "role")


@query(
    "dataset_stats",
    "A11 D04",
    f"""WITH {_POS}, s AS (SELECT game, list_reduce(list_transform(range(1, 41), lambda i: instr('0123456789abcdef', substr(sha1('r:' || game), CAST(i AS INTEGER), 1)) - 1),
        lambda a, c: (a * 16 + c) % 10, CAST(0 AS BIGINT)) AS b FROM pos),
      c AS (SELECT * FROM conversations WHERE conv_id IN (SELECT game FROM pos))
    SELECT (SELECT count(*) FROM pos) AS positions, CAST(1 AS BIGINT) AS runs, (SELECT count(*) FROM s WHERE b > 1) AS train,
      (SELECT count(*) FROM s WHERE b = 1) AS val, (SELECT count(*) FROM s WHERE b = 0) AS test,
      (SELECT count(*) FROM c) AS calls, (SELECT count(DISTINCT conv_id) FROM c) AS positions_with_full_traces,
      (SELECT count(DISTINCT conv_id) FROM c WHERE role = 'user' AND turn = (SELECT min(turn) FROM c x WHERE x.conv_id = c.conv_id AND x.role = 'user')) AS sft,
      (SELECT count(*) FROM lab WHERE coalesce(cp_loss, 0) < 100 AND game IN (SELECT conv_id FROM c WHERE role = 'user')) AS sft_cp_loss_lt_100,
      CAST(0 AS BIGINT) AS preference_pairs""",
)
def dataset_stats(t: Tables):
    p, calls = _positions(t)
    return tr.dataset_stats(p, tr.build_calls(p, calls), tr.sft(p), tr.preferences(p))


@query(
    "call_meter",
    "A12",
    f"""SELECT {_ROLES} AS role, count(*) AS calls, {py_round('sum(length(text) / 1000.0::DOUBLE)', 4)} AS cost_usd,
      CAST(sum(length(text)) AS BIGINT) AS input_tokens, CAST(sum(turn) AS BIGINT) AS output_tokens FROM conversations GROUP BY 1""",
)
def call_meter(t: Tables):
    return tr.call_meter(spoken(t), ["role"]).withColumn("cost_usd", half_even(F.col("cost_usd"), 4))


@query(
    "timeline",
    "J15",
    f"""WITH s AS (SELECT conv_id, turn, {_ROLES} AS r FROM conversations)
    SELECT g.doc_id AS game, quality AS e_quality, 't' || min(turn) FILTER (r = 'proposer') AS proposer, 't' || min(turn) FILTER (r = 'threat') AS threat
    FROM documents g LEFT JOIN s ON s.conv_id = g.doc_id LEFT JOIN labels l ON l.doc_id = g.doc_id GROUP BY g.doc_id, quality""",
)
def timeline(t: Tables):
    plies = t.documents.select(F.lit("r").alias("run_id"), F.col("doc_id").cast("int").alias("game"), F.lit(1).alias("ply"))
    d = plies.select("*", F.lit("p").alias("player"))
    evals = t.labels.select(F.lit("r").alias("run_id"), F.col("doc_id").cast("int").alias("game"), F.lit(1).alias("ply"), "quality")
    talk = spoken(t).withColumn("response", F.concat(F.lit("t"), F.col("call").cast("string")))
    out = tr.timeline(plies, d, talk, evals)
    return out.select(F.col("game").cast("bigint").alias("game"), "e_quality", "proposer", "threat")
