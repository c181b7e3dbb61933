"""Board features on positions derived from events.

random boards   the 64 hex digits of sha256(event_id) as 64 squares
pawn boards     the first eight hex digits pick a pair of pawns per file; kings at hashed squares
"""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog.base import Tables, query
from rookery.functions import bits as B
from rookery.operators import boards as bo
from rookery.operators import context as cx
from rookery.operators import features as fe
from rookery.operators import relations as rl

_HEX = "0123456789abcdef"
_MAP = "PNBRQKpnbrqk...."
# ranks (from 0) of the White and Black pawn of a file, one pair per hex digit; 9 = no pawn
_PAIRS = [(1, 6), (3, 4), (3, 5), (4, 5), (3, 9), (9, 5), (2, 6), (3, 6), (4, 6), (9, 9), (2, 5), (9, 4), (5, 9), (3, 4), (1, 9), (9, 6)]
_ROWS = ["".join("P" if w == r else "p" if b == r else "." for w, b in _PAIRS) for r in range(8)]


def _spread(df):
    """Narrow rows dealt anew: a board costs far more time than its bytes, by which files are split into tasks."""
    spark = df.sparkSession
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 2 * spark.sparkContext.defaultParallelism)
    return df.repartition(n, *df.columns)


def _meta(t: Tables):
    events = _spread(t.events.select("event_id", "user_id", "event_type"))
    return events.withColumn("h", F.sha2(F.col("event_id").cast("string"), 256)).withColumns(
        {
            "turn": F.when(F.col("user_id") % 2 == 0, F.lit("w")).otherwise(F.lit("b")),
            "castling": F.lit("-"),
            "fullmove": (F.pmod("user_id", F.lit(30)) + 1).cast("int"),
        }
    )


def random_boards(t: Tables):
    return _meta(t).withColumn("board", F.translate("h", _HEX, _MAP)).drop("h")


def thinned_boards(t: Tables):
    """Random boards from which some piece kinds are removed, so that every ending occurs."""
    gone = ["NBRQnbrq", "NBQnbq", "NBRnbr", "NRQnrq", "BRQbrq", "RQrq", "Qq", "NQnq"]
    b = F.translate("h", _HEX, _MAP)
    out = b
    for k, letters in enumerate(gone):
        out = F.when(F.col("event_id") % 8 == k, F.translate(b, letters, "." * len(letters))).otherwise(out)
    return _meta(t).withColumn("board", out).drop("h")


def pawn_boards(t: Tables):
    rows = F.concat(*[F.translate(F.substring("h", 1, 8), _HEX, r) for r in _ROWS])
    spot = lambda at: F.conv(F.substring("h", at, 4), 16, 10).cast("int") % 64
    df = _meta(t).withColumns({"wk0": spot(20), "bk0": spot(30)})
    b = F.overlay(F.overlay(rows, F.lit("K"), F.col("wk0") + 1, 1), F.lit("k"), F.col("bk0") + 1, 1)
    return df.withColumn("board", b).drop("h", "wk0", "bk0")


_M = "user_id, event_type, CASE WHEN user_id % 2 = 0 THEN 'w' ELSE 'b' END AS turn, CAST(user_id % 30 + 1 AS INTEGER) AS fullmove"
RANDOM = f"b AS (SELECT event_id, {_M}, translate(sha256(CAST(event_id AS VARCHAR)), '{_HEX}', '{_MAP}') AS board FROM events)"
_G = ["NBRQnbrq", "NBQnbq", "NBRnbr", "NRQnrq", "BRQbrq", "RQrq", "Qq", "NQnq"]
THIN = (
    f"b0 AS (SELECT event_id, {_M}, translate(sha256(CAST(event_id AS VARCHAR)), '{_HEX}', '{_MAP}') AS board FROM events), "
    "b AS (SELECT event_id, user_id, event_type, turn, fullmove, CASE event_id % 8 "
    + " ".join(f"WHEN {k} THEN translate(board, '{g}', '{'.' * len(g)}')" for k, g in enumerate(_G))
    + " END AS board FROM b0)"
)
_over = lambda s, ch, at: f"substr({s}, 1, {at}) || '{ch}' || substr({s}, {at} + 2)"
PAWNS = (
    f"b0 AS (SELECT event_id, {_M}, sha256(CAST(event_id AS VARCHAR)) AS h FROM events), "
    "b1 AS (SELECT *, " + " || ".join(f"translate(substr(h, 1, 8), '{_HEX}', '{r}')" for r in _ROWS) + " AS rows, "
    "CAST(('0x' || substr(h, 20, 4)) AS INTEGER) % 64 AS wk0, CAST(('0x' || substr(h, 30, 4)) AS INTEGER) % 64 AS bk0 FROM b0), "
    f"b2 AS (SELECT *, {_over('rows', 'K', 'wk0')} AS w1 FROM b1), "
    f"b AS (SELECT event_id, user_id, event_type, turn, fullmove, {_over('w1', 'k', 'bk0')} AS board FROM b2)"
)
PIECES = """
pc AS (SELECT event_id, CAST(s AS INTEGER) AS sq, CAST(s % 8 AS INTEGER) AS f, CAST(s // 8 AS INTEGER) AS r, substr(board, CAST(s AS INTEGER) + 1, 1) AS p,
         substr(board, CAST(s AS INTEGER) + 1, 1) = upper(substr(board, CAST(s AS INTEGER) + 1, 1)) AS white
       FROM b, range(64) t(s) WHERE substr(board, CAST(s AS INTEGER) + 1, 1) <> '.'),
pw AS (SELECT *, CASE WHEN white THEN r ELSE 7 - r END AS rr FROM pc WHERE p IN ('P', 'p'))"""
NAME = "(substr('abcdefgh', {0} % 8 + 1, 1) || ({0} // 8 + 1))"
EDGES = f"""
dirs AS (SELECT * FROM (VALUES (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)) v(df, dr)),
jump AS (SELECT * FROM (VALUES (1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)) v(df, dr)),
line AS (SELECT event_id, sq AS frm, p, white, df, dr, k, f + df * k AS tf, r + dr * k AS tr FROM pc, dirs, (SELECT CAST(range AS INTEGER) AS k FROM range(1, 8)) n
   WHERE (upper(p) IN ('Q') OR (upper(p) = 'R' AND df * dr = 0) OR (upper(p) = 'B' AND df * dr <> 0) OR (upper(p) = 'K' AND k = 1))
     AND f + df * k BETWEEN 0 AND 7 AND r + dr * k BETWEEN 0 AND 7),
lb AS (SELECT l.*, t.p AS target, min(CASE WHEN t.p IS NOT NULL THEN k END) OVER (PARTITION BY l.event_id, frm, df, dr) AS stop
   FROM line l LEFT JOIN pc t ON t.event_id = l.event_id AND t.sq = tr * 8 + tf),
ed AS (SELECT event_id, frm, p, white, tr * 8 + tf AS dest, target FROM lb WHERE stop IS NULL OR k <= stop
   UNION ALL SELECT a.event_id, a.sq, a.p, a.white, (a.r + dr) * 8 + a.f + df, t.p FROM pc a JOIN jump ON a.p IN ('N', 'n') AND a.f + df BETWEEN 0 AND 7 AND a.r + dr BETWEEN 0 AND 7
      LEFT JOIN pc t ON t.event_id = a.event_id AND t.sq = (a.r + dr) * 8 + a.f + df
   UNION ALL SELECT a.event_id, a.sq, a.p, a.white, (a.r + CASE WHEN a.white THEN 1 ELSE -1 END) * 8 + a.f + df, t.p FROM pw a JOIN (VALUES (-1), (1)) v(df)
      ON a.f + df BETWEEN 0 AND 7 AND a.r + CASE WHEN a.white THEN 1 ELSE -1 END BETWEEN 0 AND 7
      LEFT JOIN pc t ON t.event_id = a.event_id AND t.sq = (a.r + CASE WHEN a.white THEN 1 ELSE -1 END) * 8 + a.f + df)"""


def _n(col):
    return B.names_text(F.col(col), ",").alias(col)


@query(
    "board_pieces",
    "B01",
    f"""WITH {RANDOM}, {PIECES} SELECT p AS piece, CASE WHEN white THEN 'white' ELSE 'black' END AS color, count(*) AS n, CAST(sum(sq) AS BIGINT) AS squares,
      CAST(sum(f) AS BIGINT) AS files, CAST(sum(r) AS BIGINT) AS ranks FROM pc GROUP BY 1, 2""",
)
def board_pieces(t: Tables):
    return bo.pieces(random_boards(t), ["event_id"]).groupBy("piece", "color").agg(
        F.count(F.lit(1)).alias("n"), F.sum("sq").alias("squares"), F.sum("file").alias("files"),
        F.sum("rank").alias("ranks"),
    )


_PLACE = " || '/' || ".join(f"substr(board, {8 * r + 1}, 8)" for r in range(7, -1, -1))
for _k in range(8, 0, -1):
    _PLACE = f"replace({_PLACE}, '{'.' * _k}', '{_k}')"


@query(
    "fen_round_trip",
    "B01 B02",
    f"""WITH {RANDOM} SELECT event_id, board, {_PLACE} || ' ' || turn || ' - -' AS epd, fullmove FROM b""",
)
def fen_round_trip(t: Tables):
    fen = F.concat_ws(" ", bo.placement(F.col("board")), "turn", "castling", F.lit("-"), F.lit("0"), "fullmove")
    rows = random_boards(t).select("event_id", fen.alias("fen"))
    return bo.parse_fen(rows).select("event_id", "board", bo.epd(F.col("fen")).alias("epd"), "fullmove")


# final positions of the eight book lines


def _cnt(piece: str) -> str:
    return f"(length(board) - length(replace(board, '{piece}', '')))"


_SIDE = lambda name, ls: (
    f"'{name}: ' || coalesce(nullif(rtrim(" + " || ".join(f"repeat('{k.upper()} ', {_cnt(k)})" for k in ls) + f"), ''), '-') || ' P×' || {_cnt('P' if name == 'White' else 'p')}"
)


@query(
    "material",
    "B04",
    f"""WITH {THIN}, x AS (SELECT *, {_cnt('N')} * 3 + {_cnt('B')} * 3 + {_cnt('R')} * 5 + {_cnt('Q')} * 9 + {_cnt('P')} AS pw,
        {_cnt('n')} * 3 + {_cnt('b')} * 3 + {_cnt('r')} * 5 + {_cnt('q')} * 9 + {_cnt('p')} AS pb,
        {_cnt('B')} AS wb, {_cnt('b')} AS bb, {_cnt('N')} + {_cnt('B')} AS wm, {_cnt('n')} + {_cnt('b')} AS bm, {_cnt('R')} AS wr, {_cnt('r')} AS br,
        {_cnt('Q')} AS wq, {_cnt('q')} AS bq, strpos(board, 'B') - 1 AS ws, strpos(board, 'b') - 1 AS bs FROM b),
      y AS (SELECT *, pw - pb AS d, wr - br = 1 AND bm - wm = 1 AS ew, br - wr = 1 AND wm - bm = 1 AS eb, wr = br AND wq = bq AS even,
        wb = 1 AND bb = 1 AND (ws % 8 + ws // 8) % 2 <> (bs % 8 + bs // 8) % 2 AS opp FROM x)
    SELECT event_id, concat_ws(' | ', {_SIDE('White', 'qrbn').replace("'{k", "'{k").replace("qrbn", "QRBN")} || ' (' || pw || ')', {_SIDE('Black', 'qrbn')} || ' (' || pb || ')',
      'balance: ' || CASE WHEN d = 0 THEN 'equal' WHEN d > 0 THEN 'White +' || d ELSE 'Black +' || (-d) END,
      nullif(concat_ws('; ', CASE WHEN wb >= 2 AND bb < 2 THEN 'White has the bishop pair' END, CASE WHEN bb >= 2 AND wb < 2 THEN 'Black has the bishop pair' END,
        CASE WHEN ew THEN 'White is up the exchange' WHEN eb THEN 'Black is up the exchange'
          WHEN wm - bm >= 1 AND even AND d <= 0 THEN 'White has ' || (wm - bm) || ' extra minor piece(s) vs pawns'
          WHEN bm - wm >= 1 AND even AND d >= 0 THEN 'Black has ' || (bm - wm) || ' extra minor piece(s) vs pawns' END,
        CASE WHEN abs(wq - bq) = 1 AND wr + wm <> br + bm THEN 'queen vs pieces imbalance' END,
        CASE WHEN opp THEN 'opposite-coloured bishops (drawish in endgames, attacking in middlegames)' END), '')) AS material FROM y""".replace(
        _SIDE("White", "qrbn"), _SIDE("White", "QRBN")
    ),
)
def material(t: Tables):
    return fe.material(bo.with_sets(thinned_boards(t))).select("event_id", "material")


_HOME = lambda sqs, set_: " + ".join(f"CAST(substr(board, {s + 1}, 1) IN {set_} AS INT)" for s in sqs)
_NPM = f"({_cnt('N')} + {_cnt('n')} + {_cnt('B')} + {_cnt('b')}) * 3 + ({_cnt('R')} + {_cnt('r')}) * 5 + ({_cnt('Q')} + {_cnt('q')}) * 9"
_PHASE = f"""CASE WHEN {_NPM} <= 18 OR ({_cnt('Q')} + {_cnt('q')} = 0 AND {_NPM} <= 26) THEN 'endgame'
  WHEN fullmove <= 8 OR (fullmove <= 15 AND {_HOME((1, 2, 5, 6), "('N', 'B')")} + {_HOME((57, 58, 61, 62), "('n', 'b')")} >= 3) THEN 'opening' ELSE 'middlegame' END"""


@query("phase", "B05", f"WITH {THIN} SELECT event_id, {_PHASE} AS phase FROM b")
def phase(t: Tables):
    return fe.phase(fe.material(bo.with_sets(thinned_boards(t)))).select("event_id", "phase")


_PS = f"""WITH {{boards}}, {PIECES},
  k AS (SELECT a.event_id, a.sq, a.f, a.r, a.white, a.rr,
     count(n.sq) AS near, coalesce(bool_or((CASE WHEN a.white THEN n.r ELSE 7 - n.r END) <= a.rr), false) AS held
   FROM pw a LEFT JOIN pw n ON n.event_id = a.event_id AND n.white = a.white AND abs(n.f - a.f) = 1 GROUP BY ALL),
  s AS (SELECT k.*, EXISTS (SELECT 1 FROM pw e WHERE e.event_id = k.event_id AND e.white <> k.white AND abs(e.f - k.f) = 1
           AND e.r = k.r + CASE WHEN k.white THEN 2 ELSE -2 END) AS stopped,
      NOT EXISTS (SELECT 1 FROM pw e WHERE e.event_id = k.event_id AND e.white <> k.white AND abs(e.f - k.f) <= 1
           AND (CASE WHEN k.white THEN e.r > k.r ELSE e.r < k.r END)) AS passed,
      EXISTS (SELECT 1 FROM pw o WHERE o.event_id = k.event_id AND o.white = k.white AND abs(o.f - k.f) = 1 AND o.rr = k.rr - 1) AS protected FROM k)"""


def _lists(df, names, extra=()):
    return df.select("event_id", *[_n(c) for c in names], *extra)


@query(
    "pawn_structure",
    "B06",
    _PS.format(boards=PAWNS) + f""",
  d AS (SELECT event_id, white, f FROM pw GROUP BY ALL HAVING count(*) > 1)
  SELECT b.event_id, """ + ", ".join(
        f"coalesce((SELECT string_agg({NAME.format('sq')}, ',' ORDER BY sq) FROM s WHERE s.event_id = b.event_id AND white = {w} AND {cond}), '') AS {n}_{x}"
        for w, x in (("true", "w"), ("false", "b"))
        for n, cond in (("isolated", "near = 0"), ("backward", "near > 0 AND NOT held AND stopped"), ("passed", "passed"), ("protected", "passed AND protected"))
    ) + """,
    (SELECT count(*) FROM (SELECT DISTINCT f FROM pw WHERE pw.event_id = b.event_id AND white) q WHERE NOT EXISTS (SELECT 1 FROM pw z WHERE z.event_id = b.event_id AND z.white AND z.f = q.f - 1)) AS islands_w
  FROM b""",
)
def pawn_structure(t: Tables):
    df = fe.pawn_sets(bo.with_sets(pawn_boards(t)))
    names = [f"{n}_{x}" for x in "wb" for n in ("isolated", "backward", "passed", "protected")]
    return _lists(df, names, [F.col("islands_w").cast("bigint").alias("islands_w")])


@query(
    "pawn_structure_random",
    "B06",
    _PS.format(boards=RANDOM) + """
  SELECT event_id, CAST(count(*) FILTER (near = 0) AS BIGINT) AS isolated, CAST(count(*) FILTER (near > 0 AND NOT held AND stopped) AS BIGINT) AS backward,
    CAST(coalesce(sum(sq) FILTER (passed), 0) AS BIGINT) AS passed FROM b LEFT JOIN s USING (event_id) GROUP BY 1""",
)
def pawn_structure_random(t: Tables):
    df = fe.pawn_sets(bo.with_sets(random_boards(t)))
    n = lambda x: (B.count(F.col(f"{x}_w")) + B.count(F.col(f"{x}_b"))).cast("bigint").alias(x)
    total = F.aggregate(F.concat(B.squares(F.col("passed_w")), B.squares(F.col("passed_b"))), F.lit(0).cast("bigint"), lambda a, i: a + i)
    return df.select("event_id", n("isolated"), n("backward"), total.alias("passed"))


_FL = lambda cond: "array_to_string(list_filter(list_transform(range(8), lambda f: CASE WHEN " + cond + " THEN substr('abcdefgh', CAST(f AS INTEGER) + 1, 1) END), lambda x: x IS NOT NULL), ',')"


@query(
    "files_and_wings",
    "B07",
    f"""WITH {RANDOM}, {PIECES}, g AS (SELECT event_id, coalesce(list(DISTINCT f) FILTER (white), []) AS wf, coalesce(list(DISTINCT f) FILTER (NOT white), []) AS bf,
       count(*) FILTER (white AND f < 3) - count(*) FILTER (NOT white AND f < 3) AS q, count(*) FILTER (white AND f > 4) - count(*) FILTER (NOT white AND f > 4) AS k FROM b LEFT JOIN pw USING (event_id) GROUP BY 1)
    SELECT event_id, {_FL('NOT list_contains(wf, f) AND NOT list_contains(bf, f)')} AS open_files, {_FL('NOT list_contains(wf, f) AND list_contains(bf, f)')} AS half_open_w,
      {_FL('list_contains(wf, f) AND NOT list_contains(bf, f)')} AS half_open_b, q AS majority_queenside, k AS majority_kingside FROM g""",
)
def files_and_wings(t: Tables):
    df = fe.files_and_wings(fe.pawn_sets(bo.with_sets(random_boards(t))))
    return df.select(
        "event_id", *[B.file_letters(F.col(x), ",").alias(x) for x in ("open_files", "half_open_w", "half_open_b")],
        *[F.col(f"majority_{x}").cast("bigint").alias(f"majority_{x}") for x in ("queenside", "kingside")],
    )


def _has(piece, name):
    return f"substr(board, {B.sq(name) + 1}, 1) = '{piece}'"


def _file(f, piece):
    i = B.FILES.index(f)
    text = " || ".join(f"substr(board, {8 * r + i + 1}, 1)" for r in range(8))
    return f"contains({text}, '{piece}')"


def _dcount(piece):
    text = " || ".join(f"substr(board, {8 * r + 4}, 1)" for r in range(8))
    return f"length(replace({text}, '.', '')) - length(replace(replace({text}, '.', ''), '{piece}', ''))"


_BIND = f"({_has('P', 'c4')} AND {_has('P', 'e4')} AND NOT {_file('d', 'P')} AND NOT {_file('c', 'p')} AND {_file('d', 'p')})"
_HEDGE = f"({_has('p', 'b6')} AND {_has('p', 'e6')} AND {_has('p', 'd6')})"
_SMALL = f"(NOT {_BIND} AND {_has('P', 'e4')} AND NOT {_file('d', 'P')} AND NOT {_file('c', 'p')} AND {_has('p', 'd6')})"
_STRUCT = [
    ("IQP (White d-pawn on d4)", f"{_dcount('P')} = 1 AND {_has('P', 'd4')} AND NOT {_file('c', 'P')} AND NOT {_file('e', 'P')} AND NOT {_file('d', 'p')}"),
    ("IQP (White d-pawn on d5)", f"{_dcount('P')} = 1 AND {_has('P', 'd5')} AND NOT {_file('c', 'P')} AND NOT {_file('e', 'P')} AND NOT {_file('d', 'p')}"),
    ("IQP (Black d-pawn on d4)", f"{_dcount('p')} = 1 AND {_has('p', 'd4')} AND NOT {_file('c', 'p')} AND NOT {_file('e', 'p')} AND NOT {_file('d', 'P')}"),
    ("IQP (Black d-pawn on d5)", f"{_dcount('p')} = 1 AND {_has('p', 'd5')} AND NOT {_file('c', 'p')} AND NOT {_file('e', 'p')} AND NOT {_file('d', 'P')}"),
    ("Hanging pawns (White c+d)", f"{_has('P', 'c4')} AND {_has('P', 'd4')} AND NOT {_file('b', 'P')} AND NOT {_file('e', 'P')} AND NOT {_file('c', 'p')} AND NOT {_file('d', 'p')}"),
    ("Hanging pawns (Black c+d)", f"{_has('p', 'c5')} AND {_has('p', 'd5')} AND NOT {_file('b', 'p')} AND NOT {_file('e', 'p')} AND NOT {_file('c', 'P')} AND NOT {_file('d', 'P')}"),
    ("Carlsbad", f"{_has('P', 'd4')} AND {_has('P', 'e3')} AND NOT {_file('c', 'P')} AND {_has('p', 'd5')} AND {_has('p', 'c6')} AND NOT {_file('e', 'p')}"),
    ("Reversed Carlsbad", f"{_has('p', 'd5')} AND {_has('p', 'e6')} AND NOT {_file('c', 'p')} AND {_has('P', 'd4')} AND {_has('P', 'c3')} AND NOT {_file('e', 'P')}"),
    ("Hedgehog", f"{_BIND} AND {_HEDGE}"),
    ("Maroczy bind", f"{_BIND} AND NOT {_HEDGE}"),
    ("Scheveningen small centre", f"{_SMALL} AND {_has('p', 'e6')}"),
    ("Najdorf/Boleslavsky structure", f"{_SMALL} AND NOT {_has('p', 'e6')} AND {_has('p', 'e5')}"),
    ("French advance chain", f"{_has('P', 'd4')} AND {_has('P', 'e5')} AND {_has('p', 'd5')} AND {_has('p', 'e6')}"),
    ("King's Indian locked centre".replace("'", "''"), f"{_has('P', 'd5')} AND {_has('P', 'e4')} AND {_has('p', 'd6')} AND {_has('p', 'e5')}"),
    ("Benoni structure", f"{_has('P', 'd5')} AND {_has('p', 'c5')} AND {_has('p', 'd6')} AND NOT {_file('e', 'p')} AND NOT {_file('c', 'P')}"),
    ("Stonewall (White)", f"{_has('P', 'd4')} AND {_has('P', 'e3')} AND {_has('P', 'f4')}"),
    ("Stonewall (Black)", f"{_has('p', 'd5')} AND {_has('p', 'e6')} AND {_has('p', 'f5')}"),
]


@query(
    "named_structures",
    "B08",
    f"WITH {PAWNS} SELECT event_id, concat_ws(';', " + ", ".join(f"CASE WHEN {cond} THEN '{n}' END" for n, cond in _STRUCT) + ") AS structures FROM b",
)
def named_structures(t: Tables):
    df = fe.named_structures(fe.pawn_sets(bo.with_sets(pawn_boards(t))))
    return df.select("event_id", F.array_join(F.transform("structures", lambda x: x["name"]), ";").alias("structures"))


_KINGS = "kg AS (SELECT event_id, white, max(sq) AS k FROM pc WHERE p IN ('K', 'k') GROUP BY 1, 2)"


@query(
    "king_shields",
    "B09",
    f"""WITH {RANDOM}, {PIECES}, {_KINGS},
    nf AS (SELECT kg.event_id, kg.white, k % 8 + d AS f, CASE WHEN kg.white THEN k // 8 ELSE 7 - k // 8 END AS kr FROM kg, (VALUES (-1), (0), (1)) v(d) WHERE k % 8 + d BETWEEN 0 AND 7),
    h AS (SELECT nf.event_id, nf.white, nf.f, EXISTS (SELECT 1 FROM pw WHERE pw.event_id = nf.event_id AND pw.white = nf.white AND pw.f = nf.f AND pw.rr IN (kr + 1, kr + 2)) AS shield,
       EXISTS (SELECT 1 FROM pw WHERE pw.event_id = nf.event_id AND pw.white = nf.white AND pw.f = nf.f) AS own FROM nf)
    SELECT event_id, {', '.join(f"coalesce(string_agg(substr('abcdefgh', f + 1, 1), ',' ORDER BY f) FILTER (white = {w} AND NOT {c}), '') AS {n}_{x}" for w, x in (('true', 'w'), ('false', 'b')) for c, n in (('shield', 'shield_holes'), ('own', 'open_near')))}
    FROM b LEFT JOIN h USING (event_id) GROUP BY 1""",
)
def king_shields(t: Tables):
    df = bo.with_sets(random_boards(t))
    for op in (fe.material, fe.phase, fe.pawn_sets, rl.attacks, rl.king_zones, rl.king_safety):
        df = op(df)
    return df.select(
        "event_id", *[B.file_letters(F.col(f"{n}_{x}"), ",").alias(f"{n}_{x}") for x in "wb" for n in ("shield_holes", "open_near")]
    )


@query(
    "mobility",
    "B10",
    f"""WITH {RANDOM}, {PIECES}, {EDGES},
    a AS (SELECT event_id, white, count(*) AS n FROM ed WHERE p NOT IN ('P', 'p') AND (target IS NULL OR (target = upper(target)) <> white) GROUP BY 1, 2),
    t AS (SELECT event_id, white, sum(CASE WHEN dest // 8 IN (0, 7) THEN 4 ELSE 1 END) AS n FROM ed WHERE p IN ('P', 'p') AND target IS NOT NULL AND (target = upper(target)) <> white GROUP BY 1, 2),
    ps AS (SELECT pw.*, r + CASE WHEN white THEN 1 ELSE -1 END AS r1, r + CASE WHEN white THEN 2 ELSE -2 END AS r2, board FROM pw JOIN b USING (event_id)),
    u AS (SELECT event_id, white, sum(CASE WHEN r1 NOT BETWEEN 0 AND 7 OR substr(board, r1 * 8 + f + 1, 1) <> '.' THEN 0
        ELSE CASE WHEN r1 IN (0, 7) THEN 4 ELSE 1 END + CASE WHEN rr = 1 AND substr(board, r2 * 8 + f + 1, 1) = '.' THEN 1 ELSE 0 END END) AS n FROM ps GROUP BY 1, 2),
    z AS (SELECT * FROM a UNION ALL SELECT * FROM t UNION ALL SELECT * FROM u)
    SELECT b.event_id, CAST(coalesce(sum(n) FILTER (white), 0) AS INTEGER) AS mobility_w, CAST(coalesce(sum(n) FILTER (NOT white), 0) AS INTEGER) AS mobility_b FROM b LEFT JOIN z USING (event_id) GROUP BY 1""",
)
def mobility(t: Tables):
    df = rl.mobility(rl.attacks(bo.with_sets(random_boards(t))))
    return df.select("event_id", "mobility_w", "mobility_b")


@query(
    "attack_edges",
    "B11 J18",
    f"""WITH {RANDOM}, {PIECES}, {EDGES} SELECT event_id, CASE WHEN white THEN 'white' ELSE 'black' END AS color, count(*) AS n,
      CAST(sum(dest) AS BIGINT) AS dests, CAST(sum(frm * dest) AS BIGINT) AS mixed, count(target) AS contacts FROM ed GROUP BY 1, 2""",
)
def attack_edges(t: Tables):
    e = bo.attack_edges(bo.with_sets(random_boards(t)), ["event_id"])
    return e.groupBy("event_id", "color").agg(
        F.count(F.lit(1)).alias("n"), F.sum("to").alias("dests"), F.sum(F.col("frm") * F.col("to")).alias("mixed"),
        F.count_if(F.col("target") != ".").alias("contacts"),
    )


@query(
    "contacts",
    "B12",
    f"""WITH {RANDOM}, {PIECES}, {EDGES},
    g AS (SELECT event_id, dest, count(*) FILTER (white <> (target = upper(target))) AS att, count(*) FILTER (white = (target = upper(target))) AS dfn,
            min(frm) FILTER (white = (target = upper(target))) AS guard FROM ed WHERE target IS NOT NULL AND upper(target) <> 'K' GROUP BY 1, 2)
    SELECT event_id, count(*) FILTER (att > 0) AS attacked, count(*) FILTER (att > 0 AND dfn = 0) AS undefended, CAST(sum(att * dest) AS BIGINT) AS att_mix, CAST(sum(dfn * dest) AS BIGINT) AS dfn_mix,
      (SELECT count(*) FROM (SELECT guard FROM g q WHERE q.event_id = g.event_id AND att > 0 AND dfn = 1 GROUP BY guard HAVING count(*) >= 2)) AS overloaded FROM g GROUP BY 1""",
)
def contacts(t: Tables):
    k = rl.contacts(bo.with_sets(random_boards(t)), ["event_id"])
    att, dfn = B.count(F.col("attackers")), B.count(F.col("defenders"))
    # a board's guard defends eight pieces at most: those it alone defends are counted in four bits of one of five sums
    guard = B.highest(F.when((att > 0) & (dfn == 1), F.col("defenders")))
    one = F.call_function("shiftleft", F.lit(1).cast("bigint"), guard % 15 * 4)
    tallies = [F.sum(F.when(F.floor(guard / 15) == q, one).otherwise(0)) for q in range(5)]
    twice = lambda x: B.count(B.within(x + B.const(int("6" * 15, 16)), int("8" * 15, 16)))
    return k.groupBy("event_id").agg(
        F.count_if(att > 0).alias("attacked"), F.count_if((att > 0) & (dfn == 0)).alias("undefended"),
        F.sum(att * F.col("sq")).alias("att_mix"), F.sum(dfn * F.col("sq")).alias("dfn_mix"),
        sum((twice(x) for x in tallies[1:]), twice(tallies[0])).cast("bigint").alias("overloaded"),
    )


@query("relations", "B12")
def relations(t: Tables):
    """Ranked sentences per position; goldens are in the tests, the sets behind them in `contacts`."""
    r = rl.relations(bo.with_sets(random_boards(t)), ["event_id"])
    return r.select("event_id", F.size("relations").alias("n"), F.array_join("relations", " | ").alias("relations"))


@query(
    "king_zone",
    "B13",
    f"""WITH {RANDOM}, {PIECES}, {EDGES}, {_KINGS}
    SELECT b.event_id, {', '.join(f"coalesce((SELECT string_agg({NAME.format('frm')}, ',' ORDER BY frm) FROM (SELECT DISTINCT frm FROM ed JOIN kg ON kg.event_id = ed.event_id WHERE ed.event_id = b.event_id AND kg.white = {w} AND ed.white <> {w} AND p NOT IN ('P', 'p') AND abs(dest % 8 - k % 8) <= 1 AND abs(dest // 8 - k // 8) <= 1)), '') AS zone_hit_{x}" for w, x in (('true', 'w'), ('false', 'b')))},
      EXISTS (SELECT 1 FROM ed JOIN kg ON kg.event_id = ed.event_id WHERE ed.event_id = b.event_id AND kg.white AND NOT ed.white AND dest = k) AS check_w FROM b""",
)
def king_zone(t: Tables):
    df = rl.king_zones(rl.attacks(bo.with_sets(random_boards(t))))
    return df.select("event_id", _n("zone_hit_w"), _n("zone_hit_b"), "check_w")


@query(
    "pins",
    "B14",
    f"""WITH {RANDOM}, {PIECES}, {_KINGS},
    dirs AS (SELECT * FROM (VALUES (1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)) v(df, dr)),
    ray AS (SELECT kg.event_id, kg.white, df, dr, n AS step, (k // 8 + dr * n) * 8 + k % 8 + df * n AS sq FROM kg, dirs, (SELECT CAST(range AS INTEGER) AS n FROM range(1, 8)) q
       WHERE k % 8 + df * n BETWEEN 0 AND 7 AND k // 8 + dr * n BETWEEN 0 AND 7),
    met AS (SELECT ray.*, pc.p, pc.white AS pwhite, row_number() OVER (PARTITION BY ray.event_id, ray.white, df, dr ORDER BY step) AS o FROM ray JOIN pc ON pc.event_id = ray.event_id AND pc.sq = ray.sq)
    SELECT a.event_id, a.sq, a.p AS piece, z.p AS pinner, z.sq AS pinner_sq FROM met a JOIN met z ON z.event_id = a.event_id AND z.white = a.white AND z.df = a.df AND z.dr = a.dr AND a.o = 1 AND z.o = 2
    WHERE a.pwhite = a.white AND z.pwhite <> a.white AND (upper(z.p) = 'Q' OR (upper(z.p) = 'R' AND a.df * a.dr = 0) OR (upper(z.p) = 'B' AND a.df * a.dr <> 0))""",
)
def pins(t: Tables):
    return bo.pins(bo.with_sets(random_boards(t)), ["event_id"]).select("event_id", "sq", "piece", "pinner", "pinner_sq")


@query("last_move_change", "B15")
def last_move_change(t: Tables):
    """A piece of every random board moves to a hashed square; golden cases are in the tests."""
    frm, to = F.pmod("event_id", F.lit(64)).cast("int"), F.pmod(F.col("event_id") * 7 + 3, F.lit(64)).cast("int")
    b = random_boards(t).withColumns({"frm": frm, "to": to}).where("frm <> to")
    mover = F.substr("board", F.col("frm") + 1, F.lit(1))
    b = b.withColumn("p", mover).where("p <> '.'")
    after = F.overlay(F.overlay(F.col("board"), F.col("p"), F.col("to") + 1, 1), F.lit("."), F.col("frm") + 1, 1)
    plies = b.select(
        "event_id", F.col("board").alias("before"), after.alias("after"), "frm", "to",
        F.when(F.col("p").rlike("[A-Z]"), F.lit("white")).otherwise(F.lit("black")).alias("mover"),
    )
    out = rl.last_move_change(plies, ["event_id"])
    return out.select("event_id", *[F.array_join(c, ",").alias(c) for c in ("targets", "undefended", "opened", "dropped")])


_REACH = "(o.r = {r} + CASE WHEN {w} THEN -1 ELSE 1 END AND abs(o.f - {f}) = 1 AND o.white = {w})"


@query(
    "piece_activity",
    "B16",
    f"""WITH {RANDOM}, {PIECES},
    m AS (SELECT pc.*, CASE WHEN white THEN r ELSE 7 - r END AS rr FROM pc WHERE p NOT IN ('P', 'p')),
    op AS (SELECT m.event_id, m.white, m.sq FROM m WHERE upper(p) IN ('N', 'B') AND rr IN (3, 4, 5)
       AND EXISTS (SELECT 1 FROM pw o WHERE o.event_id = m.event_id AND {_REACH.format(r='m.r', w='m.white', f='m.f')})
       AND NOT EXISTS (SELECT 1 FROM pw e WHERE e.event_id = m.event_id AND e.white <> m.white AND abs(e.f - m.f) = 1 AND (7 - e.rr) > m.rr))
    SELECT b.event_id, {', '.join(f"coalesce((SELECT string_agg({NAME.format('sq')}, ',' ORDER BY sq) FROM op WHERE op.event_id = b.event_id AND white = {w}), '') AS on_outpost_{x}, coalesce((SELECT string_agg({NAME.format('sq')}, ',' ORDER BY sq) FROM m WHERE m.event_id = b.event_id AND white = {w} AND upper(p) IN ('R', 'Q') AND rr = 6), '') AS seventh_{x}" for w, x in (('true', 'w'), ('false', 'b')))} FROM b""",
)
def piece_activity(t: Tables):
    df = bo.with_sets(random_boards(t))
    for op in (fe.material, fe.phase, fe.pawn_sets, rl.attacks, rl.mobility, rl.activity):
        df = op(df)
    return _lists(df, [f"{n}_{x}" for x in "wb" for n in ("on_outpost", "seventh")])


_CENTRE = f"""
lk AS (SELECT a.event_id, count(*) AS nl, string_agg({NAME.format('a.sq')} || '/' || {NAME.format('z.sq')}, ', ' ORDER BY a.f, a.sq) AS names FROM pw a JOIN pw z ON z.event_id = a.event_id AND a.white AND NOT z.white AND z.f = a.f AND z.r = a.r + 1 AND a.f IN (3, 4) GROUP BY 1),
tn AS (SELECT event_id, array_to_string(list_sort(list(DISTINCT x))[1:4], ', ') AS names FROM (SELECT a.event_id, {NAME.format('a.sq')} || 'x' || {NAME.format('z.sq')} AS x FROM pw a JOIN pw z ON z.event_id = a.event_id AND z.white <> a.white AND abs(z.f - a.f) = 1
   AND z.r = a.r + CASE WHEN a.white THEN 1 ELSE -1 END AND a.f BETWEEN 2 AND 5 AND z.f BETWEEN 2 AND 5) GROUP BY 1),
cp AS (SELECT event_id, count(*) FILTER (white) AS nw, count(*) FILTER (NOT white) AS nb, count(DISTINCT f) FILTER (white AND rr >= 3) = 2 AS rw, count(DISTINCT f) FILTER (NOT white AND rr >= 3) = 2 AS rb,
   coalesce(max(rr) FILTER (white), 0) AS mw, coalesce(max(rr) FILTER (NOT white), 0) AS mb,
   string_agg({NAME.format('sq')}, '+' ORDER BY sq) FILTER (white) AS lw, string_agg({NAME.format('sq')}, '+' ORDER BY sq) FILTER (NOT white) AS lb FROM pw WHERE f IN (3, 4) GROUP BY 1),
ce AS (SELECT b.event_id, CASE WHEN tn.names IS NOT NULL THEN 'dynamic' WHEN nl >= 1 AND coalesce(nw, 0) + coalesce(nb, 0) - 2 * nl <= 1 THEN 'closed' WHEN cp.event_id IS NULL THEN 'open'
   WHEN (rw AND mb <= 2) OR (rb AND mw <= 2) THEN 'mobile' ELSE 'semi-open' END AS centre, tn.names AS t, lk.names AS l, cp.* EXCLUDE (event_id)
   FROM b LEFT JOIN lk ON lk.event_id = b.event_id LEFT JOIN tn ON tn.event_id = b.event_id LEFT JOIN cp ON cp.event_id = b.event_id)"""


@query(
    "centre_type",
    "B17",
    f"""WITH {PAWNS}, {PIECES}, {_CENTRE} SELECT event_id, centre, CASE centre WHEN 'dynamic' THEN 'tension ' || t WHEN 'closed' THEN 'blocked pawns ' || l WHEN 'open' THEN 'no d/e-pawns'
      WHEN 'mobile' THEN CASE WHEN rw AND mb <= 2 THEN 'White pawns ' || lw ELSE 'Black pawns ' || lb END
      ELSE CASE WHEN nw + nb <= 2 OR nw <> nb THEN 'd/e-pawns: White ' || nw || ', Black ' || nb ELSE 'fluid centre' END END AS centre_detail FROM ce""",
)
def centre_type(t: Tables):
    return fe.centre(bo.with_sets(pawn_boards(t))).select("event_id", "centre", "centre_detail")


@query(
    "pawn_breaks",
    "B18",
    f"""WITH {PAWNS}, {PIECES},
    st AS (SELECT a.event_id, a.white, a.sq, a.f, b.board, n, a.r + n * CASE WHEN a.white THEN 1 ELSE -1 END AS tr, a.r + CASE WHEN a.white THEN 1 ELSE -1 END AS r1, CASE WHEN a.white THEN 1 ELSE -1 END AS d
       FROM pw a JOIN b ON b.event_id = a.event_id, (VALUES (1), (2)) v(n) WHERE n = 1 OR a.rr = 1),
    ok AS (SELECT * FROM st WHERE tr BETWEEN 1 AND 6 AND substr(board, tr * 8 + f + 1, 1) = '.' AND substr(board, r1 * 8 + f + 1, 1) = '.'),
    ht AS (SELECT ok.event_id, ok.white, ok.sq, n, {NAME.format('(tr * 8 + ok.f)')} || ' (hits ' || string_agg({NAME.format('e.sq')}, '+' ORDER BY e.sq) || ')' AS x
       FROM ok JOIN pw e ON e.event_id = ok.event_id AND e.white <> ok.white AND abs(e.f - ok.f) = 1 AND e.r = tr + d GROUP BY ok.event_id, ok.white, ok.sq, n, tr, ok.f),
    bl AS (SELECT a.event_id, a.white, a.f, a.rr FROM pw a JOIN pw z ON z.event_id = a.event_id AND z.white <> a.white AND z.f = a.f AND z.r = a.r + CASE WHEN a.white THEN 1 ELSE -1 END),
    ch AS (SELECT bl.event_id, bl.white, count(*) FILTER (s.f = bl.f - 1) AS up, count(*) FILTER (s.f = bl.f + 1) AS dn FROM bl JOIN pw s ON s.event_id = bl.event_id AND s.white = bl.white AND s.rr = bl.rr - 1 AND abs(s.f - bl.f) = 1 GROUP BY 1, 2)
    SELECT b.event_id, {', '.join(f"coalesce((SELECT array_to_string(list(x ORDER BY sq, n)[1:4], ', ') FROM ht WHERE ht.event_id = b.event_id AND white = {w}), '') AS breaks_{x}, (SELECT CASE WHEN up > dn THEN 'kingside' WHEN dn > up THEN 'queenside' END FROM ch WHERE ch.event_id = b.event_id AND white = {w}) AS chain_{x}" for w, x in (('true', 'w'), ('false', 'b')))} FROM b""",
)
def pawn_breaks(t: Tables):
    df = bo.with_sets(pawn_boards(t))
    return df.select(
        "event_id", *[F.array_join(fe.pawn_breaks(w), ", ").alias(f"breaks_{x}") for x, w in (("w", True), ("b", False))],
        *[fe.chain_direction(w).alias(f"chain_{x}") for x, w in (("w", True), ("b", False))],
    )


@query(
    "imbalances",
    "B19",
    f"""WITH {PAWNS}, {PIECES},
    att AS (SELECT DISTINCT event_id, white, (r + CASE WHEN white THEN 1 ELSE -1 END) * 8 + f + d AS s FROM pw, (VALUES (-1), (1)) v(d) WHERE f + d BETWEEN 0 AND 7 AND r + CASE WHEN white THEN 1 ELSE -1 END BETWEEN 0 AND 7),
    sp AS (SELECT event_id, white, count(*) AS n FROM (SELECT event_id, white, s FROM att WHERE (white AND s // 8 IN (4, 5, 6)) OR (NOT white AND s // 8 IN (1, 2, 3))
       UNION ALL SELECT event_id, white, sq FROM pw WHERE (white AND r IN (4, 5, 6)) OR (NOT white AND r IN (1, 2, 3))) GROUP BY 1, 2)
    SELECT b.event_id, coalesce((SELECT n FROM sp WHERE sp.event_id = b.event_id AND white), 0) AS space_w, coalesce((SELECT n FROM sp WHERE sp.event_id = b.event_id AND NOT white), 0) AS space_b,
      CAST(substr(board, 5, 1) = 'K' AS BIGINT) AS lag_w, CAST(substr(board, 61, 1) = 'k' AS BIGINT) AS lag_b FROM b""",
)
def imbalances(t: Tables):
    df = bo.with_sets(pawn_boards(t))
    return df.select(
        "event_id", *[fe.space(w).cast("bigint").alias(f"space_{x}") for x, w in (("w", True), ("b", False))],
        *[fe.lag_in_development(w).cast("bigint").alias(f"lag_{x}") for x, w in (("w", True), ("b", False))],
    )


_SIG = lambda ls: "'K' || " + " || ".join(f"repeat('{k.upper()}', {_cnt(k)})" for k in ls)


@query(
    "endgame_class",
    "B20",
    f"""WITH {THIN}, x AS (SELECT event_id, board, {_cnt('Q')} + {_cnt('q')} AS q, {_cnt('R')} + {_cnt('r')} AS r, {_cnt('B')} + {_cnt('b')} AS bi, {_cnt('N')} + {_cnt('n')} AS n,
       {_cnt('B')} AS wb, {_cnt('b')} AS bb, strpos(board, 'B') - 1 AS ws, strpos(board, 'b') - 1 AS bs FROM b)
    SELECT event_id, CASE WHEN q + r + bi + n = 0 THEN 'pawn' WHEN r > 0 AND q + bi + n = 0 THEN 'rook' WHEN q > 0 AND r + bi + n = 0 THEN 'queen'
      WHEN bi > 0 AND q + r + n = 0 THEN CASE WHEN wb = 1 AND bb = 1 THEN CASE WHEN (ws % 8 + ws // 8) % 2 <> (bs % 8 + bs // 8) % 2 THEN 'opposite-bishops' ELSE 'same-bishops' END ELSE 'mixed' END
      WHEN n > 0 AND q + r + bi = 0 THEN 'knight' WHEN bi + n > 0 AND q + r = 0 THEN 'bishop-knight' ELSE 'mixed' END AS endgame,
      {_SIG('QRBNP')} || ' vs ' || {_SIG('qrbnp')} AS signature FROM x""",
)
def endgame_class(t: Tables):
    return fe.endgame_class(bo.with_sets(thinned_boards(t))).select("event_id", "endgame", "signature")


@query(
    "pawn_endings",
    "B21",
    _PS.format(boards=PAWNS) + f""", {_KINGS},
    g AS (SELECT s.event_id, s.sq, s.white, f, r, rr, CASE WHEN s.white THEN 'White' ELSE 'Black' END AS me, CASE WHEN s.white THEN 'Black' ELSE 'White' END AS foe, o.k AS ok, b.turn,
        7 - rr - CASE WHEN rr = 1 THEN 1 ELSE 0 END AS need, greatest(abs(o.k % 8 - f), abs(o.k // 8 - CASE WHEN s.white THEN 7 ELSE 0 END)) AS far
      FROM s JOIN b ON b.event_id = s.event_id JOIN kg o ON o.event_id = s.event_id AND o.white <> s.white JOIN kg m ON m.event_id = s.event_id AND m.white = s.white WHERE passed),
    x AS (SELECT event_id, white, sq, me || ' passed pawn ' || {NAME.format('sq')} || CASE WHEN far > CASE WHEN (turn = 'w') <> white THEN need ELSE need - 1 END
        THEN ': OUTSIDE the square — the ' || foe || ' king cannot catch it' ELSE ': the ' || foe || ' king is inside its square' END || ' (pawn needs ' || need || ', king ' || far || ' moves).' AS line FROM g),
    oq AS (SELECT w.event_id, abs(w.k % 8 - z.k % 8) AS fd, abs(w.k // 8 - z.k // 8) AS rd FROM kg w JOIN kg z ON z.event_id = w.event_id AND w.white AND NOT z.white)
    SELECT b.event_id, coalesce((SELECT string_agg(line, '|' ORDER BY sq) FROM x WHERE x.event_id = b.event_id AND white), '') AS white_runs,
      coalesce((SELECT string_agg(line, '|' ORDER BY sq) FROM x WHERE x.event_id = b.event_id AND NOT white), '') AS black_runs,
      (SELECT CASE WHEN (fd = 0 AND rd % 2 = 0) OR (rd = 0 AND fd % 2 = 0) OR (fd = rd AND fd % 2 = 0) THEN 'Kings in ' || CASE WHEN fd <> 0 AND rd <> 0 THEN 'diagonal' WHEN greatest(fd, rd) = 2 THEN 'direct' ELSE 'distant' END
        || ' opposition — ' || CASE b.turn WHEN 'w' THEN 'Black' ELSE 'White' END || ' has the opposition (' || CASE b.turn WHEN 'w' THEN 'White' ELSE 'Black' END || ' to move must give way).' END FROM oq WHERE oq.event_id = b.event_id) AS opposition
    FROM b""",
)
def pawn_endings(t: Tables):
    df = fe.pawn_ending_facts(fe.pawn_sets(bo.with_sets(pawn_boards(t))))
    runs = lambda c: F.array_join(F.filter(c, lambda x: x.contains("the square") | x.contains("its square")), "|")
    return df.select(
        "event_id", runs("passer_facts_w").alias("white_runs"), runs("passer_facts_b").alias("black_runs"), "opposition"
    )


def _claims(t: Tables):
    """Claims: the true pieces except one rank, plus a queen on a1 and a pawn on h8."""
    b = random_boards(t).withColumns({f"_{up}": cx.true_pieces(F.col("board"), up) for up in (True, False)})
    rank = (F.pmod("event_id", F.lit(8)) + 1).cast("string")
    said = lambda up: F.filter(F.col(f"_{up}"), lambda p: ~p.endswith(rank))
    k = F.col("event_id")
    real = F.when(k % 3 == 0, F.array(F.lit("Qxd2+"), F.lit("Ra1#"))).otherwise(F.array().cast("array<string>"))
    claimed = F.when(k % 2 == 0, F.array(F.lit(" Qxd2 "), F.lit("h3"))).otherwise(F.array(F.lit("Ra1")))
    return b.select(
        "event_id", "event_type", "board",
        F.concat(said(True), F.array(F.lit("Qa1"))).alias("white"), F.concat(said(False), F.array(F.lit("h8"))).alias("black"),
        claimed.alias("claimed"), real.alias("real"),
        F.array(F.lit("Nd4"), F.lit("??")).alias("hang_claim"), F.array(F.lit("d4"), F.lit("e5")).alias("hang_real"),
    )


_CL = f"""
cl AS (SELECT b.event_id, b.event_type, count(pc.sq) AS total,
   count(*) FILTER (pc.sq IS NOT NULL AND (pc.r <> b.event_id % 8 OR (pc.sq = 0 AND pc.p = 'Q') OR (pc.sq = 63 AND pc.p = 'p'))) AS right_,
   2 - count(*) FILTER ((pc.sq = 0 AND pc.p = 'Q') OR (pc.sq = 63 AND pc.p = 'p')) AS phantom
   FROM b LEFT JOIN pc ON pc.event_id = b.event_id GROUP BY 1, 2)"""


@query(
    "claimed_boards",
    "B22 E04",
    f"""WITH {RANDOM}, {PIECES}, {_CL} SELECT event_id, CAST(total AS INTEGER) AS pieces_total, CAST(right_ AS INTEGER) AS pieces_correct, CAST(printf('%.3f', CAST(right_ AS DOUBLE) / total) AS DOUBLE) AS piece_accuracy,
      CAST(total - right_ AS INTEGER) AS missing, CAST(phantom AS INTEGER) AS phantom, CASE WHEN event_id % 3 <> 0 THEN '' WHEN event_id % 2 = 0 THEN 'Qxd2' ELSE 'Ra1' END AS seen,
      CASE WHEN event_id % 3 <> 0 THEN '' WHEN event_id % 2 = 0 THEN 'Ra1' ELSE 'Qxd2' END AS missed, 'e5' AS hanging_missed FROM cl""",
)
def claimed_boards(t: Tables):
    s = cx.score_claims(_claims(t), "board", "white", "black", ("claimed", "real"), ("hang_claim", "hang_real"))
    return s.select(
        "event_id", "pieces_total", "pieces_correct", "piece_accuracy", F.size("missing").alias("missing"),
        F.size("phantom").alias("phantom"), F.array_join("threats_seen", ",").alias("seen"),
        F.array_join("threats_missed", ",").alias("missed"), F.array_join("hanging_missed", ",").alias("hanging_missed"),
    )


@query(
    "vision_totals",
    "A17",
    f"""WITH {RANDOM}, {PIECES}, {_CL} SELECT event_type, CAST(sum(right_) AS BIGINT) AS pieces_correct, CAST(sum(total) AS BIGINT) AS pieces_total,
      count(*) FILTER (event_id % 3 = 0) AS threats_seen, 2 * count(*) FILTER (event_id % 3 = 0) AS threats_real, CAST(printf('%.3f', CAST(sum(right_) AS DOUBLE) / sum(total)) AS DOUBLE) AS accuracy FROM cl GROUP BY 1""",
)
def vision_totals(t: Tables):
    s = cx.score_claims(_claims(t), "board", "white", "black", ("claimed", "real"))
    return cx.vision_totals(s, ["event_type"])


@query("position_tags", "B23")
def position_tags(t: Tables):
    """Tag counts over all thinned boards; the features behind them have their own twins."""
    df = cx.tags(cx.position_features(thinned_boards(t), facts=False))
    return df.select(F.explode("tags").alias("tag")).groupBy("tag").agg(F.count(F.lit(1)).alias("n"))


@query("rendered_facts", "B24 D10")
def rendered_facts(t: Tables):
    df = thinned_boards(t).withColumn(
        "fen", F.concat_ws(" ", bo.placement(F.col("board")), "turn", "castling", F.lit("- 0"), "fullmove")
    )
    out = cx.render_facts(cx.position_features(df))
    return out.select("event_id", "facts")


@query(
    "grouped_moves",
    "B25 O03",
    """WITH w AS (SELECT item_id, unnest(regexp_split_to_array(trim(text), '[ \\n\\t]+')) AS m FROM benchmark),
    g AS (SELECT item_id, CASE WHEN starts_with(m, 'O-O') OR m[1] = 'K' THEN 0 WHEN m[1] = 'Q' THEN 1 WHEN m[1] = 'R' THEN 2 WHEN m[1] = 'B' THEN 3 WHEN m[1] = 'N' THEN 4 ELSE 5 END AS k, m FROM w),
    l AS (SELECT item_id, k, '- ' || ['King', 'Queen', 'Rook', 'Bishop', 'Knight', 'Pawn'][k + 1] || ': ' || string_agg(m, ' ' ORDER BY m) AS line FROM g GROUP BY 1, 2)
    SELECT item_id, string_agg(line, chr(10) ORDER BY k) AS lines, (SELECT array_to_string(regexp_split_to_array(trim(text), '[ \\n\\t]+')[1:5], ' ') FROM benchmark q WHERE q.item_id = l.item_id) AS capped FROM l GROUP BY 1""",
)
def grouped_moves(t: Tables):
    words = F.split(F.trim("text"), r"[ \n\t]+")
    return t.benchmark.select(
        "item_id", cx.group_moves(words).alias("lines"), F.array_join(cx.cap(words, 5), " ").alias("capped")
    )
