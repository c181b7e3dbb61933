"""Position features on fixed positions."""

import pytest
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.operators import boards as bo
from rookery.operators import context as cx
from rookery.operators import relations as rl

FENS = {
    "iqp": "r1bq1rk1/pp2bppp/2n1pn2/8/3P4/2NB1N2/PP3PPP/R1BQ1RK1 w - - 0 10",
    "carlsbad": "r1bq1rk1/pp1nbppp/2p2n2/3p2B1/3P4/2NBP3/PPQ2PPP/R3K1NR w KQ - 0 9",
    "passer": "8/5k2/8/1P6/8/8/5K2/8 w - - 0 1",
    "square_w": "8/8/8/P2k4/8/8/8/K7 w - - 0 1",
    "square_b": "8/8/8/P2k4/8/8/8/K7 b - - 0 1",
    "direct": "8/8/4k3/8/4K3/4P3/8/8 w - - 0 1",
    "diagonal": "8/8/4k3/8/2K5/4P3/8/8 w - - 0 1",
    "open": "4k3/pp3ppp/8/8/8/8/PP3PPP/4K3 w - - 0 1",
    "opposite": "8/8/8/2b5/4k3/8/3PB3/4K3 w - - 0 1",
    "rook": "4k3/8/8/8/8/8/r7/R3K3 w - - 0 1",
    "start": "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR w KQkq - 0 1",
    "pin": "4k3/4r3/8/8/8/8/4N3/4K3 w - - 0 1",
    "queen_hit": "r2qr1k1/ppp2ppp/3p1n2/8/1nBP4/3Q1N1P/PP3PP1/R3R1K1 w - - 2 14",
}


@pytest.fixture(scope="module")
def rows(spark):
    df = spark.createDataFrame(list(FENS.items()), "id string, fen string")
    df = cx.render_facts(cx.tags(cx.position_features(bo.parse_fen(df))))
    keep = ["id", "phase", "pawn_facts", "king_facts", "activity_facts", "character_facts", "endgame_facts",
            "centre", "endgame", "structures", "tags", "facts", "mobility_w", "mobility_b"]
    return {r.id: r for r in df.select(*keep).collect()}


def has(facts, text):
    return any(text in f for f in facts)


def test_structures(rows):
    assert has(rows["iqp"].pawn_facts, "IQP (White d-pawn on d4)") and "iqp" in rows["iqp"].tags
    assert has(rows["carlsbad"].pawn_facts, "Carlsbad") and "minority-attack" in rows["carlsbad"].tags
    assert has(rows["passer"].pawn_facts, "White passed pawn(s): b5") and rows["passer"].phase == "endgame"


def test_rule_of_the_square(rows):
    assert has(rows["square_w"].endgame_facts, "OUTSIDE the square")
    assert has(rows["square_b"].endgame_facts, "inside its square")
    assert has(rows["square_w"].endgame_facts, "Key squares of the a5-pawn: b7, b8")
    assert has(rows["direct"].endgame_facts, "direct opposition — Black has the opposition")
    assert has(rows["diagonal"].endgame_facts, "diagonal opposition")


def test_key_squares(spark):
    from rookery.functions import bits as B
    from rookery.operators.features import key_squares

    names = lambda s: F.transform(key_squares(F.lit(B.sq(s)), True), lambda k: B.name_of(k))
    row = spark.range(1).select(names("e4").alias("a"), names("e5").alias("b"), names("a4").alias("c")).first()
    assert set(row.a) == {"d6", "e6", "f6"} and set(row.c) == {"b7", "b8"}
    assert set(row.b) == {"d6", "e6", "f6", "d7", "e7", "f7"}


def test_classes(rows):
    assert rows["open"].centre == "open"
    assert rows["opposite"].endgame == "opposite-bishops" and rows["rook"].endgame == "rook"
    assert (rows["start"].mobility_w, rows["start"].mobility_b, rows["start"].phase) == (20, 20, "opening")


def test_rendered_order(rows):
    text = rows["iqp"].facts
    heads = ["## Position", "## Material", "## Middlegame", "## Pawn structure", "## King safety", "## Piece activity"]
    at = [text.index(h) for h in heads]
    assert at == sorted(at) and "Side to move: **white**" in text and FENS["iqp"] in text


def test_centres(spark):
    fens = [
        ("french", "r1b1kbnr/pp3ppp/1qn1p3/3pP3/2pP4/P1P2N2/1P3PPP/RNBQKB1R w KQkq - 0 7"),
        ("dynamic", "rnbqkbnr/pppp1ppp/8/4p3/3PP3/8/PPP2PPP/RNBQKBNR b KQkq - 0 7"),
    ]
    df = bo.parse_fen(spark.createDataFrame(fens, "id string, fen string"))
    got = {r.id: r for r in cx.position_features(df).select("id", "centre", "chain_w", "chain_b", "breaks_b").collect()}
    f = got["french"]
    assert (f.centre, f.chain_w, f.chain_b) == ("closed", "kingside", "queenside")
    assert any(b.startswith("f6") for b in f.breaks_b) and got["dynamic"].centre == "dynamic"


def test_attacked_queen_first(spark):
    df = spark.createDataFrame([("q", FENS["queen_hit"]), ("p", FENS["pin"])], "id string, fen string")
    sets = bo.with_sets(bo.parse_fen(df))
    got = {r.id: r.relations for r in rl.relations(sets, ["id"]).collect()}
    assert got["q"][0].startswith("White Qd3: attacked by Nb4")
    pins = sorted((r.id, r.sq, r.piece, r.pinner, r.pinner_sq) for r in bo.pins(sets, ["id"]).collect())
    assert pins == [("p", 12, "N", "r", 52), ("q", 53, "p", "B", 26)]


def test_last_move(spark):
    before = "r1bqr1k1/ppp2ppp/2np1n2/8/2BP4/3Q1N1P/PP3PP1/R3R1K1"
    after = "r1bqr1k1/ppp2ppp/3p1n2/8/1nBP4/3Q1N1P/PP3PP1/R3R1K1"
    df = spark.createDataFrame([("a", before, after, 42, 25, "black")], "id string, b string, a string, frm int, to int, mover string")
    df = df.select("id", bo.board_of(F.col("b")).alias("before"), bo.board_of(F.col("a")).alias("after"), "frm", "to", "mover")
    row = rl.last_move_change(df, ["id"]).first()
    assert row.targets == ["Pa2", "Qd3"] and row.undefended == [] and row.dropped == []


def test_claimed_board(spark):
    board = bo.board_of(F.lit("4k3/8/8/3q4/8/8/3R4/4K3"))
    df = spark.range(1).select(
        board.alias("board"), F.array(F.lit("Ke1"), F.lit("Rd2")).alias("w"), F.array(F.lit("Ke8"), F.lit("Qd4")).alias("b"),
        F.array(F.lit("Rxd5")).alias("tc"), F.array(F.lit("Rxd5+")).alias("tr"), F.array(F.lit("d5")).alias("hc"), F.array(F.lit("d5")).alias("hr"),
    )
    r = cx.score_claims(df, "board", "w", "b", ("tc", "tr"), ("hc", "hr")).first()
    assert (r.pieces_total, r.pieces_correct, r.missing, r.phantom) == (4, 3, ["Qd5"], ["Qd4"])
    assert r.threats_missed == [] and r.hanging_missed == [] and r.hanging_real == ["d5"]


def test_guidance_uses_tags(spark, rows):
    pages = spark.createDataFrame(
        [("iqp", "Isolated Queen's Pawn", ["iqp"], ["Blockade."]), ("rooks", "Rook endings", ["rook-endgame"], ["Be active."])],
        "slug string, title string, tags array<string>, summary array<string>",
    )
    df = bo.parse_fen(spark.createDataFrame([("iqp", FENS["iqp"])], "id string, fen string"))
    out = cx.guidance(cx.tags(cx.position_features(df)), "id", pages).first().guidance
    assert out[0].startswith("Structure plan — IQP") and out[1] == "Isolated Queen's Pawn: Blockade."


def test_book_table_is_short():
    assert len(K.BOOK_STARTS) == 8


def test_contacts_stay_one_row_a_position(spark):
    fens = [("q", FENS["queen_hit"]), ("q", FENS["queen_hit"]), (None, FENS["pin"]), ("two", FENS["pin"]), ("two", FENS["rook"])]
    df = bo.with_sets(bo.parse_fen(spark.createDataFrame(fens, "id string, fen string")))
    found = rl.contacts(df, ["id"])
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "Join" not in plan  # no row per edge
    got = {(r.id, r.sq, r.piece): (r.attackers, r.defenders) for r in found.collect()}
    edges = bo.attack_edges(df, ["id"]).where("target NOT IN ('.', 'K', 'k')").collect()
    want = {}
    for e in edges:
        att, dfn = want.setdefault((e.id, e.to, e.target), (set(), set()))
        (dfn if e.target.isupper() == (e.color == "white") else att).add(e.frm)
    bits = lambda s: (lambda n: n - 2**64 if n >> 63 else n)(sum(1 << x for x in s))
    assert got == {k: (bits(a), bits(d)) for k, (a, d) in want.items()} and len(got) == found.count()


def test_last_move_without_a_row_per_edge(spark):
    rows = [("a", "4k3/8/8/3r4/8/2B5/8/R3K3", "4k3/8/8/3r4/5B2/8/8/R3K3", 18, 29, "white"), (None, "4k3/8/8/8/8/8/8/4K3", "4k3/8/8/8/8/8/8/3K4", 4, 3, "white")]
    df = spark.createDataFrame(rows, "id string, b string, a string, frm int, to int, mover string")
    df = df.select("id", bo.board_of(F.col("b")).alias("before"), bo.board_of(F.col("a")).alias("after"), "frm", "to", "mover")
    out = rl.last_move_change(df, ["id"])
    assert "Join" not in out._jdf.queryExecution().optimizedPlan().toString()
    assert [r.id for r in out.collect()] == ["a"]


def test_claims_of_odd_rows(spark):
    """Null boards, lists and items, short boards, letters that are no piece, claims said twice; a row stays a row."""
    rows = [
        (1, "Q.x" + "." * 61, ["  qa1+", "Q a1", "b2", None, "??", "e9 h8 a1"], None),
        (1, None, ["Ka1"], ["d \x0b d4"]), (None, "kZ", [], ["Ka1", "kb8"]),
    ]
    df = spark.createDataFrame(rows, "id int, board string, w array<string>, b array<string>")
    r = cx.score_claims(df, "board", "w", "b").collect()
    got = [(x.id, x.pieces_total, x.pieces_correct, x.piece_accuracy, x.missing, x.phantom) for x in r]
    assert got == [
        (1, 2, 1, 0.5, ["Xc1"], ["Pb2", "Ph8"]), (1, 0, 0, None, [], ["Ka1", "Pd4"]), (None, 2, 1, 0.5, ["Zb1"], ["Kb8"]),
    ]
    sides = df.select(*[cx.true_pieces(F.col("board"), up) for up in (True, False)]).collect()
    assert [tuple(x) for x in sides] == [(["Qa1"], ["Xc1"]), ([], []), (["Zb1"], ["Ka1"])]


def test_claims_are_worked_in_batches(spark):
    df = spark.createDataFrame([("." * 64, [""], [""])], "board string, w array<string>, b array<string>")
    plan = cx.score_claims(df, "board", "w", "b")._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan  # no interpreted lambda over squares


def test_lists_are_compiled(spark):
    """Sentences are columns of their own: none is interpreted inside the filter that drops the NULL ones."""
    from rookery.operators import features as fe

    df = bo.parse_fen(spark.createDataFrame([("iqp", FENS["iqp"])], "id string, fen string"))
    df = fe.named_structures(fe.pawn_sets(bo.with_sets(df)))
    plan = df.select("structures")._jdf.queryExecution().optimizedPlan().toString()
    kept = [line for line in plan.splitlines() if "lambdafunction(isnotnull" in line]
    assert kept and not any("CASE" in line for line in kept)


def test_boards_are_dealt_anew(spark):
    """One small file is one task to read, and not one task to work."""
    from catalog.base import Tables
    from catalog.boards import random_boards

    df = random_boards(Tables(spark, "/root/testdata/sf0.001"))
    assert df.rdd.getNumPartitions() >= 2 * spark.sparkContext.defaultParallelism
    assert sorted(df.toPandas()["event_id"]) == sorted(spark.read.parquet("/root/testdata/sf0.001/events.parquet").toPandas()["event_id"])


def test_piece_texts_without_lambdas(spark):
    from rookery.functions import bits as B

    masks = [0, 1, -1, 1 << 62, -(1 << 63), 0x0100000000008081, None]
    df = spark.createDataFrame([("QRBNPKpk" * 8, m) for m in masks], "board string, m bigint").select(
        rl.pieces_text(F.col("m")).alias("a"), B.names_text(F.col("m"), "+").alias("b"),
        F.array_join(rl.piece_names(F.col("m")), ", ").alias("x"), F.array_join(B.names(F.col("m")), "+").alias("y"),
    )
    assert "lambda" not in df.select("a", "b")._jdf.queryExecution().optimizedPlan().toString()
    assert all((r.a, r.b) == (r.x, r.y) for r in df.collect())


def _plain_relations(board, men, top=8):
    """Sentences from (sq, piece, attackers, defenders) in plain Python."""
    from rookery.functions import bits as B

    worth = {"P": 1, "N": 3, "B": 3, "R": 5, "Q": 9, "K": 0}
    name = lambda i: board[i].upper() + B.SQUARES[i]
    side = lambda p: "White" if p.isupper() else "Black"
    listed = lambda s: ", ".join(map(name, sorted(s, key=lambda i: (-worth.get(board[i].upper(), 99), i))))
    fire = [m for m in men if m[2]]
    items = [
        (-10 * worth[p.upper()] - 5 * (not dfn), -sq,
         f"{side(p)} {name(sq)}: attacked by {listed(att)}; " + (f"defended by {listed(dfn)}" if dfn else "UNDEFENDED"))
        for sq, p, att, dfn in fire
    ]
    met = {m[0] for m in men}
    items += [(-worth[p.upper()], -i, f"{side(p)} {name(i)}: loose (undefended, not attacked yet)")
              for i, p in enumerate(board) if p in "NBRQnbrq" and i not in met]
    guards = {}
    for sq, p, _, dfn in sorted(fire, key=lambda m: (-m[0], m[1])):
        if len(dfn) == 1:
            guards.setdefault(min(dfn), []).append((-worth[p.upper()], sq))
    for i, (g, held) in enumerate((g, h) for g, h in guards.items() if len(h) > 1):
        items.append((-50, 100 + i, f"OVERLOADED: {side(board[g])} {name(g)} is the only defender of {', '.join(name(s) for _, s in sorted(held))}"))
    return [t for *_, t in sorted(items)][:top]


def test_relations_against_plain_python(spark):
    """Full and empty boards, keys of several boards with equal ranks, rows twice, no key, no board, cut into small batches."""
    from collections import Counter
    from random import Random

    rng = Random(4)
    board = lambda k: "".join(rng.choice("PNBRQKpnbrqk" + "." * k) for _ in range(64))
    rows = [(f"a{i}", board(i)) for i in range(0, 80, 4)] + [(None, board(9)), (None, board(9)), ("none", None), (None, None), ("void", "." * 64)]
    for i in range(12):
        one = board(9)
        rows += [(f"m{i}", one)] * 2 + [(f"m{i}", one[:k] + board(6)[: 64 - k]) for k in (20, 50)] + [(f"m{i}", None)]
    df = bo.with_sets(spark.createDataFrame(rows, "id string, board string"))
    bits = lambda n: {i for i in range(64) if n >> i & 1}
    men = {}
    for r in rl.contacts(df, ["id"]).where("id IS NOT NULL").collect():
        men.setdefault(r.id, []).append((r.sq, r.piece, bits(r.attackers), bits(r.defenders)))
    size = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(size)
    try:
        for most in ("3", before):
            spark.conf.set(size, most)
            got = rl.relations(df, ["id"]).collect()
            said = Counter((r.id, *r.relations) for r in got if not (r.relations and r.relations[0] is None))
            want = [(k, *_plain_relations(b, men.get(k, []))) for k, b in rows if b is not None]
            want += [(None,), ("none",)]
            assert said == Counter(want) and len(got) == len(rows)
    finally:
        spark.conf.set(size, before)


def test_relations_are_worked_in_batches(spark):
    """No sentence is built by interpreted lambdas, no position's rows are collected into a list."""
    df = bo.with_sets(spark.createDataFrame([("a", "." * 64)], "id string, board string"))
    plan = rl.relations(df, ["id"])._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "lambda" not in plan and "collect_" not in plan
