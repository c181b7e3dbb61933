"""Piece relations: sliding lines, mobility, king zones, attackers and defenders, last-move changes.

Unions and counts of attacks are set-wise fills on integer columns, so they stay inside the row.
Attribution (who attacks whom) and its sentences are worked on batches of boards by `sight`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions import bits as B
from rookery.operators.boards import SIDES, _char, _plane, own
from rookery.operators.features import LIGHT, _listed, _s, _sentence, _texts, _txt, undeveloped
from rookery.operators.sight import contact_lists, move_sets, relation_lists

c = F.col
_DIRS = {"n": 8, "s": -8, "e": 1, "w": -1, "ne": 9, "nw": 7, "se": -7, "sw": -9}
_ORTH = ("n", "s", "e", "w")
_NOT_A, _NOT_H = B.FULL ^ B.file_mask(0), B.FULL ^ B.file_mask(7)


def _wrap(d: str) -> int:
    return _NOT_A if "e" in d else _NOT_H if "w" in d else B.FULL


def _move(x: Column, n: int) -> Column:
    return B.left(x, n) if n > 0 else B.right(x, -n)


def slides(df: DataFrame, lines: dict[str, tuple[Column, Column]]) -> DataFrame:
    """Adds {name}_n … {name}_sw: squares seen along each line from the (straight, diagonal) sets.

    An occluded fill in three doublings per direction; every doubling is its own projection, so no
    expression is repeated. All names share the projections.
    """
    keys = [(name, d) for name in lines for d in _DIRS]
    g, p = (lambda name, d: f"_g_{name}_{d}"), (lambda d: f"_p_{d}")
    df = df.withColumns(
        {g(name, d): lines[name][0 if d in _ORTH else 1] for name, d in keys}
        | {p(d): B.within(B.inv(c("occ")), _wrap(d)) for d in _DIRS}
    )
    for k in (1, 2, 4):
        df = df.withColumns(
            {
                g(name, d): B.either(c(g(name, d)), B.both(c(p(d)), _move(c(g(name, d)), _DIRS[d] * k)))
                for name, d in keys
            }
            | {p(d): B.both(c(p(d)), _move(c(p(d)), n * k)) for d, n in _DIRS.items()}
        )
    df = df.withColumns(
        {f"{name}_{d}": B.within(_move(c(g(name, d)), _DIRS[d]), _wrap(d)) for name, d in keys}
    )
    return df.drop(*[g(*x) for x in keys], *[p(d) for d in _DIRS])


def _jumps(x: Column) -> list[Column]:
    """The eight knight shifts, each without wrapping."""
    e, w = B.east(x), B.west(x)
    ee, ww = B.east(e), B.west(w)
    return [B.left(e, 16), B.right(e, 16), B.left(w, 16), B.right(w, 16),
            B.left(ee, 8), B.right(ee, 8), B.left(ww, 8), B.right(ww, 8)]


def _king_steps(x: Column) -> list[Column]:
    e, w = B.east(x), B.west(x)
    return [e, w, B.left(x, 8), B.right(x, 8), B.left(e, 8), B.right(e, 8), B.left(w, 8), B.right(w, 8)]


def _drop(df: DataFrame, *names: str) -> DataFrame:
    return df.drop(*[f"{n}_{d}" for n in names for d in _DIRS])


def attacks(df: DataFrame) -> DataFrame:
    """att_w, att_b (attacked squares), lines_w_*, lines_b_* per direction, check_w, check_b."""
    df = slides(
        df,
        {
            f"lines_{_s(w)}": (B.either(own("r", w), own("q", w)), B.either(own("b", w), own("q", w)))
            for _, w in SIDES
        },
    )
    df = df.withColumns(
        {
            f"att_{_s(w)}": B.either(
                B.pawn_attacks(own("p", w), w), B.knight_attacks(own("n", w)), B.either(*_king_steps(own("k", w))),
                *[c(f"lines_{_s(w)}_{d}") for d in _DIRS],
            )
            for _, w in SIDES
        }
    )
    return df.withColumns(
        {
            f"check_{_s(w)}": F.coalesce(B.has(c(f"att_{_s(not w)}"), c(f"king_{_s(w)}")), F.lit(False))
            for _, w in SIDES
        }
    )


def mobility(df: DataFrame) -> DataFrame:
    """mobility_w, mobility_b: pseudo-legal moves without en passant; needs `attacks`.

    Along one line a square is reached from one piece only, so counting squares per direction counts
    moves. A pawn that reaches the last rank counts four times.
    """
    cols = {}
    empty = B.inv(c("occ"))
    for _, w in SIDES:
        s = _s(w)
        free, foe = B.inv(c(f"occ_{s}")), c(f"occ_{_s(not w)}")
        me = own("p", w)
        last = B.rank_mask(7 if w else 0)
        start = B.rank_mask(1 if w else 6)
        total = lambda sets, mask: sum((B.count(B.both(x, mask)) for x in sets), F.lit(0))
        moves = total([c(f"lines_{s}_{d}") for d in _DIRS], free)
        moves = moves + total(_jumps(own("n", w)), free) + total(_king_steps(own("k", w)), free)
        push = B.both(B.ahead(me, w), empty)
        double = B.both(B.ahead(B.both(B.ahead(B.within(me, start), w), empty), w), empty)
        takes = [B.both(B.ahead(B.east(me), w), foe), B.both(B.ahead(B.west(me), w), foe)]
        for x in [push, *takes]:
            moves = moves + B.count(x) + 3 * B.count(B.within(x, last))
        moves = moves + B.count(double)
        base = 0 if w else 56
        enemy = c(f"att_{_s(not w)}")
        clear = lambda *sqs: B.within(c("occ"), sum(1 << (base + x) for x in sqs)) == 0
        safe = lambda *sqs: B.within(enemy, sum(1 << (base + x) for x in sqs)) == 0
        at_home = c(f"king_{s}") == base + 4
        short = at_home & c("castling").contains("K" if w else "k") & clear(5, 6) & safe(4, 5, 6)
        long_ = at_home & c("castling").contains("Q" if w else "q") & clear(1, 2, 3) & safe(2, 3, 4)
        for flag in (short, long_):
            moves = moves + F.when(F.coalesce(flag, F.lit(False)), 1).otherwise(0)
        cols[f"mobility_{s}"] = moves.cast("int")
    return df.withColumns(cols)


def king_zones(df: DataFrame) -> DataFrame:
    """zone_hit_w, zone_hit_b: enemy pieces (no pawns) that reach the king or a square beside it.

    Lines of sight are symmetric: the attackers are the enemy pieces seen from the zone.
    """
    home = {s: F.coalesce(B.bit(c(f"king_{s}")), F.lit(0).cast("bigint")) for s in "wb"}
    df = df.withColumns({f"_zone_{s}": B.either(k, *_king_steps(k)) for s, k in home.items()})
    df = slides(df, {f"_z{s}": (c(f"_zone_{s}"), c(f"_zone_{s}")) for s in "wb"})
    cols = {}
    for _, w in SIDES:
        s = _s(w)
        z = c(f"_zone_{s}")
        orth = B.either(*[c(f"_z{s}_{d}") for d in _ORTH])
        diag = B.either(*[c(f"_z{s}_{d}") for d in _DIRS if d not in _ORTH])
        foe = lambda k: own(k, not w)
        cols[f"zone_hit_{s}"] = B.either(
            B.both(orth, B.either(foe("r"), foe("q"))), B.both(diag, B.either(foe("b"), foe("q"))),
            B.both(B.knight_attacks(z), foe("n")), B.both(B.either(*_king_steps(z)), foe("k")),
        )
    return _drop(df.withColumns(cols), "_zw", "_zb").drop("_zone_w", "_zone_b")


def piece_names(mask: Column, board: str = "board") -> Column:
    """Letter and square of the members, ascending."""
    return F.transform(
        B.squares(mask), lambda i: F.concat(F.upper(_char(c(board), i)), B.name_of(i))
    )


def pieces_text(mask: Column, board: str = "board", sep: str = ", ") -> Column:
    """`piece_names` joined, without lambdas."""
    named = lambda i: F.concat(F.upper(_char(c(board), F.lit(i))), F.lit(B.SQUARES[i]))
    return B.joined(mask, named, sep)


def king_safety(df: DataFrame, facts: bool = True) -> DataFrame:
    """shield_holes_*, open_near_* (file sets), castled_*, king_facts; needs phase, files, zones."""
    cols = {}
    for _, w in SIDES:
        s = _s(w)
        k = F.coalesce(B.bit(c(f"king_{s}")), F.lit(0).cast("bigint"))
        near = B.either(k, B.beside(k))
        guard = B.both(own("p", w), B.either(B.ahead(near, w), B.ahead(near, w, 2)))
        cols[f"shield_holes_{s}"] = B.minus(B.files8(near), B.files8(guard))
        cols[f"open_near_{s}"] = B.minus(B.files8(near), c(f"files_{s}"))
        kf = c(f"king_{s}") % 8
        r0 = F.floor(c(f"king_{s}") / 8).cast("int")
        kr = r0 + 1 if w else F.lit(8) - r0
        cols[f"king_rank_{s}"] = kr
        cols[f"castled_{s}"] = F.when(
            c("phase") != "endgame",
            F.when((kr <= 2) & (kf >= 5), F.lit("king")).when((kr <= 2) & (kf <= 2), F.lit("queen")),
        )
    df = df.withColumns(cols)
    if not facts:
        return df
    lines = []
    for name, w in SIDES:
        s = _s(w)
        k = c(f"king_{s}")
        rights = F.concat_ws(
            "/",
            F.when(c("castling").contains("K" if w else "k"), F.lit("O-O")),
            F.when(c("castling").contains("Q" if w else "q"), F.lit("O-O-O")),
        )
        status = (
            F.when(c("phase") == "endgame", F.concat(F.lit("king on "), B.name_of(k)))
            .when(c(f"castled_{s}") == "king", F.lit("king on kingside"))
            .when(c(f"castled_{s}") == "queen", F.lit("king on queenside"))
            .when(rights != "", F.concat(F.lit("king in centre (can still "), rights, F.lit(")")))
            .otherwise(F.lit("king in centre (castling rights lost)"))
        )
        live = c("phase") != "endgame"
        holes = c(f"shield_holes_{s}")
        bits = F.concat_ws(
            "; ",
            F.concat(F.lit(f"{name}: "), status),
            _sentence(live & (holes != 0) & (c(f"king_rank_{s}") <= 2) & ~(k % 8).isin(3, 4),
                      "shield missing on ", B.file_letters(holes, ","), "-file"),
            _sentence(live & (c(f"open_near_{s}") != 0), "open/half-open file(s) near king: ",
                      B.file_letters(c(f"open_near_{s}"), ",")),
            _sentence(live & (c(f"zone_hit_{s}") != 0), "enemy pieces hitting king zone: ",
                      pieces_text(c(f"zone_hit_{s}"))),
            F.when(c(f"check_{s}") & (c("turn") == s), F.lit("IN CHECK")),
        )
        lines.append(F.when(k.isNotNull(), bits))
    lines.append(
        F.when(c("castled_w") != c("castled_b"),
               F.lit("Opposite-side castling: pawn storms and speed of attack decide"))
        .when(c("phase") == "endgame", F.lit("Endgame: activate the king (centralise it)"))
    )
    return _listed(df, "king_facts", lines)


def activity(df: DataFrame, facts: bool = True) -> DataFrame:
    """outposts_*, on_outpost_*, seventh_*, bad_bishop_*, spots_*, activity_facts; needs mobility."""
    cols = {}
    for _, w in SIDES:
        s = _s(w)
        foe, me = own("p", not w), own("p", w)
        barred = B.ahead(B.ahead_fill(B.beside(foe), not w), not w)
        reach = B.rank_mask(3, 4, 5) if w else B.rank_mask(2, 3, 4)
        cols[f"outposts_{s}"] = B.within(B.minus(c(f"pawn_att_{s}"), barred), reach)
        blocked = B.within(B.both(me, B.ahead(foe, not w)), B.file_mask(2, 3, 4, 5))
        bad = F.lit(0).cast("bigint")
        for shade in (LIGHT, B.FULL ^ LIGHT):
            same, other = B.within(me, shade), B.within(me, B.FULL ^ shade)
            cond = (B.count(same) >= 3) & (B.count(same) > B.count(other)) & (B.count(B.within(blocked, shade)) >= 2)
            bad = F.when(cond, B.either(bad, B.within(own("b", w), shade))).otherwise(bad)
        cols[f"bad_bishop_{s}"] = bad
        cols[f"seventh_{s}"] = B.within(B.either(own("r", w), own("q", w)), B.rank_mask(6 if w else 1))
    df = df.withColumns(cols)
    more = {}
    for _, w in SIDES:
        s = _s(w)
        zone = B.rank_mask(4, 5) if w else B.rank_mask(2, 3)
        more[f"on_outpost_{s}"] = B.both(c(f"outposts_{s}"), B.either(own("n", w), own("b", w)))
        free = B.within(B.within(B.minus(c(f"outposts_{s}"), c("occ")), zone), B.file_mask(2, 3, 4, 5))
        more[f"spots_{s}"] = F.when(own("n", w) != 0, free).otherwise(F.lit(0).cast("bigint"))
        more[f"home_{s}"] = undeveloped(w)
    df = df.withColumns(more)
    if not facts:
        return df
    lines = [
        F.concat(F.lit("Mobility (pseudo-legal moves): White "), _txt(c("mobility_w")), F.lit(", Black "),
                 _txt(c("mobility_b")))
    ]
    for name, w in SIDES:
        s, o = _s(w), _s(not w)
        named = lambda i: F.concat(F.upper(_char(c("board"), i)), B.name_of(i))

        # rooks on files without own pawns, and pieces on the seventh rank: no other one has a note
        on_line = B.either(B.minus(own("r", w), B.of_files(c(f"files_{s}"))), c(f"seventh_{s}"))

        def line_notes(i):
            free = ~B.has(c(f"files_{s}"), i % 8) & B.has(own("r", w), i)
            kind = F.when(B.has(c(f"files_{o}"), i % 8), F.lit(" on half-open ")).otherwise(F.lit(" on open "))
            letter = F.substr(F.lit(B.FILES), i % 8 + 1, F.lit(1))
            return F.concat_ws(
                "; ",
                F.when(free, F.concat(named(i), kind, letter, F.lit("-file"))),
                F.when(B.has(c(f"seventh_{s}"), i), F.concat(named(i), F.lit(" on the 7th rank"))),
            )

        def bad_note(i):
            light = B.has(B.const(LIGHT), i)
            n = F.when(light, B.count(B.within(own("p", w), LIGHT))).otherwise(
                B.count(B.within(own("p", w), B.FULL ^ LIGHT))
            )
            return F.concat(named(i), F.lit(" is a bad bishop ("), _txt(n), F.lit(" own pawns on its colour)"))

        notes = F.concat(
            F.transform(B.squares(c(f"on_outpost_{s}")), lambda i: F.concat(named(i), F.lit(" on an outpost"))),
            F.transform(B.squares(on_line), line_notes),
            F.transform(B.squares(c(f"bad_bishop_{s}")), bad_note),
            _texts(
                _sentence((c("phase") != "endgame") & (c(f"home_{s}") != 0) & (c("fullmove") >= 4), "undeveloped: ",
                          pieces_text(c(f"home_{s}"))),
                _sentence(c(f"spots_{s}") != 0, "outpost squares available: ",
                          F.array_join(F.slice(B.names(c(f"spots_{s}")), 1, 4), ", ")),
            ),
        )
        lines.append(_sentence(F.size(notes) > 0, f"{name}: ", F.array_join(notes, "; ")))
    return _listed(df, "activity_facts", lines)


# --- attribution --------------------------------------------------------------------------------
def contacts(df: DataFrame, key: list[str]) -> DataFrame:
    """One row per piece but kings: key, sq, piece, attackers, defenders (square sets)."""
    return contact_lists(df, key).select(*key, F.inline("contacts"))


def relations(df: DataFrame, key: list[str], top: int = 8) -> DataFrame:
    """key, relations: sentences on attacked, loose and overloaded pieces, at most `top`.

    A position is one row all along; its sentences are worked on batches of boards.
    """
    free = B.either(*[c(f"{w}{k}") for w in "wb" for k in "nbrq"])
    return relation_lists(df, key, B.minus(free, B.both(c("wn"), c("wb"))), top)  # no piece is of two kinds


def last_move_change(plies: DataFrame, key: list[str]) -> DataFrame:
    """What the last move changed: key, targets, undefended, opened, dropped (arrays of names).

    `plies` has key, before, after (boards), frm, to (squares of the move) and mover (white/black).
    Both boards are compared within the row (`sight.move_sets`) after one narrow shuffle. Plies without a key
    or with nothing in sight on either board drop out.
    """
    known = [c(k).isNotNull() for k in key]
    per = plies.where(reduce(lambda x, y: x & y, known)).repartition(*key).select(
        *key, c("after").alias("board"), c("before").alias("was"), "mover", c("to").alias("m_to"),
        move_sets(c("before"), c("after"), c("frm"), c("to"), c("mover")).alias("_s"),
    ).where("_s.any").select("*", "_s.*").drop("_s")
    side = _plane
    white = c("mover") == "white"
    us = F.when(white, side(c("board"), "pnbrq")).otherwise(side(c("board"), "PNBRQ"))
    mates_now = F.when(white, side(c("board"), "PNBRQK")).otherwise(side(c("board"), "pnbrqk"))
    mates_then = F.when(white, side(c("was"), "PNBRQK")).otherwise(side(c("was"), "pnbrqk"))
    us_then = F.when(white, side(c("was"), "pnbrq")).otherwise(side(c("was"), "PNBRQ"))
    per = per.withColumns({"_us": us, "_mn": mates_now, "_mt": mates_then, "_ut": us_then})
    targets = B.both(c("mover_now"), c("_us"))
    dropped = B.minus(B.minus(B.both(c("mover_then"), c("_mt")), B.both(c("mover_now"), c("_mn"))), B.bit(c("m_to")))
    dropped = B.both(B.minus(B.both(dropped, c("_mn")), c("theirs")), c("ours"))
    name = lambda i: F.concat(F.upper(_char(c("board"), i)), B.name_of(i))
    hits = lambda f: F.element_at("opened", f + 1)
    opened = F.array_sort(
        F.flatten(
            F.transform(
                F.filter(F.sequence(F.lit(0), F.lit(63)), lambda f: hits(f) != 0),
                lambda f: F.transform(B.squares(hits(f)), lambda i: F.concat(name(f), F.lit("→"), name(i))),
            )
        )
    )
    return per.select(
        *key,
        piece_names(targets).alias("targets"),
        piece_names(B.minus(targets, c("ours"))).alias("undefended"),
        opened.alias("opened"),
        piece_names(dropped).alias("dropped"),
    )
