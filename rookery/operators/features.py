"""Static position features as columns: material, phase, pawns, kings, activity, centre, endings.

Input: positions with `with_sets` applied (and turn, castling, fullmove where noted). Every operator
adds columns to the row it reads; nothing is exploded or shuffled. `*_facts` columns are arrays of
sentences, the other columns are what the sentences are made of.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import and_
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions import bits as B
from rookery.operators.boards import SIDES, fence, own
from rookery.operators.wording import CENTRE_PLANS, ENDGAME_GUIDE, STRUCTURES

c = F.col
LIGHT = sum(1 << s for s in range(64) if (s % 8 + s // 8) % 2 == 1)
HOME_MINORS = {True: 0x66, False: 0x66 << 56}  # b, c, f, g of the home rank


def _s(white: bool) -> str:
    return "w" if white else "b"


def _texts(*parts: Column) -> Column:
    """Array of the non-NULL parts."""
    return F.array_compact(F.array(*parts))


def _listed(df: DataFrame, column: str, parts: list[Column], before: Column | None = None, after: Column | None = None) -> DataFrame:
    """Adds `column`: the non-NULL parts in one array, between the arrays `before` and `after`.

    The parts are columns of their own first: everything inside an array's filter is interpreted, while
    columns are compiled.
    """
    names = [f"_{column}_{i}" for i in range(len(parts))]
    df = fence(df.withColumns(dict(zip(names, parts, strict=True))), column)
    lists = [x for x in (before, _texts(*[c(n) for n in names]), after) if x is not None]
    return df.withColumn(column, F.concat(*lists) if len(lists) > 1 else lists[0]).drop(*names)


def _sentence(cond: Column, *parts) -> Column:
    return F.when(cond, F.concat(*[F.lit(p) if isinstance(p, str) else p for p in parts]))


def _txt(n: Column) -> Column:
    return n.cast("string")


# --- material and phase -------------------------------------------------------------------------
def material(df: DataFrame) -> DataFrame:
    """points_w/b, npm_w/b, material (text) and the flags bishop_pair, exchange, opposite_bishops."""
    n = {(k, w): B.count(own(k, w)) for k in "pnbrq" for _, w in SIDES}
    npm = lambda w: n["n", w] * 3 + n["b", w] * 3 + n["r", w] * 5 + n["q", w] * 9
    df = df.withColumns(
        {f"n_{_s(w)}{k}": n[k, w] for k in "pnbrq" for _, w in SIDES}
        | {f"npm_{_s(w)}": npm(w) for _, w in SIDES}
    ).withColumns({f"points_{_s(w)}": c(f"npm_{_s(w)}") + c(f"n_{_s(w)}p") for _, w in SIDES})

    def side(name, w):
        s = _s(w)
        letters = F.concat(*[F.repeat(F.lit(f"{k.upper()} "), c(f"n_{s}{k}")) for k in "qrbn"])
        letters = F.when(letters == "", F.lit("-")).otherwise(F.rtrim(letters))
        return F.concat(F.lit(f"{name}: "), letters, F.lit(" P×"), _txt(c(f"n_{s}p")), F.lit(" ("),
                        _txt(c(f"points_{s}")), F.lit(")"))

    diff = c("points_w") - c("points_b")
    balance = (
        F.when(diff == 0, F.lit("equal")).when(diff > 0, F.concat(F.lit("White +"), _txt(diff)))
        .otherwise(F.concat(F.lit("Black +"), _txt(-diff)))
    )
    wb, bb, wr, br, wq, bq = (c(f"n_{x}") for x in ("wb", "bb", "wr", "br", "wq", "bq"))
    wm, bm = c("n_wn") + wb, c("n_bn") + bb
    exch_w, exch_b = (wr - br == 1) & (bm - wm == 1), (br - wr == 1) & (wm - bm == 1)
    even = (wr == br) & (wq == bq)
    extra = (
        F.when(exch_w, F.lit("White is up the exchange"))
        .when(exch_b, F.lit("Black is up the exchange"))
        .when((wm - bm >= 1) & even & (diff <= 0),
              F.concat(F.lit("White has "), _txt(wm - bm), F.lit(" extra minor piece(s) vs pawns")))
        .when((bm - wm >= 1) & even & (diff >= 0),
              F.concat(F.lit("Black has "), _txt(bm - wm), F.lit(" extra minor piece(s) vs pawns")))
    )
    opposite = (wb == 1) & (bb == 1) & (
        (B.within(c("wb"), LIGHT) != 0) != (B.within(c("bb"), LIGHT) != 0)
    )
    pair_w, pair_b = (wb >= 2) & (bb < 2), (bb >= 2) & (wb < 2)
    notes = F.concat_ws(
        "; ",
        F.when(pair_w, F.lit("White has the bishop pair")),
        F.when(pair_b, F.lit("Black has the bishop pair")),
        extra,
        F.when((F.abs(wq - bq) == 1) & (wr + wm != br + bm), F.lit("queen vs pieces imbalance")),
        F.when(opposite, F.lit("opposite-coloured bishops (drawish in endgames, attacking in middlegames)")),
    )
    text = F.concat_ws(
        " | ", side("White", True), side("Black", False), F.concat(F.lit("balance: "), balance),
        F.when(notes != "", notes),
    )
    return df.withColumns(
        {"material": text, "bishop_pair": pair_w | pair_b, "exchange": exch_w | exch_b,
         "opposite_bishops": opposite}
    )


def undeveloped(white: bool) -> Column:
    """Minor pieces on their home squares."""
    return B.within(B.either(own("n", white), own("b", white)), HOME_MINORS[white])


def phase(df: DataFrame) -> DataFrame:
    """`phase` from material, move number and undeveloped minor pieces; needs `material` columns."""
    npm = c("npm_w") + c("npm_b")
    late = B.count(undeveloped(True)) + B.count(undeveloped(False))
    return df.withColumn(
        "phase",
        F.when((npm <= 18) | ((c("n_wq") + c("n_bq") == 0) & (npm <= 26)), F.lit("endgame"))
        .when((c("fullmove") <= 8) | ((c("fullmove") <= 15) & (late >= 3)), F.lit("opening"))
        .otherwise(F.lit("middlegame")),
    )


# --- pawns --------------------------------------------------------------------------------------
def pawn_sets(df: DataFrame) -> DataFrame:
    """Square sets isolated, backward, passed, protected, connected and file sets files, doubled."""
    df = df.withColumns({f"files_{_s(w)}": B.files8(own("p", w)) for _, w in SIDES} | {
        f"pawn_att_{_s(w)}": B.pawn_attacks(own("p", w), w) for _, w in SIDES
    })
    cols = {}
    for _, w in SIDES:
        s, o = _s(w), _s(not w)
        me, foe, files = own("p", w), own("p", not w), c(f"files_{s}")
        lonely = B.minus(files, B.beside8(files))
        isolated = B.both(me, B.of_files(lonely))
        cols[f"isolated_{s}"] = isolated
        behind = B.ahead(B.ahead_fill(me, w), w)
        cols[f"doubled_{s}"] = B.files8(B.both(me, behind))
        supported = B.ahead_fill(B.beside(me), w)
        hit = B.ahead(c(f"pawn_att_{o}"), not w)
        cols[f"backward_{s}"] = B.both(B.minus(B.minus(me, isolated), supported), hit)
        front = B.either(foe, B.beside(foe))
        barred = B.ahead(B.ahead_fill(front, not w), not w)
        cols[f"passed_{s}"] = B.minus(me, barred)
    df = df.withColumns(cols)
    more = {}
    for _, w in SIDES:
        s = _s(w)
        passed = c(f"passed_{s}")
        more[f"protected_{s}"] = B.both(passed, c(f"pawn_att_{s}"))
        more[f"connected_{s}"] = B.both(passed, B.of_files(B.beside8(B.files8(passed))))
        files = c(f"files_{s}")
        more[f"islands_{s}"] = B.count(B.minus(files, B.left(files, 1)))
    return df.withColumns(more)


def _passed_text(white: bool) -> Column:
    s = _s(white)
    rank = lambda i: F.floor(i / 8).cast("int") + 1 if white else F.lit(8) - F.floor(i / 8).cast("int")
    keyed = F.array_sort(
        F.transform(
            B.squares(c(f"passed_{s}")),
            lambda i: F.struct((-rank(i)).alias("r"), (i % 8).alias("f"), i.alias("i")),
        )
    )
    one = lambda x: F.concat(
        B.name_of(x["i"]), F.lit(" ("),
        F.when(B.has(c(f"protected_{s}"), x["i"]), F.lit("protected, ")).otherwise(F.lit("")),
        F.when(B.has(c(f"connected_{s}"), x["i"]), F.lit("connected, ")).otherwise(F.lit("")),
        F.lit("rank "), _txt(-x["r"]), F.lit(")"),
    )
    return F.array_join(F.transform(keyed, one), "; ")


def files_and_wings(df: DataFrame) -> DataFrame:
    """open_files, half_open_w/b (file sets) and majorities per wing (signed, White positive)."""
    wf, bf = c("files_w"), c("files_b")
    wing = lambda files: (
        B.count(B.within(c("wp"), B.file_mask(*files))) - B.count(B.within(c("bp"), B.file_mask(*files)))
    )
    return df.withColumns(
        {
            "open_files": B.within(B.inv(B.either(wf, bf)), 0xFF),
            "half_open_w": B.minus(bf, wf),
            "half_open_b": B.minus(wf, bf),
            "majority_queenside": wing((0, 1, 2)),
            "majority_kingside": wing((5, 6, 7)),
        }
    )


def pawn_facts(df: DataFrame) -> DataFrame:
    """pawn_facts: sentences on weak and passed pawns, islands, files, wings, named structures."""
    parts = []
    for name, w in SIDES:
        s = _s(w)
        parts += [
            _sentence(c(f"isolated_{s}") != 0, f"{name} isolated pawn(s): ", B.names_text(c(f"isolated_{s}"))),
            _sentence(c(f"doubled_{s}") != 0, f"{name} doubled pawns on the ", B.file_letters(c(f"doubled_{s}")), "-file"),
            _sentence(c(f"backward_{s}") != 0, f"{name} backward pawn(s): ", B.names_text(c(f"backward_{s}")),
                      " (stop square controlled by enemy pawn)"),
            _sentence(c(f"passed_{s}") != 0, f"{name} passed pawn(s): ", _passed_text(w)),
            _sentence(c(f"islands_{s}") >= 3, f"{name} has ", _txt(c(f"islands_{s}")), " pawn islands"),
        ]
    dash = lambda f: F.when(f == 0, F.lit("-")).otherwise(B.file_letters(f))
    parts += [
        _sentence(c("open_files") != 0, "Open files: ", B.file_letters(c("open_files"))),
        _sentence((c("half_open_w") != 0) | (c("half_open_b") != 0), "Half-open files: White ",
                  dash(c("half_open_w")), "; Black ", dash(c("half_open_b"))),
    ]
    for wing, files in (("queenside", (0, 1, 2)), ("kingside", (5, 6, 7))):
        n = {w: B.count(B.within(own("p", w), B.file_mask(*files))) for _, w in SIDES}
        d = c(f"majority_{wing}")
        parts.append(
            _sentence(
                d != 0, F.when(d > 0, F.lit("White")).otherwise(F.lit("Black")), f" has a {wing} pawn majority (",
                _txt(F.greatest(n[True], n[False])), " vs ", _txt(F.least(n[True], n[False])), ")",
            )
        )
    found = F.transform(
        c("structures"), lambda x: F.concat(F.lit("Structure: "), x["name"], F.lit(" — "), x["sentence"])
    )
    return _listed(df, "pawn_facts", parts, after=found)


class Shape(NamedTuple):
    """A structure by squares of pawns: where they must be, must not be, and files that must be empty."""

    key: str
    white: str = ""
    black: str = ""
    not_white: str = ""
    not_black: str = ""
    white_without: str = ""
    black_without: str = ""
    black_with: str = ""
    unless_black: str = ""  # not all of these together
    words: tuple[tuple[str, str], ...] = ()

    def holds(self) -> Column:
        pawns = {True: c("wp"), False: c("bp")}
        on = lambda white, names: [B.at(pawns[white], s) for s in names.split()]
        empty = lambda white, files: [~_has_file(white, f) for f in files]
        tests = [*on(True, self.white), *on(False, self.black)]
        tests += [~x for x in (*on(True, self.not_white), *on(False, self.not_black))]
        tests += [*empty(True, self.white_without), *empty(False, self.black_without)]
        tests += [_has_file(False, f) for f in self.black_with]
        if self.unless_black:
            tests.append(~reduce(and_, on(False, self.unless_black)))
        return reduce(and_, tests)


# fixed values: the named structures, in the order in which they are reported
SHAPES = (
    Shape("carlsbad", white="d4 e3", black="d5 c6", white_without="c", black_without="e"),
    Shape("carlsbad_reversed", white="d4 c3", black="d5 e6", white_without="e", black_without="c"),
    Shape("hedgehog", white="c4 e4", black="b6 d6 e6", white_without="d", black_without="c"),
    Shape("maroczy", white="c4 e4", white_without="d", black_without="c", black_with="d", unless_black="b6 d6 e6"),
    Shape("scheveningen", white="e4", black="d6 e6", not_white="c4", white_without="d", black_without="c"),
    Shape("najdorf", white="e4", black="d6 e5", not_white="c4", not_black="e6", white_without="d", black_without="c"),
    Shape("french", white="d4 e5", black="d5 e6"),
    Shape("kings_indian", white="d5 e4", black="d6 e5"),
    Shape("benoni", white="d5", black="c5 d6", white_without="c", black_without="e"),
    Shape("stonewall", white="d4 e3 f4", words=(("o", "White"), ("s", "d4-e3-f4"), ("t", "e4"))),
    Shape("stonewall", black="d5 e6 f5", words=(("o", "Black"), ("s", "d5-e6-f5"), ("t", "e5"))),
)


def _has_file(white: bool, file: str) -> Column:
    return B.within(c(f"files_{_s(white)}"), 1 << B.FILES.index(file)) != 0


def _worded(key: str, words: dict[str, Column | str]) -> Column:
    """struct(name, tag, sentence, plan) of a structure, its slots filled."""
    fill = lambda part: part if not part.startswith("{") else words[part[1:-1]]
    texts = []
    for template in STRUCTURES[key]:
        parts = [fill(x) for x in re.split(r"(\{\w+\})", template) if x]
        texts.append(F.concat(*[F.lit(x) if isinstance(x, str) else x for x in parts]))
    return F.struct(*[x.alias(n) for x, n in zip(texts, ("name", "tag", "sentence", "plan"))])


def _isolated(white: bool) -> tuple[Column, Column]:
    """Whether a side's only d-pawn is isolated in the centre with an open file before it; its square."""
    pawns = B.within(own("p", white), B.file_mask(3))
    central = B.within(pawns, B.rank_mask(3, 4)) != 0  # the same two ranks for both sides
    alone = ~_has_file(white, "c") & ~_has_file(white, "e") & ~_has_file(not white, "d")
    return (B.count(pawns) == 1) & alone & central, B.name_of(B.highest(pawns))


def _hanging(white: bool) -> Column:
    """Whether the rearmost c- and d-pawns of a side stand on its fourth rank without neighbours."""
    rank = B.rank_mask(3 if white else 4)
    on_rank = []
    for file in (2, 3):
        pawns = B.within(own("p", white), B.file_mask(file))
        rearmost = B.both(pawns, B.inv(B.left(B.north_fill(pawns), 8)))
        on_rank.append(B.within(rearmost, rank) != 0)
    bare = [~_has_file(white, "b"), ~_has_file(white, "e"), ~_has_file(not white, "c"), ~_has_file(not white, "d")]
    return reduce(and_, on_rank + bare)


def named_structures(df: DataFrame) -> DataFrame:
    """structures: array<struct(name, tag, sentence, plan)> of the recognised pawn structures."""
    found = []
    for _, white in SIDES:
        holds, square = _isolated(white)
        found.append(F.when(holds, _worded("iqp", {"o": _title(white), "x": _title(not white), "s": square})))
    for _, white in SIDES:
        r = "4" if white else "5"
        words = {"o": _title(white), "x": _title(not white), "s": "c" + r, "t": "d" + r}
        found.append(F.when(_hanging(white), _worded("hanging", words)))
    found += [F.when(shape.holds(), _worded(shape.key, dict(shape.words))) for shape in SHAPES]
    return _listed(df, "structures", found)


def _title(white: bool) -> str:
    return "White" if white else "Black"


# --- centre, chains, imbalances -----------------------------------------------------------------
def centre(df: DataFrame) -> DataFrame:
    """centre (dynamic ▸ closed ▸ open ▸ mobile ▸ semi-open) and centre_detail."""
    d_e, zone = B.file_mask(3, 4), B.file_mask(2, 3, 4, 5)
    wp, bp = c("wp"), c("bp")
    locked = B.both(B.within(wp, d_e), B.right(bp, 8))
    # captures toward the h-file and the a-file between pawns of the c- to f-files
    wz, bz = B.within(wp, zone), B.within(bp, zone)
    takes = {
        "wr": B.both(wz, B.west(B.right(bz, 8))),
        "wl": B.both(wz, B.east(B.right(bz, 8))),
        "br": B.both(bz, B.west(B.left(wz, 8))),
        "bl": B.both(bz, B.east(B.left(wz, 8))),
    }
    df = df.withColumns({"locked": locked} | {f"_t_{k}": v for k, v in takes.items()})
    shift = {"wr": 9, "wl": 7, "br": -7, "bl": -9}
    def lever_names(k, d):
        takes_text = lambda i: F.concat(B.name_of(i), F.lit("x"), B.name_of(i + d))
        return F.transform(B.squares(c(f"_t_{k}")), takes_text)

    levers = F.array_sort(
        F.array_distinct(F.concat(*[lever_names(k, d) for k, d in shift.items()]))
    )
    any_lever = B.either(*[c(f"_t_{k}") for k in shift]) != 0
    cw, cb = B.within(wp, d_e), B.within(bp, d_e)
    nw, nb = B.count(cw), B.count(cb)
    n, nl = nw + nb, B.count(c("locked"))
    upper = {True: B.rank_mask(3, 4, 5, 6, 7), False: B.rank_mask(0, 1, 2, 3, 4)}
    mobile = {}
    for _, w in SIDES:
        mine, foe = (cw, cb) if w else (cb, cw)
        rolling = B.files8(B.within(mine, upper[w])) == 0b11000
        held = {True: B.rank_mask(5, 6, 7), False: B.rank_mask(0, 1, 2)}[w]
        mobile[w] = rolling & (B.within(foe, B.FULL ^ held) == 0)
    pair = lambda i: F.concat(B.name_of(i), F.lit("/"), B.name_of(i + 8))
    kind = (
        F.when(any_lever, F.lit("dynamic"))
        .when((nl >= 1) & (n - 2 * nl <= 1), F.lit("closed"))
        .when(n == 0, F.lit("open"))
        .when(mobile[True] | mobile[False], F.lit("mobile"))
        .otherwise(F.lit("semi-open"))
    )
    by_file = lambda arr: F.transform(  # noqa: E731  (file by file, then rank)
        F.array_sort(F.transform(arr, lambda i: F.struct((i % 8).alias("f"), i.alias("i")))), lambda x: x["i"]
    )
    detail = (
        F.when(any_lever, F.concat(F.lit("tension "), F.array_join(F.slice(levers, 1, 4), ", ")))
        .when(c("centre") == "closed",
              F.concat(F.lit("blocked pawns "), F.array_join(F.transform(by_file(B.squares(c("locked"))), pair), ", ")))
        .when(c("centre") == "open", F.lit("no d/e-pawns"))
        .when(mobile[True] & (c("centre") == "mobile"), F.concat(F.lit("White pawns "), B.names_text(cw, "+")))
        .when(c("centre") == "mobile", F.concat(F.lit("Black pawns "), B.names_text(cb, "+")))
        .when((n <= 2) | (nw != nb),
              F.concat(F.lit("d/e-pawns: White "), _txt(nw), F.lit(", Black "), _txt(nb)))
        .otherwise(F.lit("fluid centre"))
    )
    df = df.withColumn("centre", kind).withColumn("centre_detail", detail)
    return df.drop(*[f"_t_{k}" for k in shift])


def chain_direction(white: bool) -> Column:
    """Wing a locked pawn chain points to, NULL if none."""
    me, foe = own("p", white), own("p", not white)
    blocked = B.both(me, B.ahead(foe, not white))
    back = B.ahead(me, white)  # squares with an own pawn straight behind
    up = B.count(B.both(blocked, B.east(back)))
    down = B.count(B.both(blocked, B.west(back)))
    return F.when(up > down, F.lit("kingside")).when(down > up, F.lit("queenside"))


def pawn_breaks(white: bool, limit: int = 4) -> Column:
    """Pushes that would attack an enemy pawn, as texts."""
    me, foe, empty = own("p", white), own("p", not white), B.inv(c("occ"))
    last = B.rank_mask(7 if white else 0)
    one = B.both(B.ahead(me, white), empty)
    one = B.within(one, B.FULL ^ last)
    start = B.rank_mask(1 if white else 6)
    two = B.both(B.ahead(B.both(B.ahead(B.within(me, start), white), empty), white), empty)
    lever = B.ahead(B.beside(foe), not white)  # squares from which a pawn attacks an enemy pawn
    d = 8 if white else -8
    hit = lambda to: F.concat(
        B.name_of(to), F.lit(" (hits "),
        F.concat_ws(
            "+",
            F.when((to % 8 > 0) & B.has(foe, F.greatest(to + d - 1, F.lit(0))), B.name_of(F.greatest(to + d - 1, F.lit(0)))),
            F.when((to % 8 < 7) & B.has(foe, F.least(to + d + 1, F.lit(63))), B.name_of(F.least(to + d + 1, F.lit(63)))),
        ),
        F.lit(")"),
    )
    # pawn by pawn in square order, single step before double step
    keyed = lambda pushes, back, order: F.transform(
        B.squares(B.both(pushes, lever)),
        lambda to: F.struct((to - back).alias("p"), F.lit(order).alias("k"), hit(to).alias("t")),
    )
    both = F.array_sort(F.concat(keyed(one, d, 1), keyed(two, 2 * d, 2)))
    return F.slice(F.transform(both, lambda x: x["t"]), 1, limit)


def opposite_wings() -> Column:
    wf, bf = c("king_w") % 8, c("king_b") % 8
    return F.coalesce(((wf >= 5) & (bf <= 2)) | ((wf <= 2) & (bf >= 5)), F.lit(False))


def space(white: bool) -> Column:
    half = B.rank_mask(4, 5, 6) if white else B.rank_mask(1, 2, 3)
    me = own("p", white)
    return B.count(B.within(B.pawn_attacks(me, white), half)) + B.count(B.within(me, half))


def lag_in_development(white: bool) -> Column:
    """Undeveloped minors, plus one for a king still on its home square."""
    king = c(f"king_{_s(white)}")
    return B.count(undeveloped(white)) + F.when(king == (4 if white else 60), 1).otherwise(0)


def character_facts(df: DataFrame, facts: bool = True) -> DataFrame:
    """character_facts: centre, chains, breaks, opposite wings, minor pieces, space, development."""
    df = df.withColumns(
        {f"chain_{_s(w)}": chain_direction(w) for _, w in SIDES}
        | {f"space_{_s(w)}": space(w) for _, w in SIDES}
        | {f"lag_{_s(w)}": lag_in_development(w) for _, w in SIDES}
    )
    if not facts:
        return df
    plans = F.create_map(*[F.lit(x) for kv in CENTRE_PLANS.items() for x in kv])
    df = df.withColumns({f"breaks_{_s(w)}": pawn_breaks(w) for _, w in SIDES})
    parts = [
        F.concat(F.lit("Type: "), c("centre"), F.lit(" centre ("), c("centre_detail"), F.lit("). "),
                 F.element_at(plans, c("centre")))
    ]
    for name, w in SIDES:
        d = c(f"chain_{_s(w)}")
        parts.append(
            _sentence((c("centre") == "closed") & d.isNotNull(), f"{name} pawn chain points to the ", d,
                      f" — {name}'s natural play is on the ", d, ".")
        )
    for name, w in SIDES:
        b = c(f"breaks_{_s(w)}")
        parts.append(_sentence(F.size(b) > 0, f"{name} pawn breaks available: ", F.array_join(b, ", ")))
    parts.append(
        F.when(opposite_wings(), F.lit("Kings on opposite wings: a race — throw pawns at the enemy king, "
                                       "speed matters more than material."))
    )
    crowded = (c("centre") == "closed") | (c("n_wp") + c("n_bp") >= 14)
    verdict = F.when(crowded, F.lit("favours the knight(s) (closed position)")).otherwise(
        F.lit("favours the bishop(s) (open lines, pawns on both wings)")
    )
    for (name, w), (other, _) in zip(SIDES, reversed(SIDES)):
        s, o = _s(w), _s(not w)
        parts.append(
            _sentence((c(f"n_{s}b") > c(f"n_{o}b")) & (c(f"n_{o}n") > c(f"n_{s}n")),
                      f"Minor pieces: {name} bishop(s) vs {other} knight(s) — the structure ", verdict, ".")
        )
    sw, sb = c("space_w"), c("space_b")
    for big, small, x, y in (("White", "Black", sw, sb), ("Black", "White", sb, sw)):
        parts.append(
            _sentence(x - y >= 3, f"Space: {big} ", _txt(x), f" vs {small} ", _txt(y),
                      f" (squares in the enemy half held by pawns) — {big} should avoid exchanges; "
                      f"{small} is cramped and benefits from trades and freeing breaks.")
        )
    for lead, rest, x, y in (("White", "Black", c("lag_w"), c("lag_b")), ("Black", "White", c("lag_b"), c("lag_w"))):
        parts.append(
            _sentence((y - x >= 2) & (c("fullmove") <= 20), f"Development: {lead} leads by ", _txt(y - x),
                      f" tempi — open the position now before {rest} catches up.")
        )
    return _listed(df, "character_facts", parts)


# --- endings ------------------------------------------------------------------------------------
def endgame_class(df: DataFrame) -> DataFrame:
    """endgame (class of the ending) and signature (piece letters of both sides)."""
    q, r = B.either(c("wq"), c("bq")) != 0, B.either(c("wr"), c("br")) != 0
    b, n = B.either(c("wb"), c("bb")) != 0, B.either(c("wn"), c("bn")) != 0
    one_each = (B.count(c("wb")) == 1) & (B.count(c("bb")) == 1)
    differ = (B.within(c("wb"), LIGHT) != 0) != (B.within(c("bb"), LIGHT) != 0)
    kind = (
        F.when(~q & ~r & ~b & ~n, F.lit("pawn"))
        .when(r & ~q & ~b & ~n, F.lit("rook"))
        .when(q & ~r & ~b & ~n, F.lit("queen"))
        .when(b & ~q & ~r & ~n,
              F.when(~one_each, F.lit("mixed")).when(differ, F.lit("opposite-bishops")).otherwise(F.lit("same-bishops")))
        .when(n & ~q & ~r & ~b, F.lit("knight"))
        .when((b | n) & ~q & ~r, F.lit("bishop-knight"))
        .otherwise(F.lit("mixed"))
    )
    letters = lambda w: F.concat(
        F.lit("K"), *[F.repeat(F.lit(k.upper()), B.count(own(k, w))) for k in "qrbnp"]
    )
    return df.withColumn("endgame", kind).withColumn(
        "signature", F.concat(letters(True), F.lit(" vs "), letters(False))
    )


def _distance(a: Column, b: Column) -> Column:
    rank = lambda x: F.floor(x / 8).cast("int")
    return F.greatest(F.abs(a % 8 - b % 8), F.abs(rank(a) - rank(b)))


def key_squares(square: Column, white: bool) -> Column:
    """Squares from which the attacking king escorts a passed pawn, as an array."""
    f, r0 = square % 8, F.floor(square / 8).cast("int")
    up = 1 if white else -1
    rel = r0 + 1 if white else F.lit(8) - r0
    side = F.when(f == 0, F.lit(1)).otherwise(F.lit(6))
    edge = F.array(side + (48 if white else 8), side + (56 if white else 0))
    ranks = F.when(rel <= 4, F.array(r0 + 2 * up)).otherwise(F.array(r0 + up, r0 + 2 * up))
    ranks = F.filter(ranks, lambda r: (r >= 0) & (r < 8))
    plain = F.flatten(F.transform(ranks, lambda r: F.array(r * 8 + f - 1, r * 8 + f, r * 8 + f + 1)))
    return F.when(f.isin(0, 7), edge).otherwise(plain)


def _passer_facts(name: str, other: str, white: bool) -> Column:
    s, o = _s(white), _s(not white)
    mine, foe = c(f"king_{s}"), c(f"king_{o}")
    pawns = B.either(c("wp"), c("bp"))

    def facts(i):
        r0 = F.floor(i / 8).cast("int")
        rel = r0 + 1 if white else F.lit(8) - r0
        need = F.lit(8) - rel - F.when(rel == 2, 1).otherwise(0)
        far = _distance(foe, i % 8 + (56 if white else 0))
        reach = F.when(c("turn") == ("b" if white else "w"), need).otherwise(need - 1)
        pn = B.name_of(i)
        tail = F.concat(F.lit(" (pawn needs "), _txt(need), F.lit(", king "), _txt(far), F.lit(" moves)."))
        run = F.when(
            far > reach,
            F.concat(F.lit(f"{name} passed pawn "), pn, F.lit(f": OUTSIDE the square — the {other} king cannot catch it"), tail),
        ).otherwise(
            F.concat(F.lit(f"{name} passed pawn "), pn, F.lit(f": the {other} king is inside its square"), tail)
        )
        keys = key_squares(i, white)
        key = F.when(
            F.array_contains(keys, mine),
            F.concat(F.lit(f"{name} king on key square "), B.name_of(mine), F.lit(" of the "), pn,
                     F.lit("-pawn — winning in K+P vs K if the pawn is safe.")),
        ).otherwise(
            F.concat(F.lit("Key squares of the "), pn, F.lit("-pawn: "),
                     F.array_join(F.transform(keys, lambda k: B.name_of(k)), ", "),
                     F.lit(f" ({name} king wants to reach one; {other} king must keep it out)."))
        )
        rest = B.minus(pawns, B.bit(i))
        gap = F.array_min(F.transform(B.squares(rest), lambda j: F.abs(j % 8 - i % 8)))
        outside = F.when(
            (B.count(rest) >= 2) & (gap >= 3),
            F.concat(F.lit(f"{name} "), pn, F.lit(" is an OUTSIDE passed pawn — use it as a decoy.")),
        )
        return F.array_compact(F.array(run, key, outside))

    return F.flatten(F.transform(B.squares(c(f"passed_{s}")), facts))


def opposition() -> Column:
    wk, bk = c("king_w"), c("king_b")
    fd = F.abs(wk % 8 - bk % 8)
    rd = F.abs(F.floor(wk / 8).cast("int") - F.floor(bk / 8).cast("int"))
    held = ((fd == 0) & (rd % 2 == 0)) | ((rd == 0) & (fd % 2 == 0)) | ((fd == rd) & (fd % 2 == 0))
    kind = (
        F.when((fd != 0) & (rd != 0), F.lit("diagonal"))
        .when(F.greatest(fd, rd) == 2, F.lit("direct"))
        .otherwise(F.lit("distant"))
    )
    holder = F.when(c("turn") == "w", F.lit("Black")).otherwise(F.lit("White"))
    mover = F.when(c("turn") == "w", F.lit("White")).otherwise(F.lit("Black"))
    return F.when(
        held,
        F.concat(F.lit("Kings in "), kind, F.lit(" opposition — "), holder, F.lit(" has the opposition ("),
                 mover, F.lit(" to move must give way).")),
    )


def pawn_ending_facts(df: DataFrame) -> DataFrame:
    """passer_facts_w/b (arrays) and opposition (text); empty when a king is missing."""
    ok = c("king_w").isNotNull() & c("king_b").isNotNull()
    nothing = F.array().cast("array<string>")
    return df.withColumns(
        {
            "passer_facts_w": F.when(ok, _passer_facts("White", "Black", True)).otherwise(nothing),
            "passer_facts_b": F.when(ok, _passer_facts("Black", "White", False)).otherwise(nothing),
            "opposition": F.when(ok, opposition()),
        }
    )


def lone_minor(white: bool) -> Column:
    minors = B.either(own("n", white), own("b", white))
    men = B.minus(c(f"occ_{_s(white)}"), own("k", white))
    return (B.count(men) == 1) & (B.both(men, minors) != 0)


def endgame_facts(df: DataFrame) -> DataFrame:
    """endgame_facts: class with guide, passer races, opposition, lone minor pieces."""
    guide = F.create_map(*[F.lit(x) for kv in ENDGAME_GUIDE.items() for x in kv])
    head = F.concat(F.lit("Type: "), F.replace(c("endgame"), F.lit("-"), F.lit(" ")), F.lit(" ending ("),
                    c("signature"), F.lit("). "), F.element_at(guide, c("endgame")))
    full = F.concat(c("passer_facts_w"), c("passer_facts_b"),
                    F.array_compact(F.array(c("opposition"))))

    def race(name: str, w: bool) -> Column:
        bare = B.minus(B.minus(c(f"occ_{_s(not w)}"), own("k", not w)), own("p", not w)) == 0
        kept = F.filter(c(f"passer_facts_{_s(w)}"), lambda t: t.startswith(name) & t.contains("square"))
        return F.when(bare, kept).otherwise(F.array().cast("array<string>"))

    body = F.when(c("endgame") == "pawn", full).otherwise(F.concat(race("White", True), race("Black", False)))
    lone = _texts(
        *[F.when(lone_minor(w), F.lit(f"{n} has a lone minor piece and no pawns: cannot win.")) for n, w in SIDES]
    )
    return df.withColumn("endgame_facts", F.concat(F.array(head), body, lone))
