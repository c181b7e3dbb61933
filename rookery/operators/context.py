"""Position context: tags, claimed-board scoring, grouped moves, rendered facts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions import bits as B
from rookery.functions.numeric import half_even
from rookery.operators import features as fe
from rookery.operators import relations as rl
from rookery.operators.boards import fence, with_sets
from rookery.operators.retrieval import retrieve
from rookery.operators.sight import compare_claims, side_pieces

c = F.col
_GROUPS = ("King", "Queen", "Rook", "Bishop", "Knight", "Pawn")
# section title, column, cap
SECTIONS = (
    ("Endgame", "endgame_facts", 10),
    ("Middlegame character & imbalances", "character_facts", 8),
    ("Pawn structure", "pawn_facts", 12),
    ("King safety", "king_facts", 4),
    ("Piece activity", "activity_facts", 5),
    ("Guidance", "guidance", 6),
)


def position_features(df: DataFrame, facts: bool = True) -> DataFrame:
    """All feature columns of positions with board, turn, castling, fullmove. Row-local throughout.

    facts=False leaves the sentences out: enough for `tags`, and a much shorter plan.
    """
    for op in (with_sets, fe.material, fe.phase, fe.pawn_sets, fe.files_and_wings, fe.named_structures):
        df = op(df)
    if facts:
        df = fe.pawn_facts(df)
    df = rl.king_zones(rl.mobility(rl.attacks(df)))
    df = rl.activity(rl.king_safety(df, facts), facts)
    df = fe.endgame_class(fe.character_facts(fe.centre(df), facts))
    if facts:
        df = fe.endgame_facts(fe.pawn_ending_facts(df))
    return fence(df, "position features")


def tags(df: DataFrame) -> DataFrame:
    """tags: array<string> of what a position is about; needs `position_features`."""
    late, live = c("phase") == "endgame", c("phase") != "endgame"
    minors = B.either(*[c(x) for x in ("wn", "bn", "wb", "bb")]) != 0
    queens, rooks = B.either(c("wq"), c("bq")) != 0, B.either(c("wr"), c("br")) != 0
    any_of = lambda *names: B.either(*[c(n) for n in names]) != 0
    weak = any_of("isolated_w", "isolated_b", "doubled_w", "doubled_b", "backward_w", "backward_b")
    hit = (B.count(c("zone_hit_w")) >= 3) | (B.count(c("zone_hit_b")) >= 3)
    slow = live & (c("fullmove") >= 4) & ((B.count(c("home_w")) >= 2) | (B.count(c("home_b")) >= 2))
    behind = live & (F.abs(c("lag_w") - c("lag_b")) >= 2) & (c("fullmove") <= 20)
    pairs = [
        ("rook-endgame", late & ~queens & ~minors & rooks),
        ("pawn-endgame", late & ~queens & ~minors & ~rooks),
        ("endgame", late),
        ("opening", c("phase") == "opening"),
        ("bishop-pair", c("bishop_pair")),
        ("exchange", c("exchange")),
        ("opposite-bishops", c("opposite_bishops")),
        ("weak-pawns", weak),
        ("passed-pawn", any_of("passed_w", "passed_b")),
        ("open-file", c("open_files") != 0),
        ("pawn-majority", (c("majority_queenside") != 0) | (c("majority_kingside") != 0)),
        ("minority-attack", F.exists("structures", lambda x: x["name"] == "Carlsbad")),
        ("king-safety", live & ((c("open_near_w") != 0) & c("king_w").isNotNull()
                                | (c("open_near_b") != 0) & c("king_b").isNotNull() | hit)),
        ("opposite-castling", F.coalesce(c("castled_w") != c("castled_b"), F.lit(False))),
        ("outpost", any_of("on_outpost_w", "on_outpost_b", "spots_w", "spots_b")),
        ("seventh-rank", any_of("seventh_w", "seventh_b")),
        ("bad-bishop", any_of("bad_bishop_w", "bad_bishop_b")),
        ("development", slow | behind),
        ("space", live & (F.abs(c("space_w") - c("space_b")) >= 3)),
    ]
    flat = fe._texts(
        *[F.when(cond, F.lit(t)) for t, cond in pairs],
        F.when(live, F.concat(F.lit("centre-"), c("centre"))),
        F.when(late, F.concat(F.lit("eg-"), c("endgame"))),
    )
    named = F.transform("structures", lambda x: x["tag"])
    return df.withColumn("tags", F.array_distinct(F.concat(flat, named)))


def group_moves(moves: Column) -> Column:
    """`- Piece: moves` lines by piece letter, kings first, castling with the king."""
    def kind(m):
        first = F.substring(m, 1, 1)
        out = F.when(m.startswith("O-O") | (first == "K"), F.lit("King"))
        for letter, name in (("Q", "Queen"), ("R", "Rook"), ("B", "Bishop"), ("N", "Knight")):
            out = out.when(first == letter, F.lit(name))
        return out.otherwise(F.lit("Pawn"))

    line = lambda g: F.when(
        F.exists(moves, lambda m: kind(m) == g),
        F.concat(F.lit(f"- {g}: "), F.array_join(F.array_sort(F.filter(moves, lambda m: kind(m) == g)), " ")),
    )
    return F.array_join(fe._texts(*[line(g) for g in _GROUPS]), "\n")


def cap(items: Column, n: int) -> Column:
    return F.slice(items, 1, n)


def true_pieces(board: Column, white: bool) -> Column:
    """Letter and square of one side's pieces, by square; worked on batches of boards."""
    return side_pieces(board, white)


def score_claims(
    df: DataFrame, board: str, white: str, black: str, threats: tuple[str, str] | None = None,
    hanging: tuple[str, str] | None = None,
) -> DataFrame:
    """Claimed against true pieces; claimed against supplied threats and hanging squares.

    `white`/`black` are arrays of claims; `threats`/`hanging` are (claimed, true) array columns. In
    check the supplied truth must be empty.
    """
    nothing = F.array().cast("array<string>")
    total, right = c("pieces_total"), c("pieces_correct")
    out = compare_claims(df, board, white, black).withColumn(
        "piece_accuracy", F.when(total > 0, half_even(right / total, 3))
    ).select(*df.columns, "pieces_total", "pieces_correct", "piece_accuracy", "missing", "phantom")
    if threats:
        strip = lambda a: F.array_distinct(
            F.transform(F.coalesce(c(a), nothing), lambda t: F.regexp_replace(F.trim(t), r"[+#]+$", ""))
        )
        claimed, real = strip(threats[0]), strip(threats[1])
        out = out.withColumns(
            {
                "threats_real": c(threats[1]),
                "threats_claimed": F.array_sort(claimed),
                "threats_seen": F.array_sort(F.array_intersect(real, claimed)),
                "threats_missed": F.array_sort(F.array_except(real, claimed)),
            }
        )
    if hanging:
        squares = F.transform(
            F.coalesce(c(hanging[0]), nothing), lambda t: F.regexp_extract(t, r"([a-h][1-8])", 1)
        )
        claimed = F.array_sort(F.array_distinct(F.filter(squares, lambda s: s != "")))
        out = out.withColumns(
            {
                "hanging_real": F.array_sort(c(hanging[1])),
                "hanging_claimed": claimed,
                "hanging_missed": F.array_sort(F.array_except(c(hanging[1]), claimed)),
            }
        )
    return out


def vision_totals(df: DataFrame, group: list[str]) -> DataFrame:
    """Piece accuracy and threats seen of many claims."""
    agg = df.groupBy(*group).agg(
        F.sum("pieces_correct").alias("pieces_correct"),
        F.sum("pieces_total").alias("pieces_total"),
        F.sum(F.size("threats_seen")).alias("threats_seen"),
        F.sum(F.size("threats_seen") + F.size("threats_missed")).alias("threats_real"),
    )
    return agg.withColumn("accuracy", half_even(F.try_divide(c("pieces_correct"), c("pieces_total")), 3))


def guidance(df: DataFrame, key: str, pages: DataFrame, plans: DataFrame | None = None,
             opening: str | None = None, k: int = 3) -> DataFrame:
    """guidance: opening plan, structure plans, and the k best concept pages of the tags."""
    from rookery.operators.retrieval import longest_prefix

    best = retrieve(df.select(key, "tags"), pages, k, key=key)
    text = F.concat(c("title"), F.lit(": "), F.array_join("summary", " "))
    ranked = best.join(pages.select("slug", text.alias("_t")), "slug")
    per = ranked.groupBy(key).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "_t"))), lambda x: x["_t"]).alias("_pages")
    )
    out = df.join(per, key, "left")
    own_plans = F.transform(
        "structures", lambda x: F.concat(F.lit("Structure plan — "), x["name"], F.lit(": "), x["plan"])
    )
    nothing = F.array().cast("array<string>")
    parts = [own_plans, F.coalesce("_pages", nothing)]
    if plans is not None and opening:
        flat = plans.select("family", "plan", F.explode("prefixes").alias("prefix"))
        out = longest_prefix(out, opening, flat)
        line = F.when(
            (c("phase") != "endgame") & c("family").isNotNull(),
            F.concat(F.lit("Opening plans ("), c("family"), F.lit("): "), c("plan")),
        )
        parts.insert(0, F.array_compact(F.array(line)))
    out = out.withColumn("guidance", F.concat(*parts)).drop("_pages", "family", "plan", "prefix")
    return out


def render_facts(df: DataFrame, sections=SECTIONS, opening: Column | None = None) -> DataFrame:
    """facts: markdown of a position; empty sections are left out and lists are capped."""
    late = c("phase") == "endgame"
    side = F.when(c("turn") == "w", F.lit("white")).otherwise(F.lit("black"))
    head = F.concat(
        F.lit("## Position\n- FEN: `"), c("fen"), F.lit("`\n- Side to move: **"), side, F.lit("** (move "),
        c("fullmove").cast("string"), F.lit("), phase: "), c("phase"),
        F.coalesce(F.concat(F.lit("\n- Opening: "), opening), F.lit("")) if opening is not None else F.lit(""),
        F.lit("\n\n## Material\n- "), c("material"),
    )

    def block(title, column, n):
        shown = c(column)
        if column == "endgame_facts":
            shown = F.when(late, shown)
        if column == "character_facts":
            shown = F.when(~late, shown)
        return F.when(
            F.size(shown) > 0, F.concat(F.lit(f"\n\n## {title}\n- "), F.array_join(cap(shown, n), "\n- "))
        )

    present = [s for s in sections if s[1] in df.columns]
    return df.withColumn("facts", F.concat_ws("", head, *[block(*s) for s in present]))
