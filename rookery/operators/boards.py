"""Positions as 64-character boards and square sets.

`board` lists squares a1, b1, … h8, `.` for an empty one. Features are integer columns per position
(see functions.bits): no explode, no join, no shuffle. Attack edges, which need one row per piece,
come from a broadcast of the fixed ray table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.functions import bits as B

PIECES = "PNBRQKpnbrqk."
SIDES = (("White", True), ("Black", False))


# --- FEN ----------------------------------------------------------------------------------------
def _expand(rank: Column) -> Column:
    for n in range(1, 9):
        rank = F.replace(rank, F.lit(str(n)), F.lit("." * n))
    return rank


def board_of(fen: Column) -> Column:
    ranks = F.reverse(F.split(F.split_part(fen, F.lit(" "), F.lit(1)), "/"))
    return _expand(F.array_join(ranks, ""))


def parse_fen(df: DataFrame, fen: str = "fen") -> DataFrame:
    """Adds board, turn (w/b), castling, ep, halfmove, fullmove."""
    part = lambda i: F.split_part(F.col(fen), F.lit(" "), F.lit(i))
    return df.withColumns(
        {
            "board": board_of(F.col(fen)),
            "turn": part(2),
            "castling": part(3),
            "ep": part(4),
            "halfmove": F.coalesce(part(5).try_cast("int"), F.lit(0)),
            "fullmove": F.coalesce(part(6).try_cast("int"), F.lit(1)),
        }
    )


def epd(fen: Column) -> Column:
    return F.substring_index(fen, " ", 4)


def placement(board: Column) -> Column:
    """FEN placement field of a board."""
    rows = [F.substring(board, 8 * r + 1, 8) for r in range(7, -1, -1)]
    text = F.concat_ws("/", *rows)
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit("." * n), F.lit(str(n)))
    return text


def pieces(df: DataFrame, keep: list[str], board: str = "board") -> DataFrame:
    """One row per piece: keep…, sq, file, rank (from 0), color, piece."""
    rows = df.select(*keep, F.posexplode(F.split(F.col(board), "")).alias("sq", "piece"))
    return rows.where((F.col("piece") != ".") & (F.col("piece") != "")).select(
        *keep,
        "sq",
        (F.col("sq") % 8).alias("file"),
        F.floor(F.col("sq") / 8).cast("int").alias("rank"),
        F.when(F.col("piece").between("A", "Z"), F.lit("white")).otherwise(F.lit("black")).alias("color"),
        "piece",
    )


def _char(board: Column, square: Column) -> Column:
    return F.substr(board, square + 1, F.lit(1))


def fence(df: DataFrame, name: str) -> DataFrame:
    """Counts rows under a metric name and keeps later filters from being inlined into `df`.

    The feature columns are built in dozens of small projections. A filter on one of them would be
    rewritten through all of these, which multiplies its expression at every step; an observed
    metric is a boundary for that rewrite while column pruning still passes.
    """
    return df.observe(f"{name} {uuid.uuid4().hex[:8]}", F.count(F.lit(1)).alias("rows"))


# --- square sets --------------------------------------------------------------------------------
def _plane(board: Column, members: str) -> Column:
    flags = "".join("1" if c in members else "0" for c in PIECES)
    binary = F.translate(F.reverse(board), PIECES, flags)
    half = lambda at: F.conv(F.substring(binary, at, 32), 2, 10).cast("bigint")
    # never NULL, which keeps the generated code of everything built on it short
    return F.coalesce(F.shiftleft(half(1), 32).bitwiseOR(half(33)), F.lit(0).cast("bigint"))


SETS = ("wp", "wn", "wb", "wr", "wq", "wk", "bp", "bn", "bb", "br", "bq", "bk")


def with_sets(df: DataFrame, board: str = "board") -> DataFrame:
    """Adds one square set per piece kind and colour (wp … bk), occ_w, occ_b, occ, king_w, king_b."""
    b = F.col(board)
    kinds = {"p": "Pp", "n": "Nn", "b": "Bb", "r": "Rr", "q": "Qq", "k": "Kk"}
    out = df.withColumns(
        {f"_s_{k}": _plane(b, m) for k, m in kinds.items()} | {"occ_w": _plane(b, "PNBRQK")}
    )
    c = F.col
    out = out.withColumns(
        {f"w{k}": B.both(c(f"_s_{k}"), c("occ_w")) for k in kinds}
        | {f"b{k}": B.minus(c(f"_s_{k}"), c("occ_w")) for k in kinds}
    ).drop(*[f"_s_{k}" for k in kinds])
    out = out.withColumn("occ_b", B.either(*[c(f"b{k}") for k in kinds]))
    return out.withColumns(
        {
            "occ": B.either(c("occ_w"), c("occ_b")),
            "king_w": B.highest(c("wk")),
            "king_b": B.highest(c("bk")),
        }
    )


def own(kind: str, white: bool) -> Column:
    return F.col(("w" if white else "b") + kind)


def counts(white: bool) -> dict[str, Column]:
    return {k: B.count(own(k, white)) for k in "pnbrqk"}


# --- attack edges -------------------------------------------------------------------------------
_STEPS = {
    "N": [(1, 2), (2, 1), (2, -1), (1, -2), (-1, -2), (-2, -1), (-2, 1), (-1, 2)],
    "K": [(1, 0), (1, 1), (0, 1), (-1, 1), (-1, 0), (-1, -1), (0, -1), (1, -1)],
    "P": [(-1, 1), (1, 1)],
    "p": [(-1, -1), (1, -1)],
}
_LINES = {"R": _STEPS["K"][0::2], "B": _STEPS["K"][1::2], "Q": _STEPS["K"]}


_KINDS = {"P": 0, "p": 1, "N": 2, "B": 3, "R": 4, "Q": 5, "K": 6}


def ray_table(spark) -> DataFrame:
    """slot, to, between: every pair of squares a piece could see, and the squares between.

    `slot` is 64·kind + from-square. A fixed table of a few thousand rows built by rule; it does not
    depend on the data.
    """
    rows = []
    for s in range(64):
        f, r = s % 8, s // 8
        for kind, deltas in _STEPS.items():
            for df, dr in deltas:
                if 0 <= f + df < 8 and 0 <= r + dr < 8:
                    rows.append((_KINDS[kind] * 64 + s, (r + dr) * 8 + f + df, 0))
        for kind, lines in _LINES.items():
            for df, dr in lines:
                passed, x, y = 0, f + df, r + dr
                while 0 <= x < 8 and 0 <= y < 8:
                    rows.append((_KINDS[kind] * 64 + s, y * 8 + x, B.signed(passed)))
                    passed |= 1 << (y * 8 + x)
                    x, y = x + df, y + dr
    return spark.createDataFrame(rows, "slot int, to int, between bigint")


def _seen_pairs(df: DataFrame, keep: list[str], board: str) -> DataFrame:
    rays = ray_table(df.sparkSession)
    letter = F.when(F.col("piece") == "p", F.col("piece")).otherwise(F.upper("piece"))
    kind = F.instr(F.lit("PpNBRQK"), letter) - 1
    p = pieces(df, keep, board).withColumn("slot", kind * 64 + F.col("sq"))
    return p.withColumnRenamed("sq", "frm").join(F.broadcast(rays), "slot")


def attack_edges(df: DataFrame, key: list[str], carry: tuple[str, ...] = (), board: str = "board") -> DataFrame:
    """key, carry…, frm, piece, color, to, target: every square every piece attacks or defends.

    `df` needs `occ` (with_sets). Rows are hashed by the position key first, while a position is one
    row, so later grouping per position or per (position, square) shuffles nothing more.
    """
    keep = list(dict.fromkeys([*key, *carry, board, "occ"]))
    spread = df.select(*keep).repartition(*key)
    seen = _seen_pairs(spread, keep, board).where(B.both(F.col("between"), F.col("occ")) == 0)
    return seen.select(
        *key, *[c for c in carry if c not in key], "frm", "piece", "color", "to",
        _char(F.col(board), F.col("to")).alias("target"),
    )


def pins(df: DataFrame, key: list[str], board: str = "board") -> DataFrame:
    """Absolute pins: key, sq, piece, color, pinner, pinner_sq.

    A line from an enemy slider to the king with exactly one piece between, of the king's colour.
    """
    keep = list(dict.fromkeys([*key, board, "occ", "occ_w", "occ_b", "king_w", "king_b"]))
    lines = _seen_pairs(df.select(*keep), keep, board).where(F.upper("piece").isin("R", "B", "Q"))
    king = F.when(F.col("color") == "white", F.col("king_b")).otherwise(F.col("king_w"))
    mine = F.when(F.col("color") == "white", F.col("occ_b")).otherwise(F.col("occ_w"))
    shield = B.both(F.col("between"), F.col("occ"))
    held = lines.where(
        (F.col("to") == king) & (B.count(shield) == 1) & (B.both(shield, mine) != 0)
    ).withColumn("sq", B.highest(shield))
    return held.select(
        *key, "sq", _char(F.col(board), F.col("sq")).alias("piece"),
        F.when(F.col("color") == "white", F.lit("black")).otherwise(F.lit("white")).alias("color"),
        F.col("piece").alias("pinner"), F.col("frm").alias("pinner_sq"),
    )
