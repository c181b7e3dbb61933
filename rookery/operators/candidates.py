"""Logged candidate lists: which moves a player proposed, in what order, with what score."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.functions.numeric import clamp


def with_move(decisions: DataFrame, san: str = "san") -> DataFrame:
    """Decisions that led to a move."""
    return decisions.where(F.col(san).isNotNull() & (F.col(san) != ""))


def own_eval(candidates: Column, san: Column) -> Column:
    """Score of the played move in the candidate list: the first one that is known."""
    hits = F.filter(candidates, lambda c: (c["san"] == san) & c["score_cp"].isNotNull())
    return F.try_element_at(hits, F.lit(1))["score_cp"]


def own_candidates(search: Column, candidates: Column, san: Column, own: str = K.OWN_SOURCE) -> Column:
    """Moves proposed by the player: searched ones of its own, else the list, else the played move."""
    nothing = F.array().cast("array<string>")
    return (
        F.when(F.size(search) > 0, F.map_keys(F.map_filter(search, lambda k, v: v["source"] == own)))
        .when(F.size(candidates) > 0, F.transform(candidates, lambda c: c["san"]))
        .when(san.isNotNull() & (san != ""), F.array(san))
        .otherwise(nothing)
    )


def contains_move(moves: Column, san: Column) -> Column:
    return F.coalesce(F.array_contains(moves, san), F.lit(False))


def normalise_candidates(
    items: DataFrame, keys: list[str], item: str, order: list[str], n: int, legal: str | None = None
) -> DataFrame:
    """Proposed moves, cleaned: keys, move, reason, prior, rank.

    One row per proposed item (JSON text: a bare string or an object). Junk and, with a `legal`
    array column, moves outside it are dropped; priors are clamped to [0, 1] and unreadable ones are
    0; a repeated move keeps its first item; the n best priors stay, ties in proposal order.
    """
    text = F.ltrim(F.col(item))
    as_object = F.when(text.startswith('"'), F.concat(F.lit('{"move":'), text, F.lit("}"))).when(
        text.startswith("{"), text
    )
    # one parse per item, in its own projection
    staged = items.select(
        *keys, *order, *([legal] if legal else []),
        F.from_json(as_object, "move string, prior string, reason string").alias("_o"),
    )
    parsed = staged.select(
        *keys, *order, *([legal] if legal else []), F.col("_o.move").alias("move"),
        F.coalesce("_o.reason", F.lit("")).alias("reason"),
        clamp(F.coalesce(F.col("_o.prior").try_cast("double"), F.lit(0.0)), 0.0, 1.0).alias("prior"),
    ).where(F.col("move").isNotNull() & (F.col("move") != ""))
    if legal:
        parsed = parsed.where(F.array_contains(F.col(legal), F.col("move"))).drop(legal)
    # one shuffle by decision; the rest happens in the row, whose items the log format bounds
    listed = parsed.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct(*order, "move", "reason", "prior"))).alias("_i"))
    earlier = lambda i: F.slice(F.transform("_i", lambda x: x["move"]), F.lit(1), i)
    once = F.filter("_i", lambda x, i: ~F.array_contains(earlier(i), x["move"]))
    weighed = F.transform(once, lambda x, i: F.struct((-x["prior"]).alias("_p"), i.alias("_n"), x.alias("x")))
    best = F.slice(F.array_sort(weighed), 1, n)
    ranked = listed.select(*keys, F.posexplode(best).alias("_k", "_b"))
    return ranked.select(
        *keys, "_b.x.move", "_b.x.reason", "_b.x.prior", (F.col("_k") + 1).alias("rank")
    )
