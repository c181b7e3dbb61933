"""Scalar rules on results, losses and scores."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.functions.numeric import clamp, half_even


def is_aborted(result: Column, termination: Column) -> Column:
    """No decided result, or a termination text that says the game was aborted."""
    return ~F.coalesce(result.isin(*K.DECIDED), F.lit(False)) | F.coalesce(
        termination.startswith(K.ABORTED_PREFIX), F.lit(False)
    )


def side_score(result: Column, color: Column) -> Column:
    """1 / 0.5 / 0 for the side named by `color`; NULL when the game is undecided."""
    won = (result == "1-0") == (color == "white")
    return (
        F.when(result == "1/2-1/2", F.lit(0.5))
        .when(result.isin("1-0", "0-1"), F.when(won, F.lit(1.0)).otherwise(F.lit(0.0)))
    )


def band(value: Column, bands=K.LOSS_BANDS, default: str | None = "ok") -> Column:
    """Name of the highest band whose lower bound is reached; NULL stays NULL."""
    out = F.when(value.isNull(), F.lit(None).cast("string"))
    for bound, name in sorted(bands, reverse=True):
        out = out.when(value >= bound, F.lit(name))
    return out.otherwise(F.lit(default))


def rough_elo(mean_loss: Column) -> Column:
    return half_even(F.exp(mean_loss * -0.01) * 3100).cast("int")


def adjudication_cp(termination: Column) -> Column:
    """Signed centipawns out of an adjudication text, NULL when there are none."""
    return F.regexp_extract(termination, r"SF eval ([+-]\d+)cp", 1).try_cast("int")


def termination_kind(termination: Column) -> Column:
    """First word of the termination text."""
    return F.split_part(F.trim(termination), F.lit(" "), F.lit(1))


def adjudicate(cp: Column, threshold: int = K.ADJUDICATION_CP) -> Column:
    return (
        F.when(cp >= threshold, F.lit("1-0"))
        .when(cp <= -threshold, F.lit("0-1"))
        .when(cp.isNotNull(), F.lit("1/2-1/2"))
    )


def white_view(color: Column, value: Column) -> Column:
    return F.when(color == "white", value).otherwise(-value)


def plot_value(white_eval: Column, cap: int = K.PLOT_CAP) -> Column:
    return clamp(F.coalesce(white_eval, F.lit(0)), -cap, cap)


def score_wording(cp: Column) -> Column:
    """Mover's material outcome in words."""
    pawns = F.format_string("%.1f", half_even(F.abs(cp) / F.lit(100.0), 1))
    return (
        F.when(cp.isNull(), F.lit("?"))
        .when(cp >= K.MATE_WORDING, F.lit("mates"))
        .when(cp <= -K.MATE_WORDING, F.lit("gets mated"))
        .when(cp == 0, F.lit("material level"))
        .otherwise(
            F.concat(F.when(cp > 0, F.lit("wins ")).otherwise(F.lit("loses ")), pawns, F.lit(" pawns"))
        )
    )


def expected_score(own: Column, opponent: Column) -> Column:
    return F.lit(1.0) / (F.pow(F.lit(10.0), (opponent - own) / 400.0) + 1.0)


def score_to_diff(share: Column, eps: float = 0.01) -> Column:
    """Rating difference that yields a score share, the share kept inside [eps, 1-eps]."""
    p = clamp(share, eps, 1.0 - eps)
    return F.log10(F.lit(1.0) / p - 1.0) * -400.0


def is_outage(message: Column) -> Column:
    return F.lower(message).rlike("|".join(K.OUTAGE_MARKERS))


def token_cost(model: Column, tokens_in: Column, tokens_out: Column, prices=K.TOKEN_PRICES) -> Column:
    """USD of one call; first price row whose name occurs in the model name, else 0."""
    out = None
    for name, price_in, price_out in prices:
        cost = (tokens_in * F.lit(price_in) + tokens_out * F.lit(price_out)) / 1e6
        out = (
            F.when(model.contains(name), cost) if out is None else out.when(model.contains(name), cost)
        )
    return out.otherwise(F.lit(0.0))


def skip_known_illegal(illegal_attempts: Column) -> Column:
    """1 when a decision carries at least one illegal attempt."""
    return (F.coalesce(F.size(illegal_attempts), F.lit(0)) > 0).cast("int")
