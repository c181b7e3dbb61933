"""Ply-ordered operators. All of them cut hot keys into chunks (see operators.ordered)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.functions.numeric import clamp
from rookery.operators.ordered import (
    _cols, _join_carry, _with_chunk, first, last_seen, neighbour, ordinal,
)

PLIES_PER_CHUNK = 1024


def ply_chunk(ply: str = "ply", size: int = PLIES_PER_CHUNK) -> list[Column]:
    return [F.floor(F.col(ply) / F.lit(size))]


def terminal_eval(value: Column, outcome: Column) -> Column:
    """Evaluation for the side to move, exact in finished positions."""
    return (
        F.when(outcome == "checkmate", F.lit(-K.MATE_CP))
        .when(outcome.isin("stalemate", "insufficient"), F.lit(0))
        .otherwise(value)
    )


def move_loss(
    evals: DataFrame,
    keys: list[str],
    order: list,
    value: str = "eval",
    chunk: list[Column] | None = None,
    skip: Column | None = None,
    cap: int = K.LOSS_CAP,
) -> DataFrame:
    """eval_before, eval_after and loss per move out of one evaluation per position.

    Evaluations are those of the side to move, so the mover's view after the move is minus the next
    one. The final position has no move and gives no row; `skip` marks book plies.
    """
    chunk = chunk or ply_chunk()
    out = neighbour(evals, keys, order, chunk, {"_next": F.col(value), "_there": F.lit(True)})
    before, after = F.col(value), -F.col("_next")
    out = out.where(F.col("_there")).select(
        *evals.columns,
        before.alias("eval_before"),
        after.alias("eval_after"),
        clamp(before - after, 0, cap).alias("cp_loss"),
    )
    return out.where(~skip) if skip is not None else out


def streaks(
    df: DataFrame, keys: list[str], order: list, side: Column, chunk: list[Column], name: str = "streak"
) -> DataFrame:
    """Length of the run of equal non-zero `side` values that ends at the row; 0 where side is 0/NULL.

    Runs are measured inside a chunk; the run open at the end of the previous chunks is carried in
    for the first run of a chunk when the side is the same.
    """
    cols = df.columns
    base = _with_chunk(df.withColumn("_side", F.coalesce(side, F.lit(0))), chunk)
    local = Window.partitionBy(*keys, "_chunk").orderBy(*_cols(order))
    sofar = local.rowsBetween(Window.unboundedPreceding, 0)
    base = base.withColumn("_pos", F.row_number().over(local)).withColumn(
        "_turn", F.coalesce(F.lag("_side").over(local) != F.col("_side"), F.lit(True))
    )
    base = base.withColumn(
        "_start", F.last(F.when(F.col("_turn"), F.col("_pos")), ignorenulls=True).over(sofar)
    ).withColumn("_len", F.col("_pos") - F.col("_start") + 1)

    ends = base.groupBy(*keys, "_chunk").agg(
        F.max("_pos").alias("_n"),
        F.max_by("_side", "_pos").alias("_end_side"),
        F.max_by("_len", "_pos").alias("_tail"),
    )
    per_key = Window.partitionBy(*keys).orderBy("_chunk")
    upto = per_key.rowsBetween(Window.unboundedPreceding, 0)
    goes_on = (F.col("_tail") == F.col("_n")) & (F.lag("_end_side").over(per_key) == F.col("_end_side"))
    ends = ends.withColumn("_on", F.coalesce(goes_on, F.lit(False))).withColumn(
        "_grp", F.sum(F.when(F.col("_on"), 0).otherwise(1)).over(upto)
    )
    in_grp = (
        Window.partitionBy(*keys, "_grp").orderBy("_chunk").rowsBetween(Window.unboundedPreceding, 0)
    )
    ends = ends.withColumn("_open", F.sum("_tail").over(in_grp))
    carry = ends.select(
        *keys, "_chunk",
        F.lag("_open").over(per_key).alias("_in"),
        F.lag("_end_side").over(per_key).alias("_in_side"),
    )
    joined = _join_carry(base, carry, keys)
    extra = F.when(
        (F.col("_start") == 1) & (F.col("_in_side") == F.col("_side")), F.col("_in")
    ).otherwise(F.lit(0))
    return joined.select(
        *cols,
        F.when(F.col("_side") != 0, F.col("_len") + F.coalesce(extra, F.lit(0)))
        .otherwise(F.lit(0))
        .cast("bigint")
        .alias(name),
    )


def side_of(value: Column, threshold) -> Column:
    """+1 at or above the threshold, −1 at or below its negative, else 0."""
    return F.when(value >= threshold, 1).when(value <= -threshold, -1).otherwise(0)


def resign_points(
    df: DataFrame, keys: list[str], order: list, value: str, threshold, k: int, chunk: list[Column]
) -> DataFrame:
    """First row of each key whose streak beyond the threshold reaches k."""
    marked = streaks(df, keys, order, side_of(F.col(value), threshold), chunk)
    return first(marked.where(F.col("streak") >= k), keys, order)


def history(df: DataFrame, moves: str = "sans", ply: str = "ply", name: str = "history") -> DataFrame:
    """Moves played before the decision at `ply`, from the game's move array in the same row."""
    return df.withColumn(name, F.slice(F.col(moves), F.lit(1), F.greatest(F.col(ply) - 1, F.lit(0))))


def tail(array: Column, n: int = 12) -> Column:
    return F.slice(array, F.greatest(F.size(array) - (n - 1), F.lit(1)), F.lit(n))


def tail_text(array: Column, n: int = 12) -> Column:
    """Last n moves with move numbers, `... ` in front when moves were left out."""
    first_ply = F.greatest(F.size(array) - n, F.lit(0))
    words = F.transform(
        tail(array, n),
        lambda m, i: F.when(
            (first_ply + i) % 2 == 0,
            F.concat(F.floor((first_ply + i) / 2 + 1).cast("string"), F.lit(". "), m),
        )
        .when(i == 0, F.concat(F.floor((first_ply + i) / 2 + 1).cast("string"), F.lit("..."), m))
        .otherwise(m),
    )
    mark = F.when(F.size(array) > n, F.lit("... ")).otherwise(F.lit(""))
    return F.concat(mark, F.array_join(words, " "))


def margin_filter(df: DataFrame, group: list[str], score: str, margin) -> DataFrame:
    """Rows within `margin` of the best score of their group.

    The best per group is a map-side aggregate joined back, so a hot group stays spread.
    """
    best = df.groupBy(*group).agg(F.max(score).alias("_best"))
    return df.join(best, group).where(F.col(score) >= F.col("_best") - margin).drop("_best")


def carry_forward(df, keys, order, value: Column, name, chunk) -> DataFrame:
    return last_seen(df, keys, order, chunk, value, name)


def repetitions(df: DataFrame, game: list[str], key: str, order: list, chunk: list[Column]) -> DataFrame:
    """How often the position key has occurred in the game so far (3 = threefold)."""
    return ordinal(df, [*game, key], order, chunk, "occurrence")


def skip_after_abort(
    games: DataFrame, run: str, order: str, aborted: Column, name: str = "skipped"
) -> DataFrame:
    """Flag games of a run that come after its first aborted game."""
    firsts = games.where(aborted).groupBy(run).agg(F.min(order).alias("_first"))
    return games.join(firsts, run, "left").select(
        *games.columns, F.coalesce(F.col(order) > F.col("_first"), F.lit(False)).alias(name)
    )
