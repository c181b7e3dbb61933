"""Experiment reports: configuration labels, per-game roll-up, reliance, cross tables, arm pairs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.functions import names
from rookery.functions.numeric import fixed_text, half_even, ratio, short_text
from rookery.functions.scoring import side_score


def config_of(meta: DataFrame) -> DataFrame:
    """run_id, config, model, harness, level per run; runs without a rated opponent are dropped."""
    spec = names.subject_spec(F.col("white_spec"), F.col("black_spec"))
    return (
        meta.withColumn("spec", spec)
        .withColumn("level", names.opponent_level(F.col("white_spec"), F.col("black_spec")))
        .where(F.col("level").isNotNull() & F.col("spec").isNotNull())
        .withColumn("harness", names.is_harness(F.col("spec")))
        .withColumn("model", names.model_bucket(F.col("model")))
        .withColumn("config", names.config_label(F.col("model"), F.col("harness"), F.col("ctx_version")))
        .select("run_id", "config", "model", "harness", "level")
    )


def classify_decision(search: str = "search", note: str = "note", san: str = "san",
                      own: str = K.OWN_SOURCE, added: str = K.SEARCH_SOURCE) -> Column:
    """struct of the seven reliance flags; NULL when nothing was searched and the move was free.

    `search.candidates` is an ordered map: among equal priors the first entry is the top one.
    """
    text = F.coalesce(F.col(note), F.lit(""))
    played = F.col(san)
    entries = F.map_entries(F.col(f"{search}.candidates"))
    mine = F.filter(entries, lambda e: e["value"]["source"] == own)
    ranked = F.transform(
        mine,
        lambda e, i: F.struct(
            F.coalesce(e["value"]["prior"], F.lit(0.0)).alias("p"),
            (-i).alias("i"),
            e["key"].alias("k"),
            F.coalesce(e["value"]["vetoed"], F.lit(False)).alias("v"),
            F.coalesce(e["value"]["threat_verified"], F.lit(False)).alias("t"),
        ),
    )
    top = F.array_max(ranked)
    searched = F.coalesce(F.size(entries) > 0, F.lit(False))
    only = text.contains("only legal move")
    decided = F.coalesce(F.col(f"{search}.decided_by"), F.lit(""))
    has = lambda arr: F.coalesce(F.exists(arr, lambda e: e["key"] == played), F.lit(False))
    flag = lambda c: F.coalesce(c, F.lit(False)).cast("int")
    flags = F.struct(
        F.lit(1).alias("moves"),
        flag(top["k"] == played).alias("top_played"),
        flag(top["v"] | top["t"]).alias("top_overruled"),
        has(mine).cast("int").alias("claude_proposed"),
        has(F.filter(entries, lambda e: e["value"]["source"] == added)).cast("int").alias("search_added"),
        text.contains("fail-low").cast("int").alias("fail_low"),
        (only | decided.rlike("^(mate in|only |tablebase)")).cast("int").alias("no_claude_value"),
    )
    return F.when(searched | only, flags)


def reliance_sums(flags: str = "flags") -> list[Column]:
    return [F.coalesce(F.sum(f"{flags}.{k}"), F.lit(0)).alias(k) for k in K.RELIANCE_FLAGS]


def reliance(decisions: DataFrame, group: list[str], **kw) -> DataFrame:
    """Reliance totals per group and the share of each flag as a percentage text."""
    tot = (
        decisions.withColumn("flags", classify_decision(**kw))
        .groupBy(*group)
        .agg(*reliance_sums())
        .where(F.col("moves") > 0)
    )
    shares = [
        F.concat(fixed_text(F.col(k) * 100 / F.col("moves"), 0), F.lit("%")).alias(f"{k}_pct")
        for k in K.RELIANCE_FLAGS[1:]
    ]
    return tot.select("*", *shares)


def experiment_games(
    meta: DataFrame, games: DataFrame, decisions: DataFrame, evals: DataFrame, prefix: str | None = None
) -> DataFrame:
    """One row per decided game: score, mean capped loss, cost, time, reliance totals.

    Decisions and evals are each reduced to (run, game) before they meet the games.
    """
    if prefix:
        meta = meta.where(F.col("run_id").contains(prefix))
    config = config_of(meta)
    keys = ["run_id", "game"]
    foe = lambda c: F.coalesce(F.col(c), F.lit("")).contains(K.LADDER_OPPONENT)
    # only the chosen runs are read and reduced
    decisions, evals = (x.join(config.select("run_id"), "run_id", "left_semi") for x in (decisions, evals))
    spent = (
        decisions.where(~foe("player"))
        .withColumn("flags", classify_decision())
        .groupBy(*keys)
        .agg(
            F.sum(F.coalesce("cost", F.lit(0.0))).alias("cost_usd"),
            F.count(F.lit(1)).alias("claude_moves"),
            F.sum(F.coalesce("seconds", F.lit(0.0))).alias("claude_seconds"),
            *[c for c in reliance_sums()],
        )
    )
    loss = F.least(F.coalesce("cpl", F.lit(0)), F.lit(K.LOSS_CAP))
    accuracy = evals.where(~foe("player")).groupBy(*keys).agg(F.avg(loss).alias("acpl"))
    color = F.when(~foe("white"), F.lit("white")).otherwise(F.lit("black"))
    rel = F.when(F.col("moves") > 0, F.struct(*K.RELIANCE_FLAGS))
    return (
        games.where(F.col("result").isin(*K.DECIDED))
        .join(config, "run_id")
        .join(spent, keys, "left")
        .join(accuracy, keys, "left")
        .withColumn("color", color)
        .select(
            F.col("run_id").alias("run"), "game", "config", "model", "harness", "level", "color",
            "result", side_score(F.col("result"), F.col("color")).alias("score"),
            F.coalesce("termination", F.lit("")).alias("termination"), "plies", "acpl",
            half_even(F.coalesce("cost_usd", F.lit(0.0)), 5).alias("cost_usd"),
            F.coalesce("claude_moves", F.lit(0)).alias("claude_moves"),
            half_even(F.coalesce("claude_seconds", F.lit(0.0)), 1).alias("claude_seconds"),
            rel.alias("reliance"),
        )
    )


def cell_text(score, n, w, d, l) -> Column:
    c = F.col
    return F.concat(
        short_text(c(score)), F.lit("/"), c(n).cast("string"), F.lit(" ("), c(w).cast("string"),
        F.lit("-"), c(d).cast("string"), F.lit("-"), c(l).cast("string"), F.lit(")"),
    )


def crosstab(games: DataFrame, row: str = "config", col: str = "level", score: str = "score") -> DataFrame:
    """Cells of row × col plus the total of every row (col NULL, is_total 1), in one aggregation."""
    s = F.col(score)
    out = games.rollup(row, col).agg(
        F.grouping(col).cast("int").alias("is_total"),
        F.grouping(row).cast("int").alias("_all"),
        F.count(F.lit(1)).alias("games"),
        F.sum(score).alias("score"),
        F.count_if(s == 1.0).alias("w"),
        F.count_if(s == 0.5).alias("d"),
        F.count_if(s == 0.0).alias("l"),
    )
    out = out.where(F.col("_all") == 0).drop("_all")
    return out.withColumn("cell", cell_text("score", "games", "w", "d", "l")).withColumn(
        "score_pct", F.concat(fixed_text(F.col("score") * 100 / F.col("games"), 0), F.lit("%"))
    )


def crosstab_wide(cells: DataFrame, columns: list, row="config", col="level", empty="–") -> DataFrame:
    """One line per row with a text column per level and the total."""
    grid = (
        cells.where("is_total = 0").groupBy(row).pivot(col, columns).agg(F.first("cell"))
        .fillna(empty)
    )
    total = cells.where("is_total = 1").select(
        row, F.concat(short_text(F.col("score")), F.lit("/"), F.col("games").cast("string")).alias("total"),
        "score_pct",
    )
    return grid.join(total, row)


def cost_ratios(games: DataFrame, group: list[str]) -> DataFrame:
    agg = games.groupBy(*group).agg(
        F.count(F.lit(1)).alias("games"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("claude_moves").alias("claude_moves"),
        F.sum("claude_seconds").alias("claude_seconds"),
    )
    return agg.select(
        *group, "games", "cost_usd", "claude_moves",
        (F.col("cost_usd") / F.col("games")).alias("usd_per_game"),
        ratio(F.col("cost_usd"), F.col("claude_moves")).alias("usd_per_move"),
        ratio(F.col("claude_seconds"), F.col("claude_moves")).alias("seconds_per_move"),
    )


def label_sets(df: DataFrame, cols: list[str]) -> DataFrame:
    """Sorted distinct labels of each column, as arrays in one row."""
    return df.agg(*[F.array_sort(F.collect_set(c)).alias(c) for c in cols])


# --- pairs of arms ------------------------------------------------------------------------------
def arm_cells(games: DataFrame, arm="config", level="level", color="color", score="score") -> DataFrame:
    """Everything the arm tests need of the games: counts and sums per (arm, level, colour, score)."""
    return games.groupBy(
        F.col(arm).alias("arm"), F.col(level).alias("level"), F.col(color).alias("color"),
        F.col(score).alias("score"),
    ).agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("cost_usd").alias("cost"),
        F.sum("acpl").alias("acpl_sum"),
        F.count("acpl").alias("acpl_n"),
    )


def common_levels(a: DataFrame, b: DataFrame, key: str = "level") -> DataFrame:
    """Distinct levels present in both frames."""
    return a.select(key).intersect(b.select(key))


def pair_rows(rows: DataFrame, pairs: DataFrame, arm: str = "arm", level: str = "level") -> DataFrame:
    """Rows of both arms of every pair (pair, side a/b), at levels both arms played.

    `pairs` has columns pair, a, b. Use pre-aggregated rows: an arm may take part in many pairs.
    """
    sides = pairs.select(
        "pair",
        F.explode(
            F.array(
                F.struct(F.lit("a").alias("side"), F.col("a").alias(arm)),
                F.struct(F.lit("b").alias("side"), F.col("b").alias(arm)),
            )
        ).alias("_s"),
    ).select("pair", "_s.*")
    both = sides.join(rows, arm)
    shared = (
        both.groupBy("pair", level)
        .agg((F.max(F.col("side") == "a") & F.max(F.col("side") == "b")).alias("_both"))
        .where("_both")
        .select("pair", level)
    )
    return both.join(shared, ["pair", level], "left_semi")


def compare_arms(cells: DataFrame, pairs: DataFrame) -> DataFrame:
    """Per pair: games, mean scores, USD per game, mean loss, extra USD per extra point.

    Pairs without a common level give no row; the last column is NULL unless arm a gains.
    """
    side = lambda name, c: F.sum(F.when(F.col("side") == name, F.col(c)))
    points = lambda name: F.sum(
        F.when(F.col("side") == name, F.col("score") * F.col("n"))
    )
    agg = pair_rows(cells, pairs).groupBy("pair").agg(
        side("a", "n").alias("games_a"), side("b", "n").alias("games_b"),
        points("a").alias("score_a"), points("b").alias("score_b"),
        side("a", "cost").alias("_ca"), side("b", "cost").alias("_cb"),
        F.try_divide(side("a", "acpl_sum"), side("a", "acpl_n")).alias("acpl_a"),
        F.try_divide(side("b", "acpl_sum"), side("b", "acpl_n")).alias("acpl_b"),
    )
    c = F.col
    gain = c("score_a") / c("games_a") - c("score_b") / c("games_b")
    extra = c("_ca") / c("games_a") - c("_cb") / c("games_b")
    return agg.select(
        "pair", "games_a", "games_b", "score_a", "score_b", gain.alias("delta_score"),
        (c("_ca") / c("games_a")).alias("usd_per_game_a"),
        (c("_cb") / c("games_b")).alias("usd_per_game_b"),
        "acpl_a", "acpl_b",
        F.when(gain > 0, extra / gain).alias("usd_per_point"),
    )


def harness_pairs(games: DataFrame) -> DataFrame:
    """The three comparisons of every model: harness, ctx3 harness, ctx3 against the older harness."""
    m = F.col("model")
    pair = lambda name, a, b: F.struct(
        F.concat(m, F.lit(name)).alias("pair"), F.concat(m, F.lit(a)).alias("a"),
        F.concat(m, F.lit(b)).alias("b"),
    )
    rows = F.array(
        pair("", "-harness", "-naive"),
        pair(" ctx3", "-harness-ctx3", "-naive"),
        pair(" ctx3 vs ctx2", "-harness-ctx3", "-harness"),
    )
    return games.select("model").distinct().select(F.explode(rows).alias("_p")).select("_p.*")


def progress(games: DataFrame, decisions: DataFrame, expected: int, elapsed: Column) -> DataFrame:
    """Done games, share done, cost so far and the remaining seconds at the present pace."""
    done = games.agg(F.count(F.lit(1)).alias("done"))
    cost = decisions.agg(F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost"))
    n = F.col("done")
    both = done.withColumn("_k", F.lit(1)).join(cost.withColumn("_k", F.lit(1)), "_k").drop("_k")
    return both.select(
        "done",
        F.lit(expected).alias("expected"),
        (n * 100.0 / F.lit(expected) if expected else F.lit(0.0)).alias("pct"),
        "cost",
        F.when(n > 0, elapsed / n * (F.lit(expected) - n)).alias("eta_seconds"),
    )


def in_progress(progress_rows: DataFrame) -> DataFrame:
    """Games with progress lines and no result line."""
    done = progress_rows.where("done").select("file", "game")
    return progress_rows.where(F.col("ply").isNotNull()).join(done, ["file", "game"], "left_anti")


def label_union(a: DataFrame, b: DataFrame, col: str) -> DataFrame:
    return a.select(col).union(b.select(col)).distinct()


def key_intersect(a: DataFrame, b: DataFrame, key: str) -> DataFrame:
    return a.select(key).intersect(b.select(key))


def union_runs(*frames: DataFrame) -> DataFrame:
    """Rows of several runs; columns missing in older runs are NULL."""
    out = frames[0]
    for df in frames[1:]:
        out = out.unionByName(df, allowMissingColumns=True)
    return out
