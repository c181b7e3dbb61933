"""Experiment reports: aggregated in Spark, only result tables reach the driver."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.operators import experiments as ex
from rookery.operators import rating as ra
from rookery.operators import significance as sig
from rookery.plans.ingest import read_runs
from rookery.session import shared_dir
from rookery.sources.sinks import write_games_csv, write_text


def config_table(games: DataFrame, bootstrap: int = 1000) -> DataFrame:
    """One row per configuration: games, score, rating with interval, mean loss, cost ratios."""
    total = games.groupBy("config").agg(F.sum("score").alias("score"), F.avg("acpl").alias("acpl"))
    elo = ra.elo_mle(games, ["config"]).select("config", "elo")
    ci = ra.bootstrap_ci(games, ["config"], n=bootstrap)
    return (
        ex.cost_ratios(games, ["config"]).join(total, "config").join(elo, "config").join(ci, "config")
    )


def loss_rows(games: DataFrame, pairs: DataFrame) -> DataFrame:
    """Games at the common levels of all games of a pair; only then are those without a loss left out."""
    return ex.pair_rows(games, pairs, arm="config").where("acpl IS NOT NULL")


def tests_table(games: DataFrame, pairs: DataFrame, permutations: int = 20000) -> DataFrame:
    """One row per pair of arms with common levels: effect, the three tests, cost of a point."""
    cells = ex.arm_cells(games)
    ranks = sig.mann_whitney(loss_rows(games, pairs), ["pair"], "side", "acpl", width=4.0)
    return (
        ex.compare_arms(cells, pairs).drop("delta_score")
        .join(sig.permutation_test(cells, pairs, n=permutations).select("pair", "delta_score", F.col("p").alias("p_permutation")), "pair")
        .join(sig.lr_test(cells, pairs).select("pair", "elo_a", "elo_b", F.col("stat").alias("lr_stat"), F.col("p").alias("p_lr")), "pair")
        .join(ranks.select("pair", F.col("p").alias("p_mann_whitney")), "pair", "left")
    )


def reliance_table(games: DataFrame) -> DataFrame:
    sums = [F.sum(f"reliance.{k}").alias(k) for k in K.RELIANCE_FLAGS]
    return games.where("reliance IS NOT NULL").groupBy("config").agg(*sums).where("moves > 0")


def report(spark: SparkSession, root: str, prefix: str, out: str, bootstrap: int = 1000,
           permutations: int = 20000) -> dict:
    """Write crosstable, games CSV and stats JSON below `out`; returns the statistics."""
    src = read_runs(spark, root)
    staged = shared_dir(spark, "games")
    ex.experiment_games(
        src["meta"], src["games"], src["decisions"], src["evals"], prefix
    ).write.mode("overwrite").parquet(staged)
    games = spark.read.parquet(staged)
    write_games_csv(games, f"{out}/games")
    stats, text = summarise(games, prefix, bootstrap, permutations)
    one = lambda body: spark.createDataFrame([(body,)], "value string").coalesce(1)
    write_text(one(text), f"{out}/crosstable")
    write_text(one(json.dumps(stats, indent=2)), f"{out}/stats")
    return stats


def summarise(games: DataFrame, prefix: str, bootstrap: int, permutations: int) -> tuple[dict, str]:
    """(statistics, markdown) of experiment games; collects tables with one row per result line."""
    pairs = ex.harness_pairs(games)
    cells = ex.crosstab(games).where("is_total = 0").collect()
    configs = config_table(games, bootstrap).orderBy("config").collect()
    tests = tests_table(games, pairs, permutations).orderBy("pair").collect()
    rel = reliance_table(games).orderBy("config").collect()
    levels = sorted({r.level for r in cells})
    grid = {(r.config, r.level): r.cell for r in cells}
    dash = lambda v, spec: "–" if v is None else format(v, spec)
    lines = [
        f"# Experiment `{prefix}`", "", "Cell = score / games (W-D-L) of the subject.", "",
        "| config | " + " | ".join(f"level {x}" for x in levels)
        + " | total | score % | rating (95% CI) | mean loss | cost $ | $/game | $/move | s/move |",
        "|---|" + "---|" * (len(levels) + 8),
    ]
    stats: dict = {"configs": {}, "tests": {}}
    for r in configs:
        row = [grid.get((r.config, x), "–") for x in levels]
        row += [
            f"{r.score:g}/{r.games}", f"{100 * r.score / r.games:.0f}%", f"{r.elo} ({r.lo95}–{r.hi95})",
            dash(r.acpl, ".0f"), f"{r.cost_usd:.2f}", f"{r.usd_per_game:.3f}", f"{r.usd_per_move:.4f}",
            f"{r.seconds_per_move:.1f}",
        ]
        lines.append(f"| {r.config} | " + " | ".join(row) + " |")
        stats["configs"][r.config] = {
            "games": r.games, "score": r.score, "elo": r.elo, "elo_ci95": [r.lo95, r.hi95], "acpl": r.acpl,
            "cost_usd": r.cost_usd, "usd_per_game": r.usd_per_game, "usd_per_move": r.usd_per_move,
            "claude_moves": r.claude_moves, "seconds_per_move": r.seconds_per_move,
        }
    lines += [
        "", "## Paired arms", "",
        "| A vs B (levels both played) | Δ mean score | permutation p | rating B → A | LR χ² | LR p "
        "| mean loss B → A | Mann-Whitney p | $/game B → A | extra $ per extra point |",
        "|" + "---|" * 10,
    ]
    for r in tests:
        p_mw = float("nan") if r.p_mann_whitney is None else r.p_mann_whitney
        lines.append(
            f"| {r.pair} ({r.games_a} vs {r.games_b} games) | {r.delta_score:+.2f} | {r.p_permutation:.4f} | "
            f"{r.elo_b} → {r.elo_a} | {r.lr_stat:.1f} | {r.p_lr:.2g} | {dash(r.acpl_b, '.0f')} → {dash(r.acpl_a, '.0f')} | "
            f"{p_mw:.2g} | {r.usd_per_game_b:.3f} → {r.usd_per_game_a:.3f} | {dash(r.usd_per_point, '.2f')} |"
        )
        stats["tests"][r.pair] = {
            "games": [r.games_a, r.games_b], "delta_score": r.delta_score, "p_permutation": r.p_permutation,
            "lr_stat": r.lr_stat, "p_lr": r.p_lr, "p_mann_whitney_acpl": p_mw,
        }
    if rel:
        lines += ["", "## Reliance on search", "", "| config | moves | " + " | ".join(K.RELIANCE_FLAGS[1:]) + " |",
                  "|" + "---|" * (len(K.RELIANCE_FLAGS) + 1)]
        for r in rel:
            shares = " | ".join(f"{100 * r[k] / r.moves:.0f}%" for k in K.RELIANCE_FLAGS[1:])
            lines.append(f"| {r.config} | {r.moves} | {shares} |")
            stats["configs"][r.config]["reliance"] = {k: r[k] for k in K.RELIANCE_FLAGS}
    return stats, "\n".join(lines) + "\n"


def render_run(players: DataFrame, games: DataFrame, title: str = "Match report") -> str:
    """Markdown of one run's summary (leaderboard.run_summary rows and its game list)."""
    lines = [
        f"# {title}", "", "## Players", "",
        "| player | G | W | D | L | score | mean loss | inacc | mist | blund | illegal rate | forfeits "
        "| calls/move | cost $ | s/move | rough rating |", "|" + "---|" * 16,
    ]
    for p in players.orderBy(F.desc("score"), "player").collect():
        lines.append(
            f"| {p.player} | {p.games} | {p.w} | {p.d} | {p.l} | {p.score}/{p.games} | {p.acpl} | {p.inaccuracies} | "
            f"{p.mistakes} | {p.blunders} | {p.illegal_rate:.1%} | {p.forfeits} | {p.calls_per_move} | {p.cost_usd:.4f} | "
            f"{p.avg_seconds} | {p.rough_elo} |"
        )
    lines += ["", "## Games", "", "| # | white | black | result | termination | opening |", "|" + "---|" * 6]
    for g in games.orderBy("round").collect():
        lines.append(f"| {g['round']} | {g.white} | {g.black} | {g.result} | {g.termination} | {g.opening} |")
    return "\n".join(lines) + "\n"
