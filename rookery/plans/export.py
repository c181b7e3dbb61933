"""Training-data export of run folders: positions, raw calls, chat examples, preference pairs."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rookery.operators import boards, context
from rookery.operators import training as tr
from rookery.plans.ingest import read_runs
from rookery.session import shared_dir
from rookery.sources.sinks import write_jsonl, write_text


def export(spark: SparkSession, root: str, out: str, with_context: bool = False) -> dict:
    """Write the four sinks, the card and stats.json below `out`; returns the statistics.

    Positions are written once to a table in the shared folder and read back by the other sinks, so
    the joins run once and a lost executor costs no recomputation of the whole plan.
    """
    src = read_runs(spark, root, include_invalid=False)
    staged = shared_dir(spark, "positions")
    tr.build_positions(
        src["decisions"], src["evals"], src["games"], src["traces"], src["meta"], src["pgn"]
    ).write.mode("overwrite").parquet(staged)
    positions = spark.read.parquet(staged)
    calls = tr.build_calls(positions, src["traces"])
    written = positions
    if with_context:
        written = with_facts(positions)
    sft = tr.sft(written, "facts" if with_context else None)
    prefs = tr.preferences(positions)
    write_jsonl(positions, f"{out}/positions")
    write_jsonl(calls, f"{out}/calls", compression="gzip")
    write_jsonl(sft, f"{out}/sft")
    write_jsonl(prefs, f"{out}/preferences")
    row = tr.dataset_stats(positions, calls, sft, prefs).first().asDict()
    stats = {
        "positions": row["positions"], "calls": row["calls"], "sft": row["sft"],
        "preference_pairs": row["preference_pairs"],
        "runs": [r.run_id for r in tr.dataset_runs(positions).collect()],  # one short name per run
        "splits": {s: row[s] for s in ("train", "val", "test")},
        "positions_with_full_traces": row["positions_with_full_traces"],
        "sft_cp_loss_lt_100": row["sft_cp_loss_lt_100"],
    }
    text = lambda name, body: write_text(
        spark.createDataFrame([(body,)], "value string").coalesce(1), f"{out}/{name}"
    )
    text("card", render_card(stats))
    text("stats", json.dumps(stats, indent=2))
    return stats


def with_facts(positions: DataFrame) -> DataFrame:
    """Positions with the rendered facts of their board as `facts`."""
    parsed = boards.parse_fen(positions.select("id", "fen"))
    facts = context.render_facts(context.position_features(parsed)).select("id", "facts")
    return positions.join(facts, "id", "left")


def render_card(stats: dict) -> str:
    return "\n".join(
        [
            "# Reasoning dataset",
            "",
            "## Counts",
            "```",
            json.dumps(stats, indent=2),
            "```",
            "",
            "## Files",
            "- `positions`: one row per decision (position, history, agent replies, search facts, labels).",
            "- `calls` (gzip): raw calls keyed by `position_id`.",
            "- `sft`: system / user / assistant messages and `quality`.",
            "- `preferences`: prompt / chosen / rejected / refutation; the chosen move lost under 100.",
            "",
            "## Splits",
            "By game: sha1(run_id:game) mod 10 is 0 for test, 1 for val, else train.",
            "",
            "## Caveats",
            "- Only `[verified]` remarks are facts; other reasons are opinions.",
            "- Filter on `quality.cp_loss` before training on the moves themselves.",
        ]
    )


def render_timeline(spark: SparkSession, root: str) -> DataFrame:
    """Every ply of every game with decision, replies and evaluation, for a viewer."""
    from rookery.operators.store import plies_of

    src = read_runs(spark, root)
    keys = ("run_id", "game", "ply")
    evals = src["evals"].select(*keys, "color", "cpl", "eval_after", "best_move")
    decisions = src["decisions"].select(*keys, "player", "note", "calls", "cost", "seconds")
    from rookery.functions.scoring import plot_value, white_view

    out = tr.timeline(plies_of(src["pgn"]), decisions, src["traces"], evals, keys)
    ev = white_view(F.col("e_color"), F.col("e_eval_after"))
    return out.withColumn("white_eval", ev).withColumn("plot", plot_value(ev))
