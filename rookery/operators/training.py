"""Training-data rows: positions, raw calls, chat examples, preference pairs, statistics.

Splits are by game, so near-identical positions of one game never leak between splits.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery import constants as K
from rookery.functions import names
from rookery.functions.bits import let
from rookery.functions.scoring import score_wording, side_score
from rookery.functions.splits import group_split
from rookery.functions.text import extract_json
from rookery.operators.boards import fence
from rookery.operators.candidates import with_move
from rookery.operators.ordered import latest
from rookery.operators.windows import tail_text

KEYS = ["run_id", "game", "ply"]
_REPLY = (
    "thinking string, candidates array<struct<move:string,reason:string,prior:double>>, "
    "threats array<string>, hanging array<string>, board string"
)
_NOTES = "array<struct<fen:string,data:string>>"
CALL_FIELDS = (
    "call", "role", "model", "fen", "prompt", "response", "cost_usd", "seconds", "input_tokens",
    "output_tokens",
)


def join_evals(decisions: DataFrame, evals: DataFrame, keys=tuple(KEYS)) -> DataFrame:
    """Decisions with the last eval of their key, if any, as struct `eval`."""
    keys = list(keys)
    rest = [c for c in evals.columns if c not in keys and c != "_seq"]
    one = latest(evals, keys, ["_seq"]) if "_seq" in evals.columns else evals
    return decisions.join(one.select(*keys, F.struct(*rest).alias("eval")), keys, "left")


def join_results(decisions: DataFrame, games: DataFrame, keys=("run_id", "game")) -> DataFrame:
    """Decisions with the result of their game as `result`."""
    keys = list(keys)
    one = latest(games, keys, ["_seq"]) if "_seq" in games.columns else games
    return decisions.join(one.select(*keys, "result"), keys, "left")


def attach_traces(
    decisions: DataFrame, traces: DataFrame, keys=tuple(KEYS), order: str = "call"
) -> DataFrame:
    """Decisions with the calls of their key as one array `traces`, in call order.

    A group is the calls of one decision, a handful of rows by construction of the log.
    """
    keys = list(keys)
    rest = [c for c in traces.columns if c not in (*keys, "_seq")]
    seq = F.col("_seq") if "_seq" in traces.columns else F.lit(0)
    item = F.struct(
        F.coalesce(F.col(order), F.lit(0)).alias("_o"), seq.alias("_s"), F.struct(*rest).alias("t")
    )
    grouped = traces.groupBy(*keys).agg(F.array_sort(F.collect_list(item)).alias("_t"))
    grouped = grouped.select(*keys, F.transform("_t", lambda x: x["t"]).alias("traces"))
    return decisions.join(grouped, keys, "left")


def histories(decisions: DataFrame, games: DataFrame) -> DataFrame:
    """history_uci of every logged (run, game, ply): the moves of plies 1 … ply − 1.

    A ply that was logged again counts with its last line; book moves by opening name fill the first
    plies. The history is NULL where a ply is missing, and never shifted. A game is capped in length
    by the referee, so its moves fit in a row.
    """
    spark = decisions.sparkSession
    book = spark.createDataFrame(list(K.BOOK_STARTS), "opening string, line string")
    opening = games.join(F.broadcast(book), "opening", "left").select(  # eight fixed rows
        "run_id", "game",
        F.slice(F.split(F.coalesce("line", F.lit("")), " "), F.lit(1),
                F.coalesce("book_plies", F.lit(0))).alias("_book"),
    )
    seq = F.col("_seq") if "_seq" in decisions.columns else F.lit(0)
    logged = latest(
        decisions.where("uci is not null and ply is not null")
        .select("run_id", "game", F.col("ply").cast("int").alias("ply"), "uci", seq.alias("_seq")),
        ["run_id", "game", "ply"], ["_seq", "uci"],
    )
    lines = logged.groupBy("run_id", "game").agg(
        F.map_from_entries(F.collect_list(F.struct("ply", "uci"))).alias("_moves")
    ).join(opening, ["run_id", "game"], "left")
    plies = decisions.where("ply is not null").select("run_id", "game", "ply").distinct()
    before = F.transform(
        F.sequence(F.lit(1), F.col("ply").cast("int") - 1),
        lambda p: F.coalesce(F.try_element_at("_moves", p), F.get("_book", p - 1)),
    )
    history = F.when(F.col("ply") <= 1, F.array().cast("array<string>")).when(
        ~F.exists(before, lambda m: m.isNull()), before
    )
    return plies.join(lines, ["run_id", "game"], "left").select("run_id", "game", "ply", history.alias("history_uci"))


def agents(traces: Column, logged: Column) -> Column:
    """Parsed output of every agent call of one decision.

    `traces` is array<struct(role, fen, parsed, …)> in call order, `parsed` being the JSON object
    text of the reply. The first proposer call is the root proposal, later ones answer for the
    opponent. Without proposer and naive calls the logged candidates stand in for the proposal.
    """
    of = lambda *roles: F.filter(traces, lambda t: t["role"].isin(*roles))
    note = lambda arr: F.transform(
        arr, lambda t: F.struct(t["fen"].alias("fen"), t["parsed"].alias("data"))
    )
    root = F.try_element_at(of("proposer"), F.lit(1))
    has_naive = F.size(of("naive")) > 0
    reply = F.from_json(F.coalesce(root["parsed"], F.lit("{}")), _REPLY)
    listed = F.struct(
        F.lit(None).cast("string").alias("thinking"),
        F.transform(
            logged,
            lambda c: F.struct(
                c["san"].alias("move"), F.coalesce(c["reason"], F.lit("")).alias("reason"),
                c["prior"].alias("prior"),
            ),
        ).alias("candidates"),
        F.lit(None).cast("array<string>").alias("threats"),
        F.lit(None).cast("array<string>").alias("hanging"),
        F.lit(None).cast("string").alias("board"),
    )
    proposer = F.when(root.isNotNull(), reply).when(
        ~F.coalesce(has_naive, F.lit(False)) & (F.size(logged) > 0), listed
    )
    naive = F.try_element_at(of("naive"), F.lit(-1))
    others = F.filter(
        traces, lambda t: ~t["role"].isin("proposer", "positional", "evaluator", "naive")
    )
    last_of = F.transform(
        F.array_distinct(F.transform(others, lambda t: t["role"])),
        lambda r: F.struct(
            r.alias("key"), F.element_at(F.filter(others, lambda t: t["role"] == r), -1)["parsed"].alias("value")
        ),
    )
    return F.struct(
        proposer.alias("proposer"),
        F.when(naive.isNotNull(), F.from_json(F.coalesce(naive["parsed"], F.lit("{}")), "thinking string, move string")).alias("naive"),
        note(F.slice(of("proposer"), 2, 1_000_000_000)).cast(_NOTES).alias("opponent_proposer"),
        note(of("positional")).cast(_NOTES).alias("positional"),
        note(of("evaluator")).cast(_NOTES).alias("evaluator"),
        F.map_from_entries(last_of).alias("others"),
    )


def build_positions(
    decisions: DataFrame,
    evals: DataFrame,
    games: DataFrame,
    traces: DataFrame,
    meta: DataFrame,
    pgn: DataFrame | None = None,
) -> DataFrame:
    """One nested row per decision of a subject player that led to a move."""
    d = with_move(decisions.where(names.name_any(F.coalesce("player", F.lit("")))))
    out = join_results(join_evals(d, evals), games)
    calls = traces.withColumn("parsed", extract_json(F.col("response"))).select(
        *KEYS, "_seq", "call", "role", "fen", "parsed"
    )
    out = attach_traces(out, calls)
    out = out.join(histories(decisions, games), KEYS, "left")
    if pgn is not None:
        line = latest(
            pgn.where(F.col("round").isNotNull()).select(
                "run_id", F.col("round").alias("game"), "seq", "sans",
                F.try_element_at("headers", F.lit("FEN")).isNotNull().alias("_setup"),
            ),
            ["run_id", "game"], ["seq"],
        )
        out = out.join(line.drop("seq"), ["run_id", "game"], "left")
    else:
        out = out.withColumn("sans", F.lit(None).cast("array<string>")).withColumn("_setup", F.lit(False))
    m = meta.select(
        "run_id", F.col("model"),
        F.struct("depth", "tac_depth", "tac_margin", "search", "threat_agent", "thinking", "board_read")
        .alias("pipeline"),
    )
    out = out.join(m, "run_id", "left")
    before = F.greatest(F.col("ply") - 1, F.lit(0))
    nothing = F.array().cast("array<string>")
    sans = F.coalesce(F.slice("sans", F.lit(1), before), nothing)
    return out.select(
        F.concat_ws(":", *KEYS).alias("id"),
        *KEYS,
        group_split(F.col("run_id"), F.col("game")).alias("split"),
        "fen",
        F.col("color").alias("side"),
        "history_uci",
        F.when(~F.coalesce("_setup", F.lit(False)), sans).otherwise(nothing).alias("history_san"),
        "player",
        "model",
        "pipeline",
        "board_read",
        agents(F.coalesce(F.col("traces"), F.expr("cast(array() as array<struct<call:int,role:string,fen:string,parsed:string>>)")),
               F.col("candidates")).alias("agents"),
        F.col("search").alias("engine"),
        F.struct(
            "san", "uci", F.coalesce("note", F.lit("")).alias("note"), F.col("calls").alias("llm_calls"),
            F.col("cost").alias("cost_usd"), F.coalesce("forced_random", F.lit(False)).alias("forced_random"),
            F.coalesce("illegal_attempts", nothing).alias("illegal_attempts"),
        ).alias("decision"),
        F.struct(
            F.col("eval.eval_before").alias("sf_eval_before"), F.col("eval.eval_after").alias("sf_eval_after"),
            F.col("eval.best_move").alias("sf_best_move"), F.col("eval.cpl").alias("cp_loss"),
            side_score(F.col("result"), F.col("color")).alias("game_result"),
        ).alias("labels"),
    )


def build_calls(positions: DataFrame, traces: DataFrame) -> DataFrame:
    """Raw calls of the positions, keyed by position id."""
    return positions.select(*KEYS, F.col("id").alias("position_id")).join(traces, KEYS).select(
        "position_id", *CALL_FIELDS
    )


# --- text ---------------------------------------------------------------------------------------
def user_text(fen: Column, history_san: Column, context: Column | None = None) -> Column:
    side = F.when(F.split_part(fen, F.lit(" "), F.lit(2)) == "w", F.lit("White")).otherwise(F.lit("Black"))
    recent = F.when(
        F.size(history_san) > 0, F.concat(F.lit("Recent moves: "), tail_text(history_san, 12))
    )
    return F.concat_ws(
        "\n",
        F.concat(F.lit("FEN: "), fen),
        F.concat(F.lit("Side to move: "), side),
        recent,
        context if context is not None else F.lit(None).cast("string"),
        F.lit(K.USER_CLOSING),
    )


def assistant_text(
    agents: Column, engine: Column, board_read: Column, san: Column
) -> Column:
    """Threats, assessment, candidates with their verified verdicts, decision, move; NULL if bare."""
    found = engine["candidates"]
    real, claimed = board_read["threats_real"], agents["proposer"]["threats"]
    threats = F.when(
        real.isNotNull(),
        F.concat(
            F.lit("Threats [verified]: "),
            F.when(F.size(real) > 0, F.array_join(real, ", ")).otherwise(F.lit("none")),
        ),
    ).when(F.size(claimed) > 0, F.concat(F.lit("Threats: "), F.array_join(claimed, ", ")))
    blank = lambda c: F.when(c != "", c)
    thinking = F.coalesce(blank(agents["proposer"]["thinking"]), blank(agents["naive"]["thinking"]))
    assessment = F.when(thinking.isNotNull(), F.concat(F.lit("Assessment: "), thinking))
    cands = agents["proposer"]["candidates"]

    def line(c, e, move):
        verdict = (
            F.when(
                e["threat_verified"],
                F.concat(F.lit(" [verified: rejected, "), F.coalesce(e["threat_reply"], F.lit("None")), F.lit(" "),
                         score_wording(e["threat_cp"]), F.lit("]")),
            )
            .when(
                e["vetoed"],
                F.concat(
                    F.lit(" [verified: rejected"),
                    F.coalesce(F.concat(F.lit(" after "), blank(e["engine_reply"])), F.lit("")),
                    F.lit(", "), score_wording(e["tactical_cp"]), F.lit("]"),
                ),
            )
            .when(
                e["tactical_cp"].isNotNull(),
                F.concat(F.lit(" [verified: "), score_wording(e["tactical_cp"]), F.lit("]")),
            )
            .otherwise(F.lit(""))
        )
        return F.concat(F.lit("- "), move, F.lit(": "), F.trim(F.coalesce(c["reason"], F.lit(""))), verdict)

    # bound once: the verdict of a candidate looks at several fields of its search entry
    looked_up = lambda all_: F.transform(
        cands,
        lambda c: let(
            F.struct(F.coalesce(c["move"], F.lit("")).alias("m"),
                     F.try_element_at(all_, F.coalesce(c["move"], F.lit(""))).alias("e")),
            lambda x: line(c, x["e"], x["m"]),
        ),
    )
    proposed = F.when(
        F.size(cands) > 0,
        F.concat(F.lit("Candidates:\n"), F.array_join(let(found, looked_up), "\n")),
    )
    extra = F.filter(F.map_entries(found), lambda e: e["value"]["source"] == K.SEARCH_SOURCE)
    tactics = F.when(
        F.size(extra) > 0,
        F.array_join(
            F.transform(
                extra,
                lambda e: F.concat(
                    F.lit("- "), e["key"], F.lit(": tactic found by search [verified: "),
                    score_wording(e["value"]["tactical_cp"]), F.lit("]"),
                ),
            ),
            "\n",
        ),
    )
    decided = blank(engine["decided_by"])
    decision = F.when(
        ~decided.isin("hybrid", "alpha-beta"), F.concat(F.lit("Decision: "), decided, F.lit("."))
    )
    body = F.concat_ws("\n", threats, assessment, proposed, tactics, decision)
    return F.when(body != "", F.concat(body, F.lit("\nBest move: "), san))


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def sft(positions: DataFrame, context: str | None = None) -> DataFrame:
    """Chat examples of the positions that have something to explain."""
    c = F.col
    target = assistant_text(c("agents"), c("engine"), c("board_read"), c("decision.san"))
    prompt = user_text(c("fen"), c("history_san"), c(context) if context else None)
    written = fence(positions.withColumn("_target", target), "chat targets")
    return written.where(c("_target").isNotNull()).select(
        "id",
        "split",
        F.array(
            _message("system", F.lit(K.SYSTEM_PROMPT)), _message("user", prompt),
            _message("assistant", c("_target")),
        ).alias("messages"),
        F.struct(
            c("labels.cp_loss").alias("cp_loss"), c("labels.game_result").alias("game_result"),
            c("decision.forced_random").alias("forced_random"),
        ).alias("quality"),
    )


def preferences(positions: DataFrame, cut: int = K.SOUND_MOVE) -> DataFrame:
    """(played move, refuted own candidate) pairs; the played move must be a sound proposal."""
    c = F.col
    cands = c("agents.proposer.candidates")
    lookup = lambda move: F.try_element_at(  # noqa: E731  (the last item of a move counts)
        F.filter(cands, lambda x: x["move"] == move), F.lit(-1)
    )
    played, loss = c("decision.san"), c("labels.cp_loss")
    # fixed pair filter before the explode: only sound, proposed moves multiply
    sound = positions.where(lookup(played).isNotNull() & (loss.isNull() | (loss < cut)))
    refuted = F.filter(
        F.map_entries(c("engine.candidates")),
        lambda e: (e["key"] != played)
        & (F.coalesce(e["value"]["vetoed"], F.lit(False)) | F.coalesce(e["value"]["threat_verified"], F.lit(False)))
        & F.exists(cands, lambda x: x["move"] == e["key"]),
    )
    rows = sound.withColumn("_e", F.explode(refuted))
    san, e = c("_e.key"), c("_e.value")
    threat = F.coalesce(e["threat_verified"], F.lit(False))
    say = lambda move: F.concat(
        move, F.lit(": "), F.coalesce(lookup(move)["reason"], F.lit("")), F.lit("\nBest move: "), move
    )
    return rows.select(
        F.concat_ws(":", "id", san).alias("id"),
        "split",
        F.array(
            _message("system", F.lit(K.SYSTEM_PROMPT)),
            _message("user", user_text(c("fen"), c("history_san"))),
        ).alias("prompt"),
        say(played).alias("chosen"),
        say(san).alias("rejected"),
        F.struct(
            F.when(threat, e["threat_reply"]).otherwise(e["engine_reply"]).alias("reply"),
            F.when(threat, e["threat_cp"]).otherwise(e["tactical_cp"]).alias("material"),
        ).alias("refutation"),
    )


def dataset_stats(
    positions: DataFrame, calls: DataFrame, sft_rows: DataFrame, prefs: DataFrame
) -> DataFrame:
    """One row of counts. Run names are listed by `dataset_runs`."""
    n = F.count(F.lit(1))
    split = lambda s: F.count_if(F.col("split") == s).alias(s)
    loss = F.coalesce("quality.cp_loss", F.lit(0))
    parts = [
        positions.agg(n.alias("positions"), F.countDistinct("run_id").alias("runs"),
                      split("train"), split("val"), split("test")),
        calls.agg(n.alias("calls"), F.countDistinct("position_id").alias("positions_with_full_traces")),
        sft_rows.agg(n.alias("sft"), F.count_if(loss < K.SOUND_MOVE).alias("sft_cp_loss_lt_100")),
        prefs.agg(n.alias("preference_pairs")),
    ]
    out = parts[0].withColumn("_k", F.lit(1))
    for p in parts[1:]:
        out = out.join(p.withColumn("_k", F.lit(1)), "_k")  # one row each
    return out.drop("_k")


def dataset_runs(positions: DataFrame) -> DataFrame:
    return positions.select("run_id").distinct().orderBy("run_id")


def call_meter(calls: DataFrame, group: list[str]) -> DataFrame:
    return calls.groupBy(*group).agg(
        F.count(F.lit(1)).alias("calls"),
        F.sum("cost_usd").alias("cost_usd"),
        F.sum("input_tokens").alias("input_tokens"),
        F.sum("output_tokens").alias("output_tokens"),
    )


def timeline(plies: DataFrame, decisions: DataFrame, traces: DataFrame, evals: DataFrame, keys=tuple(KEYS)) -> DataFrame:
    """Every ply with its decision, the first reply per role, and its eval."""
    keys = list(keys)
    roles = ("proposer", "compare", "threat")
    reply = lambda r: F.min_by("response", F.when(F.col("role") == r, F.struct("call", "_seq"))).alias(r)
    spoken = traces.groupBy(*keys).agg(*[reply(r) for r in roles])
    d = decisions.select(*keys, *[F.col(c).alias(f"d_{c}") for c in decisions.columns if c not in keys])
    e = evals.select(*keys, *[F.col(c).alias(f"e_{c}") for c in evals.columns if c not in keys])
    return plies.join(d, keys, "left").join(spoken, keys, "left").join(e, keys, "left")
