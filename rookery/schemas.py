"""Explicit schemas (DDL) of the logs and of the store. Nothing is inferred: absent fields read as NULL."""

from __future__ import annotations

_CANDIDATE = "array<struct<san:string,reason:string,prior:double,score_cp:double,line:array<string>>>"
_SEARCH_ENTRY = (
    "struct<source:string,prior:double,reason:string,tactical_cp:int,mate:int,engine_reply:string,"
    "vetoed:boolean,threat_reply:string,threat_idea:string,threat_cp:int,threat_verified:boolean,"
    "positional_cp:int,final_cp:int,ab_value:int>"
)
_SEARCH = f"struct<mode:string,decided_by:string,candidates:map<string,{_SEARCH_ENTRY}>>"
_BOARD_READ = (
    "struct<pieces_total:int,pieces_correct:int,piece_accuracy:double,missing:array<string>,"
    "phantom:array<string>,threats_real:array<string>,threats_claimed:array<string>,"
    "threats_seen:array<string>,threats_missed:array<string>,hanging_real:array<string>,"
    "hanging_claimed:array<string>,hanging_missed:array<string>>"
)


META = (
    "label string, white_spec string, black_spec string, model string, ctx_version int, depth int, "
    "tac_depth int, tac_margin int, search string, threat_agent boolean, thinking int, "
    "board_read boolean"
)
GAMES_LOG = (
    "game int, white string, black string, result string, termination string, opening string, "
    "book_plies int, plies int"
)
DECISIONS_LOG = (
    "game int, ply int, fen string, player string, color string, san string, uci string, "
    f"candidates {_CANDIDATE}, illegal_attempts array<string>, calls int, cost double, "
    "seconds double, forfeit_reason string, note string, forced_random boolean, own_eval double, "
    f"board_read {_BOARD_READ}, search {_SEARCH}"
)
TRACES_LOG = (
    "game int, ply int, player string, call int, role string, model string, fen string, "
    "prompt string, response string, cost_usd double, seconds double, input_tokens int, "
    "output_tokens int"
)
# `game` is text in this log; readers cast it (see sources.logs).
EVALS_LOG = (
    "game string, ply int, color string, player string, san string, cpl int, eval_before int, "
    "eval_after int, best_move string"
)
SUITE_ITEMS = ("fen string, history_uci array<string>, src string, sf_best string, sf_eval int")
SUITE_RESULTS = (
    "src string, fen string, san string, sf_best string, claude_candidates array<string>, "
    "cost double, seconds double, calls int, note string, cp_loss int"
)
GAMES_CSV = (
    "run string, game int, config string, model string, harness string, level int, color string, "
    "result string, score double, termination string, plies int, acpl double, cost_usd double, "
    "claude_moves int, claude_seconds double"
)

STORE_RUNS = (
    "run_id string, label string, started_at timestamp, run_dir string, meta_json string, "
    "git_commit string, valid boolean, ingested_at timestamp"
)
STORE_PLAYERS = (
    "name string, kind string, model string, config map<string,string>, depth int, elo int, skill int"
)
STORE_GAMES = (
    "game_id string, run_id string, idx int, white string, black string, result string, "
    "termination string, aborted boolean, opening_name string, opening_eco string, book_plies int, "
    "plies int, adjudication_cp int, pgn string"
)
STORE_MOVES = (
    "game_id string, run_id string, ply int, fen_before string, san string, uci string, "
    "player string, side string, book boolean, phase string, opening string, llm_calls int, "
    f"cost_usd double, seconds double, illegal_attempts array<string>, forced_random boolean, "
    f"candidates {_CANDIDATE}, note string, own_eval double, sf_eval_before int, "
    "sf_eval_after int, cp_loss int, classification string, sf_best_move string"
)
STICKY_MOVE_COLUMNS = (
    "sf_eval_before",
    "sf_eval_after",
    "cp_loss",
    "classification",
    "sf_best_move",
)
