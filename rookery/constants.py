"""Fixed values shared by every operator.

These are data-format values: log vocabularies, thresholds, price and weight tables. They must equal
what existing logs and knowledge pages contain, so they are stated plainly and in one place.
"""

# --- results and terminations -------------------------------------------------------------------
DECIDED = ("1-0", "0-1", "1/2-1/2")
ABORTED_PREFIX = "aborted"

# --- loss bands and cuts ------------------------------------------------------------------------
LOSS_BANDS = ((50, "inaccuracy"), (100, "mistake"), (300, "blunder"))
LOSS_CAP = 1000
SUITE_BLUNDER = 200
SUITE_HARD = 150
SOUND_MOVE = 100
ADJUDICATION_CP = 300
MATE_CP = 10000
MATE_WORDING = 9000
PLOT_CAP = 800

# --- player and log vocabulary ------------------------------------------------------------------
SUBJECT_WORDS = ("naive", "engine", "hybrid")
OPPONENT_WORDS = ("maia", "stockfish", "random")
LADDER_OPPONENT = "maia"
LEVEL_PATTERN = r"maia[:-]?(\d{4})"
HARNESS_PREFIXES = ("hybrid", "engine")
MODEL_BUCKETS = ("haiku", "sonnet", "opus")
OWN_SOURCE = "claude"
SEARCH_SOURCE = "engine"
OUTAGE_MARKERS = ("limit", "429", "overloaded", "rate", "529", "quota")
RELIANCE_FLAGS = (
    "moves",
    "top_played",
    "top_overruled",
    "claude_proposed",
    "search_added",
    "fail_low",
    "no_claude_value",
)

# --- USD per million tokens: (model substring, input, output) -----------------------------------
TOKEN_PRICES = (("opus", 5.0, 25.0), ("sonnet", 3.0, 15.0), ("haiku", 1.0, 5.0))

# --- rating anchors: (weight, bot, pool, rating) ------------------------------------------------
RATING_ANCHORS = (
    (1100, "maia1", "blitz", 1387.0),
    (1100, "maia1", "rapid", 1494.0),
    (1100, "maia1", "classical", 1651.0),
    (1500, "maia5", "blitz", 1453.0),
    (1500, "maia5", "rapid", 1625.0),
    (1500, "maia5", "classical", 1720.0),
    (1900, "maia9", "blitz", 1612.0),
    (1900, "maia9", "rapid", 1773.0),
    (1900, "maia9", "classical", 1731.0),
)

# --- tablebase categories -----------------------------------------------------------------------
TABLEBASE_RANKS = (
    ("loss", -2),
    ("blessed-loss", -1),
    ("maybe-loss", -2),
    ("draw", 0),
    ("cursed-win", 1),
    ("maybe-win", 2),
    ("win", 2),
)
TABLEBASE_MAX_PIECES = 7

# --- retrieval weights per tag (unknown tag: 1.0) -----------------------------------------------
TAG_WEIGHTS = (
    ("iqp", 5.0), ("hanging-pawns", 5.0), ("carlsbad", 5.0), ("maroczy", 5.0), ("hedgehog", 6.0),
    ("sicilian", 3.0), ("french-chain", 5.0), ("kid-locked", 5.0), ("benoni", 5.0),
    ("stonewall", 5.0), ("rook-endgame", 5.0), ("pawn-endgame", 6.0), ("opposite-castling", 4.0),
    ("tactics", 3.0), ("passed-pawn", 2.5), ("bishop-pair", 2.0), ("opposite-bishops", 2.0),
    ("exchange", 3.0), ("king-safety", 2.5), ("development", 2.5), ("opening", 1.0),
    ("endgame", 1.5), ("outpost", 1.5), ("open-file", 1.0), ("seventh-rank", 1.5),
    ("bad-bishop", 2.5), ("weak-pawns", 1.0), ("pawn-majority", 1.0), ("minority-attack", 1.0),
    ("closed", 1.0), ("prophylaxis", 0.5),
)

# --- book starts (name, moves in long algebraic form) -------------------------------------------
BOOK_STARTS = (
    ("Ruy Lopez", "e2e4 e7e5 g1f3 b8c6 f1b5 a7a6"),
    ("Italian", "e2e4 e7e5 g1f3 b8c6 f1c4 f8c5"),
    ("Sicilian Najdorf", "e2e4 c7c5 g1f3 d7d6 d2d4 c5d4 f3d4 g8f6"),
    ("French", "e2e4 e7e6 d2d4 d7d5 b1c3 g8f6"),
    ("Caro-Kann", "e2e4 c7c6 d2d4 d7d5 b1c3 d5e4 c3e4 c8f5"),
    ("QGD", "d2d4 d7d5 c2c4 e7e6 b1c3 g8f6"),
    ("King's Indian", "d2d4 g8f6 c2c4 g7g6 b1c3 f8g7 e2e4 d7d6"),
    ("English", "c2c4 e7e5 b1c3 g8f6 g1f3 b8c6"),
)

# --- training-text wording ----------------------------------------------------------------------
SYSTEM_PROMPT = (
    "You are a chess analyst. Given a position, identify the threats, weigh the "
    "candidate moves with concrete reasons, and name the best move."
)
USER_CLOSING = "Analyse the position and choose the best move."
