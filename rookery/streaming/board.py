"""The whole live board of an experiment from one stream of plies and results.

One stateful operator watches the games: it turns a batch into one change row per game (what the batch adds
to its cell, and whether the game is open). Two small delta tables take the changes: sums per cell, and the
open games. A batch costs what it brings, neither the games nor the plies before it; both commits name the
batch, so a batch that is replayed after a failure is counted once.

Columns of the stream: run, game, row and col (the game's cell), at (timestamp), ply, score (NULL but in a
result row), cost, and one boolean per reliance flag.

Cases: rows without run, game or time are passed over; of a game's results only those of the first batch with
one count, and of them the highest score; rows that follow within `idle` add to cost and flags only; an open game without rows for `idle` seconds of event
time leaves the board as idle and comes back with its next row; rows later than `late` are dropped.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle

from rookery.functions.numeric import short_text
from rookery.operators.deltas import DeltaTable
from rookery.operators.experiments import cell_text
from rookery.streaming.live import rocksdb_state

_SUMS = ("games", "points", "w", "d", "l", "cost", "moves")
_OPEN = "run string, game string, row string, col bigint, ply bigint, state string"


class Watch(StatefulProcessor):
    """State of a game: last ply, whether it ended, last event time. One timer a game ends idle games.

    A game costs one read and one write of its state a batch, and a timer with its first row only.
    """

    def __init__(self, flags: list[str], idle_ms: int):
        self.flags, self.idle_ms = flags, idle_ms
        self.change = Row("run", "game", "row", "col", "ply", "state", *_SUMS, *flags)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.game = handle.getValueState("game", "row string, col bigint, ply bigint, ended boolean, last bigint")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        state = self.game.get()
        row, col, ply, ended, last = state or (None, None, None, False, -1)
        moves, cost, result, counts = 0, 0.0, None, [0] * len(self.flags)
        for i, r in enumerate(rows):
            us, own_row, own_col, own_ply, score, own_cost, *flags = r[-6 - len(self.flags) :]
            if not i:
                row = own_row if row is None else row
                col = own_col if col is None else col
            last = max(last, us)
            if own_cost is not None and own_cost == own_cost:
                cost += own_cost
            if own_ply is not None:
                ply = max(own_ply, ply or 0)
            if score is None or score != score:
                moves += 1
            else:
                result = max(score, -1.0 if result is None else result)
            counts = [n + flag for n, flag in zip(counts, flags)]
        first = result is not None and not ended
        ended = ended or first
        if state is None:  # later rows leave this timer, which puts itself off
            self.handle.registerTimer(last // 1000 + self.idle_ms)
        self.game.update((row, col, ply, ended, last))
        sums = (int(first), result if first else 0.0, int(first and result == 1), int(first and result == 0.5),
                int(first and result == 0), cost, moves)
        yield self._change(key, row, col, ply, "ended" if ended else "open", (*sums, *counts))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:
        state = self.game.get()
        if state is None:
            return
        due = state[4] // 1000 + self.idle_ms
        if due > expiredTimerInfo.getExpiryTimeInMs() and due >= timerValues.getCurrentWatermarkInMs():
            self.handle.registerTimer(due)
            return
        self.game.clear()
        if not state[3]:
            yield self._change(key, state[0], state[1], state[2], "idle", (0, 0.0, 0, 0, 0, 0.0, 0, *[0] * len(self.flags)))

    def _change(self, key, row, col, ply, state, sums) -> Row:
        return self.change(key[0], key[1], row, col, ply, state, *sums)


def changes(rows: DataFrame, flags: list[str], late: str, idle: int) -> DataFrame:
    """One row per game and batch: its place on the board, and what the batch adds to its cell."""
    narrow = rows.withWatermark("at", late).where("run IS NOT NULL AND game IS NOT NULL AND at IS NOT NULL").select(
        "run", "game", "at", F.unix_micros("at").alias("us"), F.col("row").cast("string").alias("row"),
        F.col("col").cast("bigint").alias("col"), F.col("ply").cast("bigint").alias("ply"),
        F.col("score").cast("double").alias("score"), F.col("cost").cast("double").alias("cost"),
        *[F.coalesce(F.col(f).cast("boolean"), F.lit(False)).alias(f) for f in flags],
    )
    sums = "games bigint, points double, w bigint, d bigint, l bigint, cost double, moves bigint"
    schema = ", ".join([_OPEN, sums, *(f"{f} bigint" for f in flags)])
    return narrow.groupBy("run", "game").transformWithState(Watch(flags, idle * 1000), schema, "append", "eventTime")


def tables(spark: SparkSession, out: str, flags: list[str]) -> tuple[DeltaTable, DeltaTable]:
    """(sums per cell, open games) of the board at `out`."""
    kinds = {"points": "double", "cost": "double"}
    sums = ", ".join(f"{c} {kinds.get(c, 'bigint')}" for c in (*_SUMS, *flags))
    cells = DeltaTable(spark, f"{out}/cells", f"row string, col bigint, {sums}", ("row", "col"))
    return cells, DeltaTable(spark, f"{out}/open", _OPEN, ("run", "game"), gone="state <> 'open'")


def live_board_full(
    rows: DataFrame, out: str, checkpoint: str, flags: list[str], late: str = "10 minutes", idle: int = 3600,
    compact_every: int = 16, available_now: bool = False,
) -> StreamingQuery:
    """Keeps the tables of `out` up to date; `board` reads them at any time."""
    def publish(batch: DataFrame, batch_id: int):
        cells, open_games = tables(batch.sparkSession, out, flags)
        batch.persist()
        added = batch.groupBy("row", "col").agg(*[F.sum(c).alias(c) for c in (*_SUMS, *flags)])
        # as many rows as the board has cells, whatever came before
        total = cells.read().unionByName(added).groupBy("row", "col").agg(*[F.sum(c).alias(c) for c in (*_SUMS, *flags)])
        cells.append(total, stream="board", batch=batch_id)
        open_games.append(batch, stream="board", batch=batch_id)
        batch.unpersist()
        if batch_id % compact_every == compact_every - 1:
            cells.compact()
            open_games.compact()

    with rocksdb_state(rows.sparkSession):
        writer = changes(rows, flags, late, idle).writeStream.option("checkpointLocation", checkpoint).foreachBatch(publish)
        writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="20 seconds")
        return writer.start()


def board(spark: SparkSession, out: str, flags: list[str], expected: int, elapsed: float) -> DataFrame:
    """The board in one table, told apart by `section`.

    total: done games, share of `expected`, cost, remaining seconds at the pace of `elapsed`; cell: cross table
    with a total per row (is_total); open: games in progress with their last ply; reliance: the share of
    moves under every flag per row.
    """
    cells, open_games = tables(spark, out, flags)
    sums = cells.read()
    empty = {
        "section": "string", "row": "string", "col": "bigint", "is_total": "int", "run": "string", "game": "string",
        "ply": "bigint", "games": "bigint", "points": "double", "cost": "double", "cell": "string", "pct": "double",
        "eta_seconds": "double", "flag": "string", "moves": "bigint",
    }

    def part(df: DataFrame, section: str) -> DataFrame:
        have = set(df.columns)
        return df.select(F.lit(section).alias("section"), *[
            (F.col(c) if c in have else F.lit(None)).cast(t).alias(c) for c, t in empty.items() if c != "section"
        ])

    n = F.coalesce(F.sum("games"), F.lit(0))
    total = sums.agg(n.alias("games"), F.coalesce(F.sum("cost"), F.lit(0.0)).alias("cost")).select(
        "games", "cost", (F.col("games") * 100.0 / F.lit(expected) if expected else F.lit(0.0)).alias("pct"),
        F.when(F.col("games") > 0, F.lit(float(elapsed)) / F.col("games") * (F.lit(expected) - F.col("games"))).alias("eta_seconds"),
    )
    grid = sums.where("games > 0").rollup("row", "col").agg(
        F.grouping("row").alias("_all"), F.grouping("col").cast("int").alias("is_total"),
        *[F.sum(c).alias(c) for c in ("games", "points", "w", "d", "l", "cost")],
    ).where("_all = 0")
    grid = grid.withColumn("cell", F.when(F.col("is_total") == 1, F.concat_ws("/", short_text(F.col("points")), "games")).otherwise(
        cell_text("points", "games", "w", "d", "l")))
    listed = F.array(*[F.struct(F.lit(f).alias("flag"), F.col(f).alias("n")) for f in flags])
    shares = (
        sums.groupBy("row").agg(F.sum("moves").alias("moves"), *[F.sum(f).alias(f) for f in flags]).where("moves > 0")
        .select("row", "moves", F.explode(listed).alias("_f"))
        .select("row", "moves", "_f.flag", (F.col("_f.n") * 100.0 / F.col("moves")).alias("pct"))
    )
    out_rows = part(total, "total").unionByName(part(grid, "cell")).unionByName(part(open_games.read(), "open"))
    return out_rows.unionByName(part(shares, "reliance")) if flags else out_rows
