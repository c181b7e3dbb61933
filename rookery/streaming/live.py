"""Live boards, ingest and referee on Structured Streaming.

Every stream reuses the batch operators. State and checkpoints live in a folder the caller names
(see session.shared_dir), so a restarted query continues where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.stateful_processor import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.types import StructType

from rookery.functions.numeric import fixed_text
from rookery.operators.experiments import cell_text
from rookery.operators.store import delta_table
from rookery.sources.logs import _int_game, _path_columns


def read_log_stream(spark: SparkSession, path: str, schema: str, files_per_batch: int = 1000) -> DataFrame:
    """Append-only JSON-lines logs as a stream, with run_id and int game; malformed lines drop out."""
    full = StructType.fromDDL(schema + ", _corrupt string")
    df = (
        spark.readStream.schema(full)
        .option("mode", "PERMISSIVE")
        .option("columnNameOfCorruptRecord", "_corrupt")
        .option("maxFilesPerTrigger", str(files_per_batch))
        .json(path)
    )
    run = _path_columns()["run_id"].alias("run_id")
    return _int_game(df.select("*", run).where(F.col("_corrupt").isNull()).drop("_corrupt"))


# --- live board ---------------------------------------------------------------------------------
def board_cells(games: DataFrame, row: str = "config", col: str = "level", score: str = "score",
                cost: str = "cost_usd") -> DataFrame:
    """Counts per (row, col, score); the same for a batch and for a stream."""
    return games.groupBy(
        F.col(row).alias("row"), F.col(col).alias("col"), F.col(score).alias("score")
    ).agg(F.count(F.lit(1)).alias("n"), F.sum(cost).alias("cost"))


def board_from_cells(cells: DataFrame) -> DataFrame:
    """Cross table with row totals out of `board_cells`."""
    n = lambda s: F.coalesce(F.sum(F.when(F.col("score") == s, F.col("n"))), F.lit(0))
    agg = cells.rollup("row", "col").agg(
        F.grouping("row").cast("int").alias("_all"),
        F.grouping("col").cast("int").alias("is_total"),
        F.sum("n").alias("games"),
        F.sum(F.col("n") * F.col("score")).alias("points"),
        n(1.0).alias("w"), n(0.5).alias("d"), n(0.0).alias("l"),
        F.sum("cost").alias("cost"),
    )
    out = agg.where("_all = 0").drop("_all").withColumn("cell", cell_text("points", "games", "w", "d", "l"))
    return out.withColumn(
        "score_pct", F.concat(fixed_text(F.col("points") * 100 / F.col("games"), 0), F.lit("%"))
    )


def live_board(games: DataFrame, out: str, checkpoint: str, available_now: bool = False, **cols) -> StreamingQuery:
    """Keep `out` (parquet) at the newest board. The cell state is as small as the board itself."""
    def publish(cells: DataFrame, _batch: int):
        board_from_cells(cells).coalesce(1).write.mode("overwrite").parquet(out)

    writer = (
        board_cells(games, **cols).writeStream.outputMode("complete")
        .option("checkpointLocation", checkpoint)
        .foreachBatch(publish)
    )
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="20 seconds")
    return writer.start()


# --- live ingest --------------------------------------------------------------------------------
def live_ingest(
    rows: DataFrame, root: str, table: str, checkpoint: str, stream: str = "live", seq: str | None = None,
    compact_every: int = 16, available_now: bool = False,
) -> StreamingQuery:
    """Bring finished games (or their moves) into the store batch by batch.

    A batch writes its own rows and one commit, however long its runs are; every `compact_every` batches
    the small folders are merged. The commit names the batch of `stream`, so a batch that is replayed
    after a failure adds nothing, and one that broke off before its commit was never seen.
    """
    def bring(batch: DataFrame, batch_id: int):
        stored = delta_table(batch.sparkSession, root, table)
        stored.append(batch, seq, stream, batch_id)
        if batch_id % compact_every == compact_every - 1:
            stored.compact()

    writer = rows.writeStream.option("checkpointLocation", checkpoint).foreachBatch(bring)
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="20 seconds")
    return writer.start()


# --- referee ------------------------------------------------------------------------------------
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


#: Groups of games in the state; a checkpoint keeps the number it began with.
BUCKETS = 512
_NEVER = 1 << 62
_OPEN = {"side": 0, "length": 0, "decided": False, "last": -1, "since": _NEVER}


def run_lengths(side: np.ndarray, before, length, first: np.ndarray | None = None) -> np.ndarray:
    """Length of the run that each row ends; 0 where side is 0.

    `first` marks the rows that open a game (none given: the rows are one game). `before` and `length` are
    the game's open run, one number or one a row.
    """
    place = np.arange(len(side))
    first = place == 0 if first is None else first
    turn = first | (side != np.concatenate(([0], side[:-1])))
    start = np.maximum.accumulate(np.where(turn, place, 0))
    carried = np.where(first & (side == before), length, 0)
    return np.where(side == 0, 0, place - start + 1 + carried[start])


def _packed(frame: pd.DataFrame) -> tuple[bytes]:
    table, sink = pa.Table.from_pandas(frame, preserve_index=False), pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as out:
        out.write_table(table)
    return (sink.getvalue().to_pybytes(),)


def _unpacked(data: bytes) -> pd.DataFrame:
    return pa.ipc.open_stream(data).read_pandas()


class Referee(StatefulProcessor):
    """Rows wait in list state until the watermark has passed them, then extend their game's run in order.

    A key is a bucket of games, so that a state call and a pandas step serve all of them at once. Value
    state: one row a game with the open side, its run, whether the game is decided, its last event time and
    its first waiting one. One timer a bucket: the earliest time at which a waiting row can be judged, or a game
    without waiting rows leaves, `keep_ms` after its last row.
    Columns: game, us (event time in microseconds), o0, o1, … (further order), v (value), ended.
    """

    def __init__(self, types: dict[str, str], threshold: float, k: int, keep_ms: int):
        self.threshold, self.k, self.keep_ms = threshold, k, keep_ms
        self.columns = list(types)
        self.order = [c for c in types if c not in ("game", "v", "ended")]
        self.whole = [c for c in ("game", *self.order) if types[c] in ("tinyint", "smallint", "int", "bigint")]

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.games = handle.getValueState("games", "games binary, timer bigint")
        self.waiting = handle.getListState("waiting", "rows binary")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        games, timer = self._held()
        for frame in rows:
            if frame.empty:
                continue
            if key[0] < 0:  # the game without a key
                frame = frame.assign(game=0)
            times = frame.groupby("game")["us"].agg(["min", "max"])
            new = times.index.difference(games.index, sort=False)
            if len(new):
                added = pd.DataFrame(_OPEN, index=new)
                games = pd.concat([games, added]) if len(games) else added
            at = games.index.get_indexer(times.index)
            last, since, decided = (games[c].to_numpy(copy=True) for c in ("last", "since", "decided"))
            last[at] = np.maximum(last[at], times["max"])
            since[at] = np.where(decided[at], _NEVER, np.minimum(since[at], times["min"]))
            games["last"], games["since"] = last, since
            own = frame.loc[~decided[games.index.get_indexer(frame["game"])], self.columns]
            if len(own):
                self.waiting.appendValue(_packed(own))
        yield from self._settle(key, games, timer, timerValues)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        games, _ = self._held()
        yield from self._settle(key, games, None, timerValues)

    def _held(self) -> tuple[pd.DataFrame, int | None]:
        state = self.games.get()
        if state is None:
            return pd.DataFrame(_OPEN, index=[]), None
        return _unpacked(bytes(state[0])).set_index("game"), state[1]

    def _settle(self, key, games: pd.DataFrame, timer: int | None, timerValues) -> Iterator[pd.DataFrame]:
        """Judges the waiting rows that no row can come before any more, and lets old games go."""
        now = timerValues.getCurrentWatermarkInMs()
        upto = now * 1000
        due = games["since"] <= upto
        if now > 0 and due.any():
            rows = pd.concat([_unpacked(bytes(data)) for (data,) in self.waiting.get()], ignore_index=True)
            at = games.index.get_indexer(rows["game"])
            ripe = due.to_numpy()[at] & (rows["us"].to_numpy() <= upto)
            games, hits = self._judged(games, rows[ripe].assign(at=at[ripe]))
            left = rows[~ripe].assign(at=games.index.get_indexer(rows["game"][~ripe]))
            left = left[left["at"] >= 0]
            left = left[~games["decided"].to_numpy()[left["at"]]]
            since = np.full(len(games), _NEVER)
            np.minimum.at(since, left["at"].to_numpy(), left["us"].to_numpy())
            games["since"] = since
            if left.empty:
                self.waiting.clear()
            else:
                self.waiting.put([_packed(left[self.columns])])
            if len(hits):
                yield hits if key[0] >= 0 else hits.assign(game=None)
        until = games["last"] // 1000 + self.keep_ms
        games = games[(until > now) | (games["last"] > upto)]
        if timer is not None:
            self.handle.deleteTimer(timer)
        if games.empty:
            self.games.clear()
            return
        waits = games["since"] < _NEVER
        next_ = np.where(waits, games["since"] // 1000 + 1, games["last"] // 1000 + self.keep_ms)
        timer = max(int(next_.min()), now + 1)
        self.handle.registerTimer(timer)
        self.games.update((*_packed(games.rename_axis("game").reset_index()), timer))

    def _judged(self, games: pd.DataFrame, rows: pd.DataFrame) -> tuple[pd.DataFrame, pd.DataFrame]:
        """The games after `rows` (`at`: place of the game) and the rows that decide games; ended games are gone."""
        rows = rows.sort_values(["at", *self.order], ignore_index=True)
        at = rows["at"].to_numpy()
        cut = at[1:] != at[:-1]
        v = pd.to_numeric(rows["v"]).to_numpy(float, na_value=np.nan)
        sides = np.where(v >= self.threshold, 1, np.where(v <= -self.threshold, -1, 0))
        before, length = games["side"].to_numpy()[at], games["length"].to_numpy()[at]
        runs = run_lengths(sides, before, length, np.concatenate(([True], cut)))
        end = np.flatnonzero(np.concatenate((cut, [True])))
        side, length, decided = (games[c].to_numpy(copy=True) for c in ("side", "length", "decided"))
        side[at[end]], length[at[end]] = sides[end], runs[end]
        long = np.flatnonzero(runs >= self.k)
        won, first = np.unique(at[long], return_index=True)
        decided[won] = True
        hits = rows.loc[long[first], ["game", *self.order]].assign(streak=runs[long[first]], side=sides[long[first]])
        hits = hits.astype({c: "Int64" for c in self.whole})
        over = np.zeros(len(games), bool)
        over[at[rows["ended"].to_numpy(bool)]] = True
        return games.assign(side=side, length=length, decided=decided)[~over], hits.reset_index(drop=True)


def streak_stream(
    evals: DataFrame, key: str, time: str, order: list[str], value: str, threshold: float, k: int,
    late: str, keep_seconds: int = 7 * 86_400, ended: str | None = None, buckets: int = BUCKETS,
) -> DataFrame:
    """First row of each game whose run beyond ±threshold reaches k plies; one row per game.

    Rows may come in any order as long as none is later than `late` behind the newest (`time` is a
    timestamp): they are judged by (time, *order) once the watermark has passed them. A game leaves the
    state with a row whose `ended` is true, or `keep_seconds` of event time after its last row; only rows
    that wait and one row per open game are held, in RocksDB. A null value breaks a run; rows with a null
    key are one game, and rows with a null time are passed over. Games are kept in `buckets`: a batch reads and writes the open games (some
    30 bytes each) of the buckets it touches, and a task holds one bucket. The query has to be started with
    `rocksdb_state` in force.
    """
    end = F.coalesce(F.col(ended).cast("boolean"), F.lit(False)) if ended else F.lit(False)  # null is no end
    rows = evals.withWatermark(time, late).where(F.col(time).isNotNull()).select(
        # rows without a key are one game in a bucket of its own
        F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(key), F.lit(buckets))).cast("int").alias("bucket"), F.col(key).alias("game"), F.col(time), F.unix_micros(time).alias("us"),
        *[F.col(c).alias(f"o{i}") for i, c in enumerate(order)], F.col(value).cast("double").alias("v"), end.alias("ended"),
    )
    types = {c: t for c, t in rows.dtypes if c not in (time, "bucket")}
    given = ["game", "us", *(f"o{i}" for i in range(len(order)))]
    schema = ", ".join(f"{c} {types[c]}" for c in given) + ", streak bigint, side int"
    processor = Referee(types, threshold, k, keep_seconds * 1000)
    hits = rows.groupBy("bucket").transformWithStateInPandas(processor, schema, "append", "eventTime")
    return hits.select(
        F.col("game").alias(key), F.timestamp_micros("us").alias(time),
        *[F.col(f"o{i}").alias(c) for i, c in enumerate(order)], "streak", "side",
    )


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Queries started inside keep their state in RocksDB, which `streak_stream` asks for."""
    before = spark.conf.get(STATE_STORE)
    spark.conf.set(STATE_STORE, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(STATE_STORE, before)
