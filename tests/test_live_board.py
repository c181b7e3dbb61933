"""The whole live board: drops and restarts, idle games, replayed batches."""

import pytest
from pyspark.sql import functions as F

from rookery.operators.deltas import DeltaTable
from rookery.session import shared_dir
from rookery.streaming import board

SCHEMA = "run string, game string, row string, col int, at timestamp, ply int, score double, cost double, top boolean"


def drop(spark, folder, rows):
    """Rows (game, minute, ply, score, top); every row costs a quarter."""
    spark.createDataFrame(rows, "game string, minute int, ply int, score double, top boolean").select(
        F.lit("r").alias("run"), "game", F.lit("naive").alias("row"), F.lit(1100).alias("col"),
        F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000).alias("at"), "ply", "score", F.lit(0.25).alias("cost"), "top",
    ).write.mode("append").parquet(folder)


def run(spark, folder, out, check, idle=3600):
    rows = spark.readStream.schema(SCHEMA).parquet(folder)
    board.live_board_full(rows, out, check, ["top"], idle=idle, available_now=True).awaitTermination()


def shown(spark, out):
    rows = board.board(spark, out, ["top"], 4, 100.0).collect()
    return {
        "total": [(r.games, r.pct, r.cost, r.eta_seconds) for r in rows if r.section == "total"],
        "cell": sorted(r.cell for r in rows if r.section == "cell"),
        "open": sorted((r.game, r.ply) for r in rows if r.section == "open"),
        "reliance": [(r.flag, r.moves, r.pct) for r in rows if r.section == "reliance"],
    }


def test_board_over_drops(spark):
    folder, out, check = (shared_dir(spark, x) for x in ("feed", "live", "check"))
    assert shown(spark, out)["total"] == [(0, 0.0, 0.0, None)]
    drop(spark, folder, [("a", 0, 1, None, True), ("a", 1, 2, None, False), ("b", 1, 1, None, None), (None, 1, 9, 1.0, True)])
    run(spark, folder, out, check)
    assert shown(spark, out) == {"total": [(0, 0.0, 0.75, None)], "cell": [], "open": [("a", 2), ("b", 1)], "reliance": [("top", 3, pytest.approx(100 / 3))]}
    drop(spark, folder, [("a", 2, 2, 0.5, None), ("b", 3, 3, None, True)])
    run(spark, folder, out, check)
    drop(spark, folder, [("a", 4, 2, 1.0, None), ("a", 4, 3, None, False)])  # a second result, and a ply after the end
    run(spark, folder, out, check)
    got = shown(spark, out)
    assert got["total"] == [(1, 25.0, 1.75, 300.0)] and got["open"] == [("b", 3)]
    assert got["cell"] == ["0.5/1", "0.5/1 (0-1-0)"] and got["reliance"] == [("top", 5, 40.0)]


def test_idle_games_leave_and_come_back(spark):
    folder, out, check = (shared_dir(spark, x) for x in ("feed", "live", "check"))
    drop(spark, folder, [("a", 0, 1, None, True), ("b", 0, 1, None, True)])
    run(spark, folder, out, check, idle=60)
    drop(spark, folder, [("b", 100, 2, None, True)])
    run(spark, folder, out, check, idle=60)
    drop(spark, folder, [("b", 101, 3, None, True)])
    run(spark, folder, out, check, idle=60)
    assert shown(spark, out)["open"] == [("b", 3)]
    drop(spark, folder, [("a", 102, 2, None, True)])
    run(spark, folder, out, check, idle=60)
    assert shown(spark, out)["open"] == [("a", 2), ("b", 3)]


def test_batch_broken_between_its_two_commits_counts_once(spark, monkeypatch):
    folder, out, check = (shared_dir(spark, x) for x in ("feed", "live", "check"))
    drop(spark, folder, [("a", 0, 1, None, True), ("b", 0, 1, 1.0, True)])
    real = DeltaTable._commit

    def broken(self, *args):
        if self.path.endswith("/open"):
            raise OSError("lost after the sums")
        real(self, *args)

    with monkeypatch.context() as m:
        m.setattr(DeltaTable, "_commit", broken)
        with pytest.raises(Exception):
            run(spark, folder, out, check)
    run(spark, folder, out, check)
    got = shown(spark, out)
    assert got["total"] == [(1, 25.0, 0.5, 300.0)] and got["open"] == [("a", 1)]


def test_gone_rows_are_dropped_below_nothing(spark):
    t = DeltaTable(spark, shared_dir(spark, "gone"), "k int, state string", ("k",), gone="state <> 'open'")
    for values in ([(1, "open"), (2, "open")], [(1, "ended")], [(2, "open"), (3, "ended")], [(3, None)]):
        t.append(spark.createDataFrame(values, "k int, state string"))
        t.compact(fanout=3)
    assert sorted(tuple(r) for r in t.read().collect()) == [(2, "open"), (3, None)]
    oldest = [f for f in t.newest().folders if f[1] == 1]
    assert t._read(oldest).count() == 1


def test_a_game_costs_one_read_and_one_write_a_batch():
    calls = []

    class Handle:
        value = None

        def getValueState(self, *_):
            return self

        def get(self):
            calls.append("get")
            return self.value

        def update(self, value):
            calls.append("update")
            self.value = value

        def registerTimer(self, at):
            calls.append("timer")

    watch = board.Watch(["top"], 1000)
    watch.init(Handle())
    (new,) = watch.handleInputRows(("r", "a"), iter([("r", "a", None, 5_000_000, "x", 1, 2, None, 0.25, True)]), None)
    assert sorted(calls) == ["get", "timer", "update"] and (new.state, new.ply, new.moves, new.top) == ("open", 2, 1, 1)
    (new,) = watch.handleInputRows(("r", "a"), iter([("r", "a", None, 6_000_000, "x", 1, 3, 1.0, 0.25, False)]), None)
    assert calls[3:] == ["get", "update"] and (new.state, new.games, new.w, new.cost) == ("ended", 1, 1, 0.25)
