"""The referee on a stream: order of arrival, late ends, games that end, state that leaves."""

import random
from itertools import groupby

import numpy as np
import pandas as pd
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from rookery.session import shared_dir
from rookery.streaming import live


@settings(deadline=None)
@given(st.lists(st.sampled_from([-1, 0, 1]), min_size=1, max_size=40), st.sampled_from([-1, 0, 1]), st.integers(1, 5))
def test_run_lengths(sides, before, length):
    whole = [before] * length + sides
    want = [0 if s == 0 else n + 1 for s, g in groupby(whole) for n, _ in enumerate(g)][length:]
    assert live.run_lengths(np.array(sides), before, length if before else 0).tolist() == want


def _hits(spark, drops, **options):
    """Streams the drops one by one, each in files of its own; rows (game, minute, ply, value, over)."""
    folder, check, out = (shared_dir(spark, x) for x in ("referee", "check", "hits"))
    schema = "game string, at timestamp, ply int, cp int, over boolean"
    for rows in drops:
        spark.createDataFrame(rows, "game string, minute int, ply int, cp int, over boolean").select(
            "game", F.timestamp_seconds(F.col("minute") * 60 + 1_700_000_000).alias("at"), "ply", "cp", "over"
        ).repartition(3).write.mode("append").parquet(folder)
        read = spark.readStream.schema(schema).parquet(folder)
        with live.rocksdb_state(spark):  # a new query for each drop: it goes on from its checkpoint
            q = (
                live.streak_stream(read, "game", "at", ["ply"], "cp", 500, 3, late="20 minutes", **options)
                .writeStream.format("parquet").option("checkpointLocation", check).trigger(availableNow=True).start(out)
            )
        q.awaitTermination()
    got = spark.read.schema("game string, at timestamp, ply int, streak bigint, side int").parquet(out)
    return sorted(tuple(r) for r in got.select("game", "ply", "streak", "side").collect())


def test_referee_waits_for_the_watermark_and_survives_restarts(spark):
    deal = random.Random(5)
    a = [("a", m, m, v, False) for m, v in enumerate([600, 700, 0, 500, 800, 900, -900])]
    b = [("b", m, m, v, False) for m, v in enumerate([-500, None, -600, -700, -800])]
    c = [("c", m, m, 499, False) for m in range(8)]
    first, second = [], []
    for row in a + b + c:  # rows of a run lie in both drops, the later ones first
        (first if row[1] % 2 else second).append(row)
    deal.shuffle(first)
    deal.shuffle(second)
    late = [(None, 60, 0, 900, False), ("d", 61, 0, 900, False), ("d", 61, 1, 900, False), ("d", 61, 2, 900, False)]
    end = [("z", 500, 0, 0, False)]
    assert _hits(spark, [first, second, late, end]) == [("a", 5, 3, 1), ("b", 4, 3, -1), ("d", 2, 3, 1)]


def test_games_leave_the_state(spark):
    ended = [("a", 0, 0, 900, False), ("a", 1, 1, 900, True), ("b", 0, 0, 900, False), ("b", 1, 1, 900, False)]
    more = [("a", 100, 2, 900, False), ("b", 100, 2, 900, False), ("c", 100, 2, 900, False)]
    far = [("z", 2000, 0, 0, False)]
    # a ended, so its next row opens a run; b goes on
    assert _hits(spark, [ended, more, far], ended="over") == [("b", 2, 3, 1)]
    # an hour without rows takes b out of the state as well, once the watermark has passed it
    between = [("z", 90, 0, 0, False), ("z", 95, 0, 0, False)]
    assert _hits(spark, [ended, between, more, far], keep_seconds=60) == []


def test_state_calls_do_not_grow_with_the_games():
    """A bucket's batch costs the same few state calls for 3 games and for 3,000."""
    class Cell:
        def __init__(self):
            self.value, self.rows, self.calls = None, [], 0

        def count(self, result=None):
            self.calls += 1
            return result

        def update(self, value):
            self.value = self.count(tuple(value))

    class Value(Cell):
        def get(self):
            return self.count(self.value)

        def clear(self):
            self.value = self.count()

    class Rows(Cell):
        def get(self):
            return self.count(iter(self.rows))

        def appendValue(self, row):
            self.rows.append(self.count(row))

        def clear(self):
            self.rows = self.count([])

        def put(self, rows):
            self.rows = self.count(rows)

    class Handle:
        def __init__(self):
            self.states, self.timers, self.calls = [Value(), Rows()], set(), 0

        def getValueState(self, *_):
            return self.states[0]

        def getListState(self, *_):
            return self.states[1]

        def registerTimer(self, at):
            self.calls += 1
            self.timers.add(at)

        def deleteTimer(self, at):
            self.calls += 1
            self.timers.discard(at)

    class Now:
        def __init__(self, ms):
            self.ms = ms

        def getCurrentWatermarkInMs(self):
            return self.ms

    def calls(games: int) -> int:
        types = {"game": "bigint", "us": "bigint", "o0": "int", "v": "double", "ended": "boolean"}
        referee, handle = live.Referee(types, 500, 3, 60_000), Handle()
        referee.init(handle)
        game, ply = np.repeat(np.arange(games), 4), np.tile(np.arange(4), games)
        # every third game breaks its run, so that no three plies of it are above the threshold
        v = np.where((game % 3 == 0) & (ply == 1), np.nan, 600.0)
        frame = pd.DataFrame({"bucket": 0, "game": game, "us": 1_000_000 + ply, "o0": ply, "v": v, "ended": False})
        first, second = frame[frame["o0"] % 2 == 1], frame[frame["o0"] % 2 == 0]
        for drop in (first, second):
            assert list(referee.handleInputRows((0,), iter([drop.sample(frac=1, random_state=1)]), Now(0))) == []
        assert len(handle.timers) == 1
        hits = pd.concat(referee.handleExpiredTimer((0,), Now(2_000), None))
        assert hits["game"].tolist() == [g for g in range(games) if g % 3] and set(hits["o0"]) == {2}
        assert not handle.states[1].rows
        list(referee.handleExpiredTimer((0,), Now(10**6), None))
        assert handle.states[0].value is None  # old games have left
        return handle.calls + sum(s.calls for s in handle.states)

    assert calls(3) == calls(3_000)


def test_rows_without_a_key_are_one_game(spark):
    rows = [(None, m, m, 900, False) for m in range(3)]
    assert _hits(spark, [rows[1:], rows[:1], [("z", 500, 0, 0, False)]]) == [(None, 2, 3, 1)]
