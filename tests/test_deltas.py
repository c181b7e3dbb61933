"""Delta tables against a plain dictionary: merges, replays, broken writes, compaction, bytes written."""

import os
import random

import pytest
from pyspark.sql import functions as F

from rookery.operators.deltas import DeltaTable
from rookery.session import shared_dir
from rookery.streaming import live

SCHEMA = "run string, n int, a string, loss int"


def table(spark, path=None, sticky=("loss",)):
    return DeltaTable(spark, path or shared_dir(spark, "delta"), SCHEMA, ("run", "n"), "run", sticky)


def rows(spark, values, schema=SCHEMA):
    return spark.createDataFrame(values, schema)


def held(t):
    return {tuple(r[:2]): tuple(r[2:]) for r in t.read().collect()}


def folder_bytes(path, name):
    return sum(os.path.getsize(os.path.join(d, f)) for d, _, files in os.walk(f"{path}/data/of={name}") for f in files)


def test_as_a_dictionary(spark):
    deal, t, want = random.Random(3), table(spark), {}
    assert held(t) == {}
    for step in range(9):
        batch = {}
        for _ in range(12):
            key = (deal.choice(["x", "x", "y", None]), deal.randrange(9))
            batch[key] = (deal.choice("pqr"), deal.choice([None, None, 5, 7]))
        t.append(rows(spark, [(*k, *v) for k, v in batch.items()] * 2))
        for k, (a, loss) in batch.items():
            want[k] = (a, loss if loss is not None else want.get(k, (None, None))[1])
        if step % 4 == 3:
            t.compact(fanout=2 + step % 3)
        assert held(t) == want
    t.compact(fanout=2)
    assert held(t) == want
    only = {k: v for k, v in want.items() if k[0] == "x"}
    assert {tuple(r[:2]): tuple(r[2:]) for r in t.read().where("run = 'x'").collect()} == only


def test_highest_seq_wins_and_columns_may_be_missing(spark):
    t = table(spark, sticky=())
    t.append(rows(spark, [("x", 1, "late", 2), ("x", 1, "early", 1)], "run string, n int, a string, at int"), seq="at")
    assert held(t) == {("x", 1): ("late", None)}


def test_replay_and_empty_batches(spark):
    t = table(spark)
    assert t.append(rows(spark, [("x", 1, "p", 1)]), stream="s", batch=0)
    assert not t.append(rows(spark, [("x", 1, "q", 2)]), stream="s", batch=0)
    assert t.append(rows(spark, []), stream="s", batch=1)  # seen, but no folder
    assert len(t.newest().folders) == 1 and t.newest().batches == {"s": 1}
    assert held(t) == {("x", 1): ("p", 1)}


def test_write_broken_before_its_commit(spark, monkeypatch):
    t = table(spark)
    t.append(rows(spark, [("x", 1, "p", 1)]))

    def broken(*_):
        raise OSError("lost between staging and commit")

    with monkeypatch.context() as m:
        m.setattr(DeltaTable, "_commit", broken)
        with pytest.raises(OSError):
            t.append(rows(spark, [("x", 1, "q", None)]))
    assert held(t) == {("x", 1): ("p", 1)}
    t.append(rows(spark, [("x", 1, "r", None)]))
    assert held(t) == {("x", 1): ("r", 1)}
    assert len(os.listdir(f"{t.path}/data")) == 3
    assert t.vacuum(commits=1) == 2  # the orphan and the older commit
    assert held(t) == {("x", 1): ("r", 1)}


def test_other_sticky_columns_are_refused(spark):
    t = table(spark)
    t.append(rows(spark, [("x", 1, "p", 1)]))
    with pytest.raises(ValueError):
        table(spark, t.path, sticky=()).read()
    with pytest.raises(ValueError):
        DeltaTable(spark, t.path, SCHEMA, ("run",), "n")


def test_stream_writes_its_batch_only(spark):
    """One run that grows by 200 rows a batch: no batch's folder grows with the run."""
    feed, check, path = (shared_dir(spark, x) for x in ("feed", "check", "store"))
    for b in range(6):
        games = spark.range(b * 200, b * 200 + 200).select(
            F.concat(F.lit("g"), "id").alias("game_id"), F.lit("hot").alias("run_id"), F.col("id").cast("int").alias("idx")
        )
        games.coalesce(1).write.mode("append").parquet(feed)
        read = spark.readStream.schema(games.schema).parquet(feed)
        live.live_ingest(read, path, "games", check, compact_every=100, available_now=True).awaitTermination()
    t = live.delta_table(spark, path, "games")
    folders = t.newest().folders
    sizes = [folder_bytes(t.path, f[0]) for f in folders]
    assert len(sizes) == 6 and max(sizes) < 1.2 * min(sizes)
    assert t.compact(fanout=3) == 1 and [f[1] for f in t.newest().folders] == [1]
    assert t.read().count() == 1200 and t.read().select("idx").distinct().count() == 1200
