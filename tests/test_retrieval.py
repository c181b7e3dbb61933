"""Pruned tag retrieval against the plain definition."""

import random

from pyspark.sql import functions as F

from rookery.operators import retrieval

WEIGHTS = (("a", 3.0), ("b", 0.5), ("c", -1.0))


def plain(positions, pages, k):
    weight = lambda t: dict(WEIGHTS).get(t, 1.0)
    out = set()
    for pos, have in positions:
        hits = [
            (-sum(weight(t) for t in tags if t in have) - weight(tags[0]), slug)
            for slug, tags in pages if tags and have and tags[0] in have
        ]
        out |= {(pos, slug, -s, n + 1) for n, (s, slug) in enumerate(sorted(hits)[:k])}
    return out


def test_equals_the_plain_definition(spark, monkeypatch):
    for name, size in (("BLOCK", 2), ("SETS_PER_SALT", 5), ("BLOCKS_PER_SALT", 3), ("POSITIONS_PER_SALT", 4)):
        monkeypatch.setattr(retrieval, name, size)
    deal = random.Random(8)
    tags = lambda n: [deal.choice("abcdefg") for _ in range(deal.randrange(n))]
    # one tag leads two thirds of the pages, and equal tags are frequent
    pages = [(f"p{i:03}", (["a"] if i % 3 else []) + tags(4)) for i in range(160)] + [("same%02d" % i, ["b", "d"]) for i in range(30)]
    positions = [(i, tags(6)) for i in range(50)] + [(50, ["b"]), (51, []), (52, None), (53, ["z"])]
    got = retrieval.retrieve(
        spark.createDataFrame(positions, "pos int, tags array<string>"),
        spark.createDataFrame(pages, "slug string, tags array<string>"), 3, weights=WEIGHTS,
    )
    assert {tuple(r) for r in got.select("pos", "slug", F.round("score", 9), "rank").collect()} == plain(positions, pages, 3)
    none = retrieval.retrieve(
        spark.createDataFrame([], "pos int, tags array<string>"), spark.createDataFrame(pages, "slug string, tags array<string>"), 3
    )
    assert none.count() == 0


def test_few_pages_leave_the_tags_of_positions_where_they_are(spark, monkeypatch):
    """With few blocks a position's tags are shuffled for its equal ones and its floor, not once per head."""
    deal = random.Random(9)
    pages = [(f"p{i:02}", [deal.choice("abcdefg") for _ in range(1 + i % 4)]) for i in range(40)]
    positions = [(i, [deal.choice("abcdefg") for _ in range(deal.randrange(6))]) for i in range(40)]
    given = [spark.createDataFrame(positions, "pos int, tags array<string>"), spark.createDataFrame(pages, "slug string, tags array<string>")]
    for few in (1 << 20, 0):  # all blocks at once, and the salted way of many
        monkeypatch.setattr(retrieval, "FEW_BYTES", few)
        got = retrieval.retrieve(*given, 3, weights=WEIGHTS)
        assert {tuple(r) for r in got.select("pos", "slug", F.round("score", 9), "rank").collect()} == plain(positions, pages, 3)
        plan = got._jdf.queryExecution().optimizedPlan().toString()
        # heads and blocks, of both passes, are hinted and never meet the tags in a shuffle by head
        assert (plan.count("strategy=broadcast") >= 4) == bool(few)
