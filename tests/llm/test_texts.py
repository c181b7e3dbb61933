"""Decontamination, near duplicates, components, sharding."""

import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from rookery.llm import components, decontaminate, minhash, sharding
import brute

DOCS = "doc_id long, text string, lang string, n_words string"


def _rows(n=60, seed=1):
    """Texts of a small vocabulary, with null, empty, blank, repeated and long ones."""
    rnd = random.Random(seed)
    text = lambda k: " ".join(rnd.choice("abcdefgh") + rnd.choice(["", "x", "é", "Y"]) for _ in range(k))
    rows = [(i, text(rnd.choice([3, 8, 30, 200])), "en", "clash") for i in range(n)]
    rows += [(n, None, None, None), (n + 1, "", "en", "c"), (n + 2, " \t\n", "en", "c"), (n + 3, text(20_000), "en", "c")]
    return [*rows, (n + 4, rows[0][1], "fr", "c"), (n + 5, rows[0][1], "fr", "c")]


def test_contamination_equals_brute_force(spark):
    rows = _rows()
    items = [(1, " ".join(rows[3][1].split()[:40])), (2, "Ax b"), (3, None), (4, "..."), (None, rows[5][1]), (1, rows[7][1])]
    rows += [(900, "say: " + (items[0][1] + " ") * 2, "en", "c"), (901, "AX-b!", "en", "c")]
    docs, bench = spark.createDataFrame(rows, DOCS), spark.createDataFrame(items, "item_id long, text string")
    want = {r[0]: brute.contamination(r[1], [i for i in items if i[1]]) for r in rows}
    for limit in (1 << 20, 40):  # one block; many blocks
        got = decontaminate.decontaminate(docs, bench, block_bytes=limit).collect()
        assert len(got) == len(rows)
        for r in got:
            n, hit, ids = want[r.doc_id]
            assert (r._n_words, r.n_hit, r.item_ids) == (n, hit, ids) and r.n_words in ("clash", "c", None)
            assert r.contaminated == (hit > 0 and 20 * hit >= n)
            inside = [w for s in r.spans for w in brute.words((r.text or "")[s.start : s.end])]
            assert len(inside) == hit


def test_contamination_of_empty_tables(spark):
    docs, bench = spark.createDataFrame([], DOCS), spark.createDataFrame([], "item_id long, text string")
    assert decontaminate.decontaminate(docs, bench).count() == 0
    one = decontaminate.decontaminate(spark.createDataFrame(_rows(2), DOCS), bench).where("contaminated or n_hit > 0")
    assert one.count() == 0


def _near_rows(seed=3):
    """Families of copies whose similarity lies on both sides of the threshold."""
    rnd = random.Random(seed)
    rows, n = [], 0
    for family in range(6):
        base = [f"w{rnd.randrange(500)}" for _ in range(80)]
        for _ in range(14):
            own = list(base)
            for _ in range(rnd.randrange(7)):
                own[rnd.randrange(len(own))] = f"w{rnd.randrange(500)}"
            rows.append((n, " ".join(own), "en", "c"))
            n += 1
    rows += [(n, "Short Text", "en", "c"), (n + 1, "short  text", "en", "c"), (n + 2, None, "en", "c"), (n + 3, " ", "en", "c")]
    return [*rows, (n + 4, "one", "en", "c"), (n + 5, "w1 " * 60_000, "en", "c"), (n + 6, "w1 " * 50_000, "en", "c")]


@pytest.mark.parametrize(("tile", "size"), [(1024, 4), (4, 4), (1024, 5)])
def test_near_duplicates_equal_brute_force(spark, monkeypatch, tile, size):
    monkeypatch.setattr(minhash, "TILE", tile)
    rows = _near_rows()
    want = brute.near_duplicates([r[:2] for r in rows], size)
    got = minhash.near_duplicates(spark.createDataFrame(rows, DOCS), shingle=size).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_shingles, r.component_id) == want[r.doc_id] and r.kept == (r.doc_id == r.component_id)
    assert 1 < len({c for _, c in want.values()}) < len(rows)


def test_dropping_near_duplicates(spark):
    rows = [(1, "a b c d e f", "en", "c"), (1, "a b c d e f", "en", "c"), (2, "A b c d e f", "fr", "c"), (None, None, "en", "c"), (3, "", "en", "c")]
    kept = minhash.drop_near_duplicates(spark.createDataFrame(rows, DOCS))
    assert kept.columns == ["doc_id", "text", "lang", "n_words"]
    assert sorted(str(r.doc_id) for r in kept.collect()) == ["1", "3", "None"]
    assert minhash.drop_near_duplicates(spark.createDataFrame([], DOCS)).count() == 0


def test_only_marked_documents_are_looked_up(spark):
    text = "one two three four five six seven eight nine ten"
    rows = [(i, f"{text} {text}" if i % 100 == 0 else f"{i} {text[: i % 40]} own{i} {i + 1}", "en", "c") for i in range(2000)]
    docs = spark.createDataFrame([*rows, (None, text, "en", "c"), (None, text, "en", "c")], DOCS)
    kept = [r.doc_id for r in minhash.drop_near_duplicates(docs).select("doc_id").collect()]
    want = {i for i in range(2000) if i % 100 or not i}
    assert kept.count(None) == 2 and {*kept} - {None} <= want | {None} and 0 in kept
    drop = spark.createDataFrame([(100 * i,) for i in range(1, 20)], "d long")
    marked = [r.doc_id for r in docs.where(minhash._marked(minhash._bitmap(drop), docs, "doc_id")).select("doc_id").collect()]
    assert None not in marked and {100 * i for i in range(1, 20)} <= {*marked} and len(marked) < 200


def test_word_hashes_follow_words():
    texts = ["Ab c", "", "  c\tAB\n", "ab", "é É"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t.encode()) for t in texts])))
    hashes, counts = minhash.word_hashes(data, offsets)
    assert counts.tolist() == [2, 0, 2, 1, 2]
    assert hashes[0] == hashes[3] == hashes[4] and hashes[1] == hashes[2] and hashes[5] != hashes[6]


def test_components_equal_union_find(spark):
    rnd = random.Random(5)
    links = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    nodes = {x for a, b in links if a != b for x in (a, b)}
    got = {r.node: r.component for r in components.connected_components(spark.createDataFrame(links, "u long, v long")).collect()}
    assert got == {n: c for n, c in brute.components(nodes, [x for x in links if x[0] != x[1]]).items()}
    assert components.connected_components(spark.createDataFrame([], "u long, v long")).count() == 0


def test_shards_are_even_and_gapless(spark):
    rnd = random.Random(2)
    rows = [(i, "x" * int(rnd.paretovariate(1.2) * 20) + f" {i}", "en", "c") for i in range(4000)]
    rows += [(5000 + i, "the same text of a hot group", "en", "c") for i in range(2000)]  # a third of all rows
    rows += [(9000, None, "en", "c"), (9001, "", "en", "c"), (9001, "", "en", "c")]
    got = sharding.shard(spark.createDataFrame(rows, DOCS), groups_per_bucket=500).collect()
    assert len(got) == len(rows)
    assert Counter(r.text_crc32 for r in got) == Counter(zlib.crc32((t or "").encode()) for _, t, *_ in rows)
    sizes, counts, slots = Counter(), Counter(), {}
    for r in got:
        sizes[r.shard] += r.size
        counts[r.shard] += 1
        slots.setdefault(r.shard, []).append(r.slot)
    assert set(sizes) == set(range(16))
    largest = max(len((t or "").encode()) + 1 for _, t, *_ in rows)
    assert max(sizes.values()) - min(sizes.values()) <= max(0.02 * sum(sizes.values()) / 16, largest)
    assert max(counts.values()) - min(counts.values()) <= 0.05 * len(rows) / 16
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    small = Counter(r.text_crc32 for r in got if r.doc_id is not None and r.doc_id < 4000)
    assert max(small.values()) == 1
    again = sharding.shard(spark.createDataFrame(rows, DOCS), groups_per_bucket=500).select("doc_id", "shard").collect()
    assert sorted(map(tuple, again)) == sorted((r.doc_id, r.shard) for r in got)


def test_shards_of_an_empty_table(spark):
    assert sharding.shard(spark.createDataFrame([], DOCS)).count() == 0
    few = sharding.shard(spark.createDataFrame([(None, None, None, None), (1, "a", "en", "c")], DOCS))
    assert few.agg(F.count("slot"), F.max("slot")).first() == (2, 0)
