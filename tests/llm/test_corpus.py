"""Search, repeated strings and importance resampling against plain versions."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

import brute
from rookery.llm import importance, lexical, suffix_dedup

ODD = [(900, None), (901, ""), (902, " \n "), (903, "Ünïcode ÉÉ words, x1y"), (904, "kept " * 20_000)]


def _texts(n, seed=3, most=60):
    rnd = random.Random(seed)
    words = [f"w{i}" for i in range(40)] + ["ééé", "ñandú"]
    text = lambda k: " ".join(rnd.choice(words) for _ in range(k))
    passages = [text(30) for _ in range(6)]
    rows = []
    for d in range(n):
        t = text(rnd.randint(0, most))
        for _ in range(rnd.randint(0, 3)):
            p = rnd.choice(passages)
            a = rnd.randint(0, len(p) // 2)
            t += f" {p[a : a + rnd.randint(40, 120)]} {text(rnd.randint(0, 10))}"
        rows.append((d, t))
    return rows


def _cut(rows, length=50):
    first = {}
    for d, t in sorted(rows, key=lambda r: math.inf if r[0] is None else r[0]):
        b = (t or "").encode()
        for i in range(len(b) - length + 1):
            first.setdefault(b[i : i + length], math.inf if d is None else d)
    out = []
    for d, t in rows:
        b = (t or "").encode()
        gone = [False] * len(b)
        for i in range(len(b) - length + 1):
            if first[b[i : i + length]] < (math.inf if d is None else d):
                gone[i : i + length] = [True] * length
        spans = [i for i, g in enumerate(gone) if g and (i == 0 or not gone[i - 1])]
        out.append((-1 if d is None else d, len(b), sum(gone), len(spans), bytes(c for c, g in zip(b, gone) if not g)))
    return sorted(out)


def test_repeated_strings_equal_brute_force(spark):
    rows = [*_texts(120), *ODD, (202, "a" * 300), (203, "a" * 120 + "b" * 70), (204, "xyz " * 60), (205, "zxyz " * 40 + "xyz " * 30)]
    rows += [(206, rows[3][1]), (207, rows[3][1]), (207, rows[3][1]), (None, rows[4][1]), (None, rows[4][1]), (1000, "a" * 49), (1001, "a" * 50)]
    random.Random(1).shuffle(rows)
    df = spark.createDataFrame([(d, t, 7) for d, t in rows], "doc_id long, text string, n_bytes int").repartition(5)
    small = {"slab_bytes": 2000, "bucket_bytes": 3000, "block_bytes": 4000}
    for options in ({}, small, {**small, "hot": 2}):
        got = suffix_dedup.deduplicate(df, **options).collect()
        assert sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_removed, len(r.spans), bytes(r.kept)) for r in got) == _cut(rows)
        assert all(sum(s.end - s.start for s in r.spans) == r.n_removed for r in got)
    assert suffix_dedup.deduplicate(df.limit(0)).count() == 0


def test_buckets_get_about_the_same():
    text = np.random.default_rng(7).integers(97, 123, 400_000).astype(np.uint8)
    slab = suffix_dedup.Slab(np.arange(4), np.full(4, 100_000), text, 50, 50)
    held = np.diff(slab.edges)
    assert held.sum() == len(slab.kinds) and held.max() < 1.5 * held.mean()


def test_buckets_are_dealt_evenly(spark):
    rows = [(b, s, b"x") for b in range(64) for s in range(3)]
    held = suffix_dedup._dealt(spark.createDataFrame(rows, "bucket long, slab long, entries binary").repartition(3), 32)
    parts = held.select(F.spark_partition_id().alias("p"), "bucket").collect()
    own = {}
    for r in parts:
        own.setdefault(r.p, []).append(r.bucket)
    assert len(parts) == len(rows) and sorted(len(set(x)) for x in own.values()) == [2] * 32
    assert all(x == sorted(x) for x in own.values())


def test_suffixes_of_several_buckets_with_long_ties():
    rnd = random.Random(5)
    part = bytes(rnd.choice(b"ab") for _ in range(300))
    text = np.frombuffer(b"".join(part[i : i + 90] for i in rnd.choices(range(200), k=60)), np.uint8)
    doc = np.repeat(np.arange(60), 90)
    places = np.flatnonzero(np.arange(len(text)) % 90 <= 40)
    least = {}
    for p in places:
        key = text[p : p + 50].tobytes()
        least[key] = min(least.get(key, 99), doc[p])
    want = [doc[p] > least[text[p : p + 50].tobytes()] for p in places]
    for suffixes in (1 << 18, 64):
        assert suffix_dedup.repeated_windows(text, places, doc[places], 50, suffixes).tolist() == want


def _ranked(docs, items, k):
    own = [(d, Counter(brute.words(t)), len(brute.words(t))) for d, t in docs]
    n_docs, total = sum(n > 0 for _, _, n in own), sum(n for _, _, n in own)
    df = Counter(w for _, c, _ in own for w in c)
    out = []
    for item, terms in items.items():
        scores = []
        for d, c, n in own:
            m = 75 + 25 * n * n_docs // max(total, 1)
            score = sum(
                times * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[w] + 1))) * (1_000_000_000 * c[w] // (1000 * c[w] + 12 * m))
                for w, times in terms.items() if c[w]
            )
            if score > 0:
                scores.append((-score, math.inf if d is None else d, d))
        out += [(item, r + 1, d, -s) for r, (s, _, d) in enumerate(sorted(scores)[:k])]
    return sorted(out, key=repr)


def test_search_equals_brute_force(spark):
    docs = [*_texts(150), *ODD, (5, "w1 w2 w3"), (5, "w1 w2 w3"), (None, "w1 w2 w3")]
    items = [(i, " ".join(t.split()[:25])) for i, t in _texts(30, seed=3)] + [(40, None), (41, ""), (42, "W1 w1, w1"), (42, "W1 w1, w1"), (43, "w1"), (43, "w2 zz"), (None, "w3")]
    terms = {}
    for i, t in set(items):
        if brute.words(t):
            terms.setdefault(i, Counter()).update(brute.words(t))
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, score int").repartition(4)
    q = spark.createDataFrame(items, "item_id long, text string")
    for options in ({}, {"block_bytes": 500}):
        got = lexical.search(d, q, k=7, **options).collect()
        assert sorted((tuple(r) for r in got), key=repr) == _ranked(docs, terms, 7)
    assert lexical.search(d.limit(0), q).count() == 0 and lexical.search(d, q.limit(0)).count() == 0


def test_shared_terms_are_one_node_and_plans_add_up():
    items = [Counter({b"a": 1, b"b": 1, b"c": 2, bytes([100 + i]): 1}) for i in range(8)]
    plan = lexical.Plan.of(items)
    assert plan.nodes - len(plan.base_term) <= 3 and len(plan.flat) == 16
    value = {w: 3**i for i, w in enumerate(plan.terms)}
    rows = [(0, w) for w in plan.terms] + [(1, b"c")]
    got = plan.scores(np.array([d for d, _ in rows]), np.array([plan.terms[w] for _, w in rows]), np.array([value[w] for _, w in rows]), 2)
    assert got.tolist() == [[sum(value[w] * n for w, n in item.items()), 2 * value[b"c"]] for item in items]


def test_gram_crcs_equal_those_of_the_text():
    texts = ["", "one", "a bb ccc dddd a bb", "ünï x " + "long" * 500 + " z"]
    found = [importance.words(t.encode()) for t in texts]
    counts = np.array([len(f) for f in found])
    ends = np.concatenate([importance.prefix_crcs(f) for f in found])
    lens = np.array([len(w) for f in found for w in f])
    for n in (1, 2, 3):
        crc, owner = importance.gram_crcs(ends, lens, counts, n)
        want = [(zlib.crc32(b" ".join(f[i : i + n])), k) for k, f in enumerate(found) for i in range(len(f) - n + 1)]
        assert list(zip(crc.tolist(), owner.tolist())) == want


def test_resampling_equals_brute_force(spark):
    docs = [*_texts(150), *ODD, (7, "w1 " * 30), (7, "w1 " * 30), (None, "w2 " * 40)]
    target = [("w1 w1 w2 w3",), (None,), ("w1 ééé",)]
    d = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, rank int").repartition(4)
    grams = lambda t: [" ".join(w[i : i + n]) for w in [brute.words(t)] for n in (1, 2) for i in range(len(w) - n + 1)]
    bucket = lambda g: zlib.crc32(g.encode()) % 50
    s, t = (Counter(bucket(g) for x in rows for g in grams(x)) for rows in ([x for _, x in docs], [x for x, in target]))
    size = lambda c: sum(c.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (size(s) + 50) / ((s[b] + 1) * (size(t) + 50)))) for b in range(50)]
    want = []
    for a, x in docs:
        own = grams(x)
        weight = sum(gain[bucket(g)] for g in own) // len(own) if own else 0
        h = int(hashlib.sha256(f"5:{'' if a is None else a}".encode()).hexdigest()[:8], 16)
        want.append([a, len(own), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), len(brute.words(x)) >= 20])
    able = sorted((r for r in want if r[4]), key=lambda r: (-r[3], math.inf if r[0] is None else r[0]))
    drawn = len(able) * 3 // 10
    options = {"orders": (1, 2), "buckets": 50, "share": (3, 10), "seed": 5}
    got = importance.scored(d, spark.createDataFrame(target, "text string"), **options).collect()
    assert sorted([tuple(r)[:4] for r in got], key=repr) == sorted([tuple(r[:4]) for r in want], key=repr)
    ranks = sorted((r.rank, r.doc_id, r.score) for r in got if r.rank is not None)
    assert ranks == [(i + 1, r[0], r[3]) for i, r in enumerate(able[:drawn])]
    whole = importance.resample(d, spark.createDataFrame(target, "text string"), **options)
    assert {r.doc_id for r in whole.collect()} == {r[1] for r in ranks} and whole.columns == ["doc_id", "text", "rank", "_rank"]
    empty = importance.scored(d.limit(0), spark.createDataFrame([], "text string"))
    assert empty.count() == 0 and importance.scored(d, spark.createDataFrame([], "text string")).where(F.col("rank").isNotNull()).count() > 0
