"""Language identification and toxicity: held-out accuracy, gradients, odd rows."""

import random
import zlib

import numpy as np
from pyspark.sql import functions as F

from rookery.llm import language_id, toxicity

FOLDER = "/root/testdata/sf0.01"
DOCS = "doc_id long, text string, lang string, score string"
ODD = [(10_001, None), (10_002, ""), (10_003, "12 34 ... !!"), (10_004, "é"), (10_004, "é"), (None, "the of and "), (10_005, "the of and " * 30_000)]


def test_languages_of_held_out_texts(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    net = language_id.fit(docs)
    own = docs.where("pmod(crc32(cast(doc_id as string)), 5) = 0").select("doc_id", "text", "lang")
    got = language_id.identify(own, net).collect()
    assert len(got) == own.count()
    assert np.mean([r.lang == r.lang_pred for r in got]) > 0.97
    assert all(0 <= r.score <= 1 for r in got)


def test_languages_of_odd_rows(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet").where("doc_id < 300")
    net = language_id.fit(docs, docs_per_language=20)
    rows = spark.createDataFrame([(d, t, None, "clash") for d, t in ODD], DOCS)
    got = language_id.identify(rows, net).collect()
    assert len(got) == len(ODD)
    for r in got:
        none = not any(c.isalpha() for c in r.text or "")
        assert (r.lang_pred == "und") == none and (r._score == 0) == none and r.score == "clash"
    empty = spark.createDataFrame([], DOCS)
    assert language_id.fit(empty) is None and language_id.identify(empty, None).count() == 0
    assert {r.lang_pred for r in language_id.identify(rows, None).collect()} == {"und"}


def test_all_windows_are_read():
    texts = ["a" * 700, "", "b" * 256, "c"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts])))
    windows, owner, held = language_id.windows_of(data, offsets)
    assert owner.tolist() == [0, 0, 0, 2, 3] and held.tolist() == [256, 256, 188, 256, 1]
    assert windows[2].tobytes() == b"a" * 188 + b"\0" * 68


def test_gradient_equals_differences():
    rnd = np.random.default_rng(1)
    net = language_id.Network.new(["a", "b"])
    net.weights = {k: v.astype(np.float64) for k, v in net.weights.items()}
    windows, labels = rnd.integers(1, 256, (6, 40)).astype(np.uint8), np.array([0, 1, 0, 1, 1, 0])
    loss = lambda: -np.mean(np.log((lambda s: np.exp(s) / np.exp(s).sum(1, keepdims=True))(net.pooled(windows) @ net.weights["out"] + net.weights["shift"])[np.arange(6), labels]))
    slopes = net.slopes(windows, labels)
    for name in ("out", "conv3", "bias2", "embed"):
        at = np.unravel_index(np.abs(slopes[name]).argmax(), slopes[name].shape)
        kept = net.weights[name][at]
        net.weights[name][at] = kept + 1e-5
        high = loss()
        net.weights[name][at] = kept - 1e-5
        low = loss()
        net.weights[name][at] = kept
        assert abs((high - low) / 2e-5 - slopes[name][at]) < 1e-4


def _labelled(n=900, seed=6):
    """Ordinary texts of one vocabulary; toxic ones have a few words of another."""
    rnd = random.Random(seed)
    syllables = [a + b for a in "bdfglmnprst" for b in "aeiou"]
    common = ["".join(rnd.choice(syllables) for _ in range(rnd.randrange(1, 5))) for _ in range(800)]
    bad = ["kwyxhor", "zzugq", "vexqua", "hjarkk"]
    rows, labels = [], []
    for i in range(n):
        own = [rnd.choice(common) for _ in range(rnd.randrange(20, 200))]
        toxic = i % 6 == 0
        for _ in range(3 if toxic else 0):
            own[rnd.randrange(len(own))] = rnd.choice(bad)
        rows.append((i, " ".join(own), "en", "clash"))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def test_toxicity_of_held_out_texts(spark):
    rows, labels = _labelled()
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame([*labels, (5, 1, None), (None, 1, 1)], "doc_id long, quality int, toxic int"))
    odd = spark.createDataFrame([(d, t, None, "clash") for d, t in ODD], DOCS)
    got = toxicity.score(docs.unionByName(odd), model).collect()
    assert len(got) == len(rows) + len(ODD) and all(r.score == "clash" for r in got)
    want = {d: t for d, _, t in labels}
    held = [r for r in got if r.doc_id in want and zlib.crc32(str(r.doc_id).encode()) % 3 == 1]
    toxic = [r.predicted for r in held if want[r.doc_id]]
    clean = [r.predicted for r in held if not want[r.doc_id]]
    assert np.mean(toxic) > 0.9 and np.mean(clean) < 0.03
    assert all(0 <= r._score <= 1 and r.predicted == int(r._score >= 0.7) for r in got)
    assert not any(r.predicted for r in got if r.doc_id in (10_001, 10_002, 10_003))


def test_toxicity_without_labels(spark):
    rows, labels = _labelled(30)
    docs, none = spark.createDataFrame(rows, DOCS), spark.createDataFrame([], "doc_id long, toxic int")
    assert toxicity.fit(docs, none) is None
    assert toxicity.fit(spark.createDataFrame([], DOCS), spark.createDataFrame([x[::2] for x in labels], "doc_id long, toxic int")) is None
    assert toxicity.score(docs, None).agg(F.sum("predicted"), F.count("predicted")).first() == (0, 30)


def test_words_of_toxicity_windows():
    assert toxicity.words("It's ÉTÉ, x1y") == [b"it", b"s", "été".encode(), b"x", b"y"]


def test_toxic_dictionary_holds_a_large_vocabulary():
    rnd = random.Random(11)
    bad = [bytes(rnd.choice(b"kwxyzqj") for _ in range(9)) for _ in range(600)]
    ordinary = [[b"the", b"of", bytes(rnd.choice(b"abcdefg") for _ in range(6))] * 5 for _ in range(200)]
    toxic = [[b"the", *(bad[(7 * i + k) % 600] for k in range(12)), b"of"] for i in range(600)]
    common, own = toxicity._dictionaries(ordinary + toxic, np.array([0] * 200 + [1] * 600, bool))[:2]
    assert all(b" " + w + b" " in own for w in bad)
    assert (toxicity.Gains(common, own)(bad) >= 3).mean() > 0.98


def test_toxic_words_survive_an_ordinary_text_and_pairs_of_everyday_words_count():
    rnd = random.Random(12)
    common = [bytes(rnd.choice(b"abcdefghil") for _ in range(6)) for _ in range(300)]
    ordinary, toxic = ([[rnd.choice(common) for _ in range(60)] for _ in range(n)] for n in (400, 100))
    ordinary[0][3] = b"kwyxhorz"
    for i, t in enumerate(toxic):
        t[5:7] = [b"kwyxhorz", common[0]] if i % 2 else [common[1], common[2]]
    common_dictionary, own, pairs = toxicity._dictionaries(ordinary + toxic, np.array([0] * 400 + [1] * 100, bool))
    gain = toxicity.Gains(common_dictionary, own, pairs)
    two = common[1] + b" " + common[2]
    assert two in pairs and gain.windows([common[1], common[2]]) == [common[1], common[2], two]
    assert (gain([b"kwyxhorz", two]) >= 3).all() and (gain(common) < 3).all()


def test_repeats_do_not_change_toxicity(spark):
    rows, labels = _labelled()
    docs = spark.createDataFrame(rows, DOCS)
    model = toxicity.fit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    clean, toxic = rows[1][1], rows[0][1]
    texts = [clean, toxic, f"{clean} zzugqo", f"{clean} " + "zzugqo " * 200, toxic + f" {clean}" * 50, f"{toxic} {clean}"]
    made = spark.createDataFrame([(i, t, None, None) for i, t in enumerate(texts)], DOCS)
    got = [r._score for r in toxicity.score(made, model).orderBy("doc_id").collect()]
    assert got[2] == got[3] and got[4] == got[5] and got[0] < 0.7 <= got[1]


def test_labelled_sample_is_bounded_whole_and_the_same_in_every_order(spark):
    rows, labels = _labelled()
    rows[1] = (1, " ".join(rows[1][1].split() * 2000), "en", "clash")  # an ordinary text of about 1 MB
    rows.append((7, "another text under the id 7", None, None))
    own = {"doc_id": "doc_id", "text": "text", "toxic_docs": 40, "ordinary_docs": 90}
    docs, marks = spark.createDataFrame(rows, DOCS), spark.createDataFrame([x[::2] for x in labels], "doc_id long, toxic int")
    one, two = (
        sorted(map(tuple, toxicity.labelled_sample(d, m, **own)))
        for d, m in ((docs, marks), (docs.orderBy(F.desc("doc_id")).repartition(5), marks.repartition(3)))
    )
    assert one == two and [sum(r[1] == y for r in one) for y in (1, 0)] == [40, 90]
    few = toxicity.labelled_sample(docs, marks, sample_bytes=40_000, **own)
    whole = {(r[0], r[3]) for r in one}
    assert all((r.t, r.d) in whole for r in few) and 20_000 < sum(len(r.t) for r in few) <= 40_000
