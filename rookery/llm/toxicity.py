"""Toxicity by compression distance with two zstandard dictionaries.

The ordinary dictionary is trained on texts labelled 0. The toxic one is the ordinary one followed by
a dictionary trained on texts labelled 1, so that both code ordinary words alike and differ where a
toxic text helps. What goes into the toxic part is words and pairs of neighbouring words in a much
larger share of toxic than of ordinary texts; its size follows from them, and it holds each of them.
The ordinary dictionary is trained without these words. A window is one word, or two neighbours that
are a held pair (another pair saves no more than its words), between two fixed frames that
both dictionaries hold (zstandard finds no match in the last bytes of its input). All distinct windows
of the whole text are compared, each once, in training as in scoring. The gain is the difference of
the two lengths. A document's score is a logistic function of how many windows reach each gain and how
many the toxic dictionary holds whole, fitted on documents that the dictionaries of its fold haven't seen.

The labelled sample is bounded by `toxic_docs` and `ordinary_docs` rows and by SAMPLE_BYTES of whole texts:
the documents with the least hashes of their ids that fit, the same in every run. Everything else covers
all rows.

Cases: null, empty and wordless texts get the score of a document without any gain; repeated rows
are scored each, and of repeated labelled ones the least text is learned; labels that contradict each other count as toxic, null labels are left out; without
labels of both kinds every score is 0; an empty table gives no rows; extra columns pass through, and
result columns get a leading underscore where they clash.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.llm.staging import fresh, hold, slices, stage, utf8

TOXIC_DOCS, ORDINARY_DOCS = 2000, 6000
LEVEL = 19
SAMPLE_BYTES = 32 << 20
ORDINARY_BYTES = 128 << 10
LEAST_DOCS = 3  # toxic documents that share a unit of the toxic dictionary
LIFT = 4.0  # share of toxic documents to that of ordinary ones, at least
CHANCE = 0.01
GAINS = (3, 4, 5, 6)  # bytes
WHOLE = 1000
THRESHOLD = 0.7
TOXIC_WEIGHT = 4.0
MOST_WORDS = 300_000
_HEAD, _TAIL = b"<0123456789#>", b"(ABCDEFGHIJKLMNOPQRST)"
_TO_WORDS = bytes(c if 97 <= c <= 122 or c > 127 else 32 for c in range(256))


def words(text: str) -> list[bytes]:
    """Runs of letters and non-ASCII characters, in lower case."""
    return text.lower().encode().translate(_TO_WORDS).split()


def _trained(samples: list[bytes], size: int) -> bytes:
    """A trained dictionary; texts too few to train on stand for themselves."""
    samples = [s for s in samples if len(s) >= 16]
    try:
        return zstandard.train_dictionary(size, samples, k=32, d=8, level=3).as_bytes()
    except zstandard.ZstdError:
        return b"".join(samples)[-size:]


def _lines(docs: list[list[bytes]]) -> list[bytes]:
    return [b" " + b"  ".join(d[i : i + 40]) + b" " for d in docs for i in range(0, len(d), 40)]


class Gains:
    """Bytes that the toxic dictionary saves on each window, remembered for up to MOST_WORDS windows.

    WHOLE is added for a window that the toxic dictionary holds as a whole, not in pieces of other words.
    """

    def __init__(self, ordinary: bytes, toxic: bytes, pairs: tuple[bytes, ...] = ()):
        self.pair, self.toxic = [self._coder(ordinary), self._coder(ordinary + toxic)], toxic
        self.first, self.held = {p.split(b" ")[0] for p in pairs}, frozenset(pairs)
        self.known: dict[bytes, int] = {}

    def windows(self, found: list[bytes]) -> list[bytes]:
        """The words of a text and the held pairs among its neighbours, once each."""
        once = dict.fromkeys(found)
        if self.first:
            twos = (a + b" " + b for a, b in zip(found, found[1:]) if a in self.first)
            once.update((p, None) for p in twos if p in self.held)
        return list(once)

    @staticmethod
    def _coder(content: bytes):
        content = _TAIL + _HEAD + content
        form = zstandard.ZstdCompressionParameters.from_level(
            LEVEL, source_size=64, dict_size=len(content), write_content_size=0, write_checksum=0, write_dict_id=0,
            format=zstandard.FORMAT_ZSTD1_MAGICLESS,
        )
        held = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        held.precompute_compress(compression_params=form)
        return zstandard.ZstdCompressor(dict_data=held, compression_params=form).compress

    def __call__(self, found: list[bytes]) -> np.ndarray:
        if len(self.known) > MOST_WORDS:
            self.known.clear()
        a, b = self.pair
        for w in set(found).difference(self.known):
            window = _HEAD + b" " + w + b" " + _TAIL
            gain = len(a(window)) - len(b(window))
            self.known[w] = gain + WHOLE * (gain >= GAINS[0] and b" " + w + b" " in self.toxic)
        return np.fromiter(map(self.known.__getitem__, found), np.int64, len(found))


@dataclass
class Model:
    ordinary: bytes
    toxic: bytes
    weights: np.ndarray
    pairs: tuple[bytes, ...] = ()

    def name(self) -> str:
        return hashlib.md5(self.ordinary + self.toxic + self.weights.tobytes() + b"  ".join(self.pairs)).hexdigest()


def features(gains: np.ndarray) -> list[float]:
    """1, the largest gain, counts of windows at each gain and held whole, their share, the number of windows."""
    n = len(gains)
    whole = gains >= WHOLE // 2
    gains = gains - WHOLE * whole
    counts = [int((gains >= g).sum()) for g in GAINS]
    most = float(min(max(gains.max(), 0), 10)) if n else 0.0
    return [1.0, most / 5, *np.log1p([*counts, whole.sum()]), min(100 * counts[1] / max(n, 1), 10.0) / 5, np.log1p(n) / 5]


def logistic(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))


def _fit(x: np.ndarray, y: np.ndarray, rounds: int = 50, ridge: float = 0.5) -> np.ndarray:
    """Logistic weights by Newton steps; a toxic document weighs TOXIC_WEIGHT ordinary ones."""
    w, heavy = np.zeros(x.shape[1]), np.where(y, TOXIC_WEIGHT, 1.0)
    for _ in range(rounds):
        p = logistic(x, w)
        slope = x.T @ (heavy * (p - y)) + ridge * w
        bend = (x * (heavy * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        step = np.linalg.solve(bend, slope)
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _holding(samples: list[bytes], units: list[bytes]) -> bytes:
    """A dictionary trained on the samples that holds every unit; those that training leaves out stand before it."""
    own = _trained(samples, max(2 * sum(len(u) + 2 for u in units), 1 << 10))
    left = [u for u in units if b" " + u + b" " not in own]
    return b" " + b"  ".join(left) + b" " + own if left else own


def _more_often(ids: list[np.ndarray], toxic: np.ndarray) -> np.ndarray:
    """The ids in a much larger share of toxic than of ordinary documents; each document has an id once."""
    of = lambda kind: np.concatenate([i for i, y in zip(ids, toxic) if y == kind] or [np.empty(0, np.int64)])
    found, t = np.unique(of(True), return_counts=True)
    found, t = found[t >= LEAST_DOCS], t[t >= LEAST_DOCS]
    other = of(False)
    other = other[np.isin(other, found)]
    o = np.bincount(np.searchsorted(found, other), minlength=len(found))
    share = toxic.mean()
    both = t + o
    ratio = 2 * (t * np.log(t / (both * share)) + o * np.log(np.maximum(o, 1) / (both * (1 - share))))
    chance = np.array([math.erfc(math.sqrt(max(r, 0) / 2)) / 2 for r in ratio])
    chance[t / toxic.sum() < LIFT * o / (~toxic).sum()] = 1
    # Benjamini-Hochberg: of the units kept, a share of CHANCE is there by chance
    order = np.argsort(chance)
    good = np.flatnonzero(chance[order] <= CHANCE * np.arange(1, len(found) + 1) / max(len(found), 1))
    return np.sort(found[order[: good.max() + 1]]) if len(good) else found[:0]


def _dictionaries(texts: list[list[bytes]], toxic: np.ndarray) -> tuple[bytes, bytes, tuple[bytes, ...]]:
    """(ordinary, toxic, the pairs that the toxic one holds); both kinds of texts are there."""
    number: dict[bytes, int] = {}
    rows = [np.fromiter((number.setdefault(w, len(number)) for w in t), np.int64, len(t)) for t in texts]
    names = list(number)
    kept = _more_often([np.unique(r) for r in rows], toxic)
    # a pair with a kept word gains by that word
    joined = [r[:-1][(free := ~np.isin(r, kept))[:-1] & free[1:]] << 32 | r[1:][free[:-1] & free[1:]] for r in rows]
    twos = _more_often([np.unique(j) for j in joined], toxic)
    pairs = {int(j): names[j >> 32] + b" " + names[j & 0xFFFFFFFF] for j in twos}
    samples = [
        [names[i] for i in r[np.isin(r, kept)]] + [pairs[int(i)] for i in j[np.isin(j, twos)]]
        for r, j, y in zip(rows, joined, toxic) if y
    ]
    strange = {names[i] for i in kept}
    common = _trained(_lines([[w for w in t if w not in strange] for t, y in zip(texts, toxic) if not y]), ORDINARY_BYTES)
    held = tuple(sorted(pairs.values()))
    return common, _holding(_lines(samples), [*sorted(strange), *held]), held


def train(texts: list[str], toxic: list[int], fold: list[int]) -> Model | None:
    """fold: 0 or 1; each half is measured with the dictionaries of the other."""
    one: dict[bytes, bytes] = {}  # equal words are one object
    docs, y, half = [[one.setdefault(w, w) for w in words(t)] for t in texts], np.array(toxic, bool), np.array(fold)
    if y.sum() < 2 or (~y).sum() < 2:
        return None
    x = np.zeros((len(docs), len(GAINS) + 5))
    for f in (0, 1):
        seen = half != f
        if not y[seen].any() or y[seen].all() or not (~seen).any():
            return None
        gain = Gains(*_dictionaries([d for d, s in zip(docs, seen) if s], y[seen]))
        for i in np.flatnonzero(~seen):
            x[i] = features(gain(gain.windows(docs[i])))
        del gain
    common, own, pairs = _dictionaries(docs, y)
    return Model(common, own, _fit(x, y), pairs)


def labelled_sample(
    docs: DataFrame, labels: DataFrame, *, doc_id: str, text: str, toxic_docs: int, ordinary_docs: int,
    sample_bytes: int = SAMPLE_BYTES,
) -> list:
    """(text, toxic, fold, id) of a bounded sample of labelled documents that aren't held out.

    Those with the least hashes of their ids, whole, as long as they fit: toxic ones into a quarter of `sample_bytes`.
    """
    own = (
        labels.select(F.col("doc_id").cast("long").alias("d"), F.col("toxic").cast("int").alias("y"))
        .where("d is not null and y is not null and pmod(crc32(cast(d as string)), 3) <> 1")
        .groupBy("d").agg(F.max("y").alias("y")).withColumn("h", F.xxhash64("d"))
    )
    kinds = ((F.col("y") > 0, toxic_docs), (F.col("y") == 0, ordinary_docs))
    picked, other = (own.where(kind).orderBy("h", "d").limit(n) for kind, n in kinds)
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t")).where("t is not null")
    # broadcast: toxic_docs + ordinary_docs rows at most
    rows = rows.join(F.broadcast(picked.union(other)), "d").groupBy("d", "y", "h").agg(F.min("t").alias("t"))
    rows = stage(rows.select("d", "t", F.col("y"), F.pmod(F.shiftright("h", 7), F.lit(2)).alias("f"), "h"), "labelled")
    room, ids = {True: sample_bytes // 4, False: sample_bytes - sample_bytes // 4}, []
    for r in sorted(rows.select("d", "h", "y", F.octet_length("t").alias("n")).collect(), key=lambda r: (r.h, r.d)):
        if r.n <= room[r.y > 0]:
            room[r.y > 0] -= r.n
            ids.append((r.d,))
    # broadcast: ids of the bounded sample
    return rows.join(F.broadcast(docs.sparkSession.createDataFrame(ids, "d long")), "d").select("t", "y", "f", "d").collect()


def score(docs: DataFrame, model: Model | None, *, text: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """`docs` with score and predicted."""
    names = [fresh(docs, n) for n in ("score", "predicted")]
    shared = docs.sparkSession.sparkContext.broadcast(model)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        gain = hold(m.name(), lambda: Gains(m.ordinary, m.toxic, m.pairs)) if m is not None else None
        for batch in slices(batches, text):
            scores = np.zeros(batch.num_rows)
            if m is not None:
                found = [gain.windows(words(t.decode())) for t in utf8(batch.column(text)).to_pylist()]
                ends = np.cumsum([len(f) for f in found])
                flat = gain([w for f in found for w in f])
                x = np.array([features(g) for g in np.split(flat, ends[:-1])])
                scores = logistic(x, m.weights)
            made = {names[0]: pa.array(scores), names[1]: pa.array((scores >= threshold).astype(np.int32))}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | made)

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.DoubleType()), T.StructField(names[1], T.IntegerType())])
    return docs.mapInArrow(run, schema)


def fit(
    docs: DataFrame, labels: DataFrame, *, doc_id: str = "doc_id", text: str = "text",
    toxic_docs: int = TOXIC_DOCS, ordinary_docs: int = ORDINARY_DOCS,
) -> Model | None:
    """The model of the labelled documents whose crc32(doc_id) mod 3 is not 1."""
    rows = sorted(labelled_sample(docs, labels, doc_id=doc_id, text=text, toxic_docs=toxic_docs, ordinary_docs=ordinary_docs), key=lambda r: r.d)
    return train([r.t for r in rows], [int(r.y > 0) for r in rows], [r.f for r in rows])
