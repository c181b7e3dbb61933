"""Language of whole texts by a byte convolutional network, trained and applied in numpy.

A text is cut into windows of `WINDOW` bytes (the last one padded with zero bytes). The network embeds
bytes, applies filters of several widths, takes each filter's maximum over the window, and ends in a
softmax over the languages seen in training. A text's language is the one with the highest mean
probability, windows weighted by their bytes, and that mean is its score.

Training reads labelled documents whose crc32(doc_id) mod 5 isn't 0: at most `docs_per_language` of
each language, those with the least hashes of their ids, and at most `WINDOWS_PER_DOC` evenly spaced windows of
each. Prediction reads all windows of all texts.

Cases: null texts and texts without a letter get `und` and score 0; repeated rows are judged each;
without labelled rows every text is `und`; an empty table gives no rows; extra columns pass through,
and result columns get a leading underscore where they clash.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from rookery.llm.staging import buffer_of, fresh, release, slices, utf8

WINDOW = 256
WIDTHS, FILTERS, EMBED = (2, 3, 4), 16, 8
DOCS_PER_LANGUAGE, WINDOWS_PER_DOC = 600, 3
EPOCHS, LEAST_STEPS, BATCH, RATE = 6, 400, 128, 0.01
UNKNOWN = "und"
_SLICE = 1 << 20
_BLOCK = 64
_STEPS = 1_000_000


@dataclass
class Network:
    """Weights: embed (256 x EMBED), one (width * EMBED) x FILTERS matrix per width, the output layer."""

    languages: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def new(cls, languages: list[str], seed: int = 7) -> Network:
        rnd = np.random.default_rng(seed)
        draw = lambda *shape, scale: rnd.normal(0, scale, shape).astype(np.float32)
        w = {"embed": draw(256, EMBED, scale=0.5)}
        for k in WIDTHS:
            w[f"conv{k}"] = draw(k * EMBED, FILTERS, scale=(2 / (k * EMBED)) ** 0.5)
            w[f"bias{k}"] = np.zeros(FILTERS, np.float32)
        w["out"] = draw(len(WIDTHS) * FILTERS, len(languages), scale=0.1)
        w["shift"] = np.zeros(len(languages), np.float32)
        return cls(languages, w)

    def _patches(self, embedded: np.ndarray, width: int) -> np.ndarray:
        n, length, _ = embedded.shape
        view = np.lib.stride_tricks.sliding_window_view(embedded.reshape(n, -1), width * EMBED, axis=1)
        return view[:, ::EMBED].reshape(n * (length - width + 1), width * EMBED)

    def pooled(self, windows: np.ndarray, tops: dict | None = None) -> np.ndarray:
        """Maximum of each filter over each window; `tops` gets where it was."""
        embedded = self.weights["embed"][windows]
        out = []
        for k in WIDTHS:
            conv = (self._patches(embedded, k) @ self.weights[f"conv{k}"]).reshape(len(windows), -1, FILTERS)
            if tops is not None:
                tops[k] = conv.argmax(1)
            out.append(np.maximum(conv.max(1) + self.weights[f"bias{k}"], 0))
        return np.concatenate(out, 1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        """Softmax per window, in blocks whose activations stay in cache."""
        out = np.empty((len(windows), len(self.languages)), np.float32)
        for i in range(0, len(windows), _BLOCK):
            score = self.pooled(windows[i : i + _BLOCK]) @ self.weights["out"] + self.weights["shift"]
            score = np.exp(score - score.max(1, keepdims=True))
            out[i : i + _BLOCK] = score / score.sum(1, keepdims=True)
        return out

    def slopes(self, windows: np.ndarray, labels: np.ndarray) -> dict[str, np.ndarray]:
        """Gradient of the mean cross entropy; it flows to each filter's best position only."""
        w, n, tops = self.weights, len(windows), {}
        pooled = self.pooled(windows, tops)
        score = pooled @ w["out"] + w["shift"]
        score = np.exp(score - score.max(1, keepdims=True))
        score /= score.sum(1, keepdims=True)
        score[np.arange(n), labels] -= 1
        score /= n
        g = {"out": pooled.T @ score, "shift": score.sum(0), "embed": np.zeros_like(w["embed"])}
        back = (score @ w["out"].T) * (pooled > 0)
        for i, k in enumerate(WIDTHS):
            own = back[:, i * FILTERS : (i + 1) * FILTERS]
            at = tops[k][:, :, None] + np.arange(k)
            seen = windows[np.arange(n)[:, None, None], at]
            patch = w["embed"][seen].reshape(n, FILTERS, k * EMBED)
            g[f"conv{k}"] = np.einsum("nf,nfe->ef", own, patch)
            g[f"bias{k}"] = own.sum(0)
            flow = (own[:, :, None] * w[f"conv{k}"].T).reshape(-1, EMBED)
            np.add.at(g["embed"], seen.reshape(-1), flow)
        return g

    def train(self, windows: np.ndarray, labels: np.ndarray) -> None:
        """Adam over shuffled batches: EPOCHS, or more of them until LEAST_STEPS batches are seen."""
        epochs = max(EPOCHS, -(-LEAST_STEPS * BATCH // len(windows)))
        rnd = np.random.default_rng(11)
        m = {k: np.zeros_like(v) for k, v in self.weights.items()}
        v = {k: np.zeros_like(x) for k, x in self.weights.items()}
        step = 0
        for _ in range(epochs):
            order = rnd.permutation(len(windows))
            for i in range(0, len(order), BATCH):
                own = order[i : i + BATCH]
                step += 1
                for k, g in self.slopes(windows[own], labels[own]).items():
                    m[k] = 0.9 * m[k] + 0.1 * g
                    v[k] = 0.999 * v[k] + 0.001 * g * g
                    mean, spread = m[k] / (1 - 0.9**step), v[k] / (1 - 0.999**step)
                    self.weights[k] -= (RATE * mean / (np.sqrt(spread) + 1e-8)).astype(np.float32)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(windows, text of each, bytes in each) of all texts of a slice."""
    sizes = np.diff(offsets)
    counts = -(-sizes // WINDOW)
    owner = np.repeat(np.arange(len(sizes)), counts)
    nth = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    starts = offsets[:-1][owner] + nth * WINDOW
    held = np.minimum(offsets[1:][owner] - starts, WINDOW)
    inside = np.arange(WINDOW) < held[:, None]
    at = np.where(inside, starts[:, None] + np.arange(WINDOW), 0)
    return np.where(inside, data[at] if len(data) else 0, 0).astype(np.uint8), owner, held


def _training_windows(docs: DataFrame, doc_id: str, text: str, lang: str, docs_per_language: int) -> list:
    rows = docs.select(
        F.col(doc_id).cast("string").alias("d"), F.col(text).alias("t"), F.col(lang).cast("string").alias("l")
    ).where("l is not null and t is not null and t <> '' and (d is null or pmod(crc32(d), 5) <> 0)")
    counts = rows.groupBy("l").count().collect()
    if not counts:
        return []
    # a fifth more than asked for; the least hashes of them are taken when they are here
    cuts = [(r["l"], int(min(1.0, 1.2 * docs_per_language / r["count"] + 1e-4) * _STEPS)) for r in counts]
    # broadcast: one row per language
    cuts = F.broadcast(docs.sparkSession.createDataFrame(cuts, "l string, cut long"))
    picked = rows.withColumn("k", F.xxhash64("d")).join(cuts, "l").where(F.pmod("k", F.lit(_STEPS)) < F.col("cut"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "t", _SLICE):
            got, owner, held = windows_of(*buffer_of(utf8(batch.column("t"))))
            first = np.searchsorted(owner, owner)
            nth, all_ = np.arange(len(owner)) - first, np.bincount(owner, minlength=batch.num_rows)[owner]
            # evenly spaced: the windows at which a new step of all_ / WINDOWS_PER_DOC begins
            keep = np.flatnonzero((nth * WINDOWS_PER_DOC) // all_ != ((nth - 1) * WINDOWS_PER_DOC) // all_)
            made = {c: batch.column(c).take(pa.array(owner[keep])) for c in ("l", "k", "d")}
            yield pa.RecordBatch.from_pydict(made | {"w": pa.array([got[k].tobytes() for k in keep], pa.binary())})

    found: dict[str, dict] = {}
    for r in picked.select("l", "k", "d", "t").mapInArrow(cut, "l string, k long, d string, w binary").collect():
        found.setdefault(r.l, {}).setdefault((r.k % _STEPS, r.d or ""), []).append(bytes(r.w))
    return [(name, w) for name, own in found.items() for key in sorted(own)[:docs_per_language] for w in own[key]]


def fit(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", lang: str = "lang",
    docs_per_language: int = DOCS_PER_LANGUAGE,
) -> Network | None:
    """The network of the labelled documents that aren't held out; None without any."""
    rows = sorted(_training_windows(docs, doc_id, text, lang, docs_per_language))
    if not rows:
        return None
    net = Network.new(sorted({r[0] for r in rows}))
    place = {name: i for i, name in enumerate(net.languages)}
    windows = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, WINDOW)
    net.train(windows, np.array([place[r[0]] for r in rows]))
    return net


def identify(docs: DataFrame, net: Network | None, *, text: str = "text") -> DataFrame:
    """`docs` with lang_pred and score."""
    names = [fresh(docs, n) for n in ("lang_pred", "score")]
    shared, columns = docs.sparkSession.sparkContext.broadcast(net), docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        model = shared.value
        for batch in slices(batches, text, _SLICE):
            languages, scores = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            if model is not None:
                letters = pc.match_substring_regex(pc.fill_null(batch.column(text), ""), r"\pL").to_numpy(zero_copy_only=False)
                windows, owner, held = windows_of(*buffer_of(utf8(batch.column(text))))
                total = np.zeros((batch.num_rows, len(model.languages)))
                np.add.at(total, owner, model.probabilities(windows) * held[:, None])
                total /= np.maximum(np.bincount(owner, held, batch.num_rows), 1)[:, None]
                best = total.argmax(1)
                languages = [model.languages[b] if ok else UNKNOWN for b, ok in zip(best, letters)]
                scores = np.where(letters, np.clip(total.max(1), 0, 1), 0.0)
            made = {names[0]: pa.array(languages, pa.string()), names[1]: pa.array(scores, pa.float64())}
            yield pa.RecordBatch.from_pydict({c: batch.column(c) for c in columns} | made)

    schema = T.StructType([*docs.schema.fields, T.StructField(names[0], T.StringType()), T.StructField(names[1], T.DoubleType())])
    return docs.mapInArrow(run, schema)
