"""Ranked lexical search of many items at once, with common subexpressions shared between items.

Terms are runs of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]` after A-Z became a-z. The items' terms, repeats as
multiplicities, are put into one order, items that have most terms in common next to each other. Term
sets that several items share are mined from neighbours in that order: each pair that occurs in two
items or more becomes a node, and pairs of nodes again, until no pair repeats. So an item is a short
list of nodes, and the nodes form a graph whose edges lead from sets to their halves.

Documents are read once and kept as their number of terms and the frequencies of the items' terms. From
these come the corpus counts and then the scores: a block of documents has one row of accumulators per
node, filled from single terms upward, each node once however many items use it; an item adds its
nodes. Each task keeps the best `k` documents of every item; salted groups, then items, keep the best
of those.

The plan (terms, nodes, items) is broadcast. It is as large as the items' text, which is bounded by
`block_bytes`; more items are searched in several blocks, each with its own read of the documents.

Cases: null and empty texts have no terms and are never found; an item without terms has no rows; equal
rows of items count once, and other rows of one item id are one item with the terms of all; a null item
id is an item; null document ids rank after all others of their score; repeated documents rank each;
long texts are read whole; empty tables give no rows; other columns aren't read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from rookery.llm.decontaminate import words
from rookery.llm.staging import buffer_of, hold, release, slices, stage, utf8

BEST = 20
BLOCK_BYTES = 8 << 20
ACCUMULATOR_BYTES = 16 << 20
SALTS = 64
_NO_ID = np.iinfo(np.int64).max


@dataclass
class Plan:
    """Items as lists of nodes; the first nodes are (term, multiplicity), the others the sum of two before."""

    terms: dict[bytes, int] = field(default_factory=dict)
    base_term: np.ndarray = None
    base_times: np.ndarray = None
    levels: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)  # node, its halves
    nodes: int = 0
    flat: np.ndarray = None  # nodes of all items
    starts: np.ndarray = None

    @classmethod
    def of(cls, items: list[Counter]) -> Plan:
        """The plan of items that have terms."""
        plan = cls()
        base: dict[tuple[int, int], int] = {}
        lists = [
            [base.setdefault((plan.terms.setdefault(t, len(plan.terms)), n), len(base)) for t, n in item.items()] for item in items
        ]
        common = np.bincount([s for own in lists for s in own], minlength=len(base))
        lists = [sorted(own, key=lambda s: (-common[s], s)) for own in lists]
        level = [0] * len(base)
        made: list[tuple[int, int]] = []
        while True:
            pairs = Counter(p for own in lists for p in zip(own, own[1:]))
            number: dict[tuple[int, int], int] = {}
            for i, own in enumerate(lists):
                out, k = [], 0
                while k < len(own):
                    times = pairs[tuple(own[k : k + 2])] if k + 1 < len(own) else 0
                    # a more frequent pair that begins at the next place goes first
                    if times > 1 and (k + 2 >= len(own) or pairs[tuple(own[k + 1 : k + 3])] <= times):
                        pair = (own[k], own[k + 1])
                        if pair not in number:
                            number[pair] = len(base) + len(made)
                            made.append(pair)
                            level.append(1 + max(level[pair[0]], level[pair[1]]))
                        out.append(number[pair])
                        k += 2
                    else:
                        out.append(own[k])
                        k += 1
                lists[i] = out
            if not number:
                break
        plan.base_term, plan.base_times = (np.array(x, np.int64) for x in zip(*base))
        plan.nodes = len(level)
        depth = np.array(level[len(base) :], np.int64)
        halves = np.array(made, np.int64).reshape(-1, 2)
        for d in range(1, max(level) + 1):
            own = np.flatnonzero(depth == d)
            plan.levels.append((len(base) + own, halves[own, 0], halves[own, 1]))
        plan.flat = np.array([s for own in lists for s in own], np.int64)
        plan.starts = np.cumsum([0, *map(len, lists[:-1])])
        return plan

    def scores(self, doc: np.ndarray, term: np.ndarray, value: np.ndarray, n_docs: int) -> np.ndarray:
        """(items, documents) sums of the values of (doc, term) entries, each pair once."""
        nodes = np.zeros((self.nodes, n_docs), np.int64)
        order, edges = self._by_term()
        count = edges[term + 1] - edges[term]
        each = np.repeat(np.arange(len(term)), count)
        slot = order[edges[term][each] + np.arange(len(each)) - np.repeat(np.cumsum(count) - count, count)]
        nodes[slot, doc[each]] = value[each] * self.base_times[slot]
        for node, left, right in self.levels:
            nodes[node] = nodes[left] + nodes[right]
        return np.add.reduceat(nodes[self.flat], self.starts, axis=0)

    def _by_term(self) -> tuple[np.ndarray, np.ndarray]:
        if not hasattr(self, "_places"):
            order = np.argsort(self.base_term, kind="stable")
            self._places = order, np.searchsorted(self.base_term[order], np.arange(len(self.terms) + 1))
        return self._places


class Best:
    """The `k` best (score, document) of each item, equal scores by ascending document."""

    def __init__(self, k: int, n_items: int):
        self.k, self.least = k, np.zeros(n_items, np.int64)
        self.item = self.score = self.doc = np.empty(0, np.int64)

    def add(self, scores: np.ndarray, docs: np.ndarray) -> None:
        # scores are whole and above 0; those equal to the least kept can still win by their document
        item, at = np.nonzero(scores >= np.maximum(self.least, 1)[:, None])
        if not len(item):
            return
        item, score, doc = (np.concatenate(x) for x in ((self.item, item), (self.score, scores[item, at]), (self.doc, docs[at])))
        order = np.lexsort((doc, -score, item))
        item, score, doc = item[order], score[order], doc[order]
        first = np.searchsorted(item, np.arange(len(self.least)))
        rank = np.arange(len(item)) - first[item]
        keep = rank < self.k
        self.item, self.score, self.doc = item[keep], score[keep], doc[keep]
        full = np.flatnonzero(rank == self.k - 1)
        self.least[item[full]] = score[full]


def _postings(docs: DataFrame, plan, name: str) -> DataFrame:
    """(d, n, terms, times): each document's number of terms, and the plan's terms in it with their frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = hold(name, lambda: plan.value[0]).terms
        size = len(number)
        for batch in slices(batches, "t"):
            counts, found = np.zeros(batch.num_rows, np.int64), []
            for i, text in enumerate(utf8(batch.column("t")).to_pylist()):
                own = words(text)
                counts[i] = len(own)
                found += [number.get(w, size) for w in own]
            codes = np.array(found, np.int64) + np.repeat(np.arange(batch.num_rows), counts) * (size + 1)
            codes, times = np.unique(codes, return_counts=True)
            known = codes % (size + 1) < size
            codes, times = codes[known], times[known]
            ends = pa.array(np.searchsorted(codes, np.arange(batch.num_rows + 1) * (size + 1)).astype(np.int32))
            yield pa.RecordBatch.from_pydict(
                {"d": batch.column("d"), "n": pa.array(counts),
                 "terms": pa.ListArray.from_arrays(ends, pa.array((codes % (size + 1)).astype(np.int32))),
                 "times": pa.ListArray.from_arrays(ends, pa.array(times.astype(np.int32)))}
            )

    return docs.mapInArrow(run, "d long, n long, terms array<int>, times array<int>")


def _lists(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(values, ends) of a list column without nulls."""
    ends = column.offsets.to_numpy().astype(np.int64)
    return column.values.to_numpy()[ends[0] : ends[-1]].astype(np.int64), ends - ends[0]


def _corpus(postings: DataFrame, size: int) -> tuple[int, int, np.ndarray]:
    """(documents with a term, all terms, documents per term); the driver gets one row per term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        docs, total, df = 0, 0, np.zeros(size, np.int64)
        for batch in batches:
            n = batch.column("n").to_numpy()
            docs, total = docs + int((n > 0).sum()), total + int(n.sum())
            df += np.bincount(_lists(batch.column("terms"))[0], minlength=size)
        keys = np.concatenate(([-2, -1], np.flatnonzero(df)))
        yield pa.RecordBatch.from_pydict({"key": pa.array(keys), "n": pa.array(np.concatenate(([docs, total], df[df > 0])))})

    got = {r.key: r.n for r in postings.mapInArrow(run, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).collect()}
    df = np.zeros(size, np.int64)
    for key, n in got.items():
        if key >= 0:
            df[key] = n
    return got.get(-2, 0), got.get(-1, 0), df


def term_weights(n_docs: int, df: np.ndarray) -> np.ndarray:
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(x) + 1))) for x in df], np.int64)


def norms(n: np.ndarray, n_docs: int, total: int) -> np.ndarray:
    """The length norm of each document, in whole percent."""
    if len(n) and int(n.max()) * 25 * n_docs >= 2**63:
        return np.array([75 + 25 * int(x) * n_docs // total for x in n], np.int64)
    return 75 + (25 * n * n_docs) // max(total, 1)


def _found(postings: DataFrame, plan, name: str, corpus: tuple[int, int, np.ndarray], n_items: int, k: int) -> DataFrame:
    n_docs, total, df = corpus
    weights = term_weights(n_docs, df)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = hold(name, lambda: plan.value[0])
        best, step = Best(k, n_items), max(1, ACCUMULATOR_BYTES // (8 * (own.nodes + len(own.flat))))
        for batch in batches:
            n = batch.column("n").to_numpy()
            ids = pc.fill_null(batch.column("d"), _NO_ID).to_numpy()
            norm = norms(n, n_docs, total)
            term, ends = _lists(batch.column("terms"))
            times, _ = _lists(batch.column("times"))
            doc = np.repeat(np.arange(len(n)), np.diff(ends))
            value = weights[term] * ((1_000_000_000 * times) // (1000 * times + 12 * norm[doc]))
            for i in range(0, len(n), step):
                j = min(i + step, len(n))
                a, b = ends[i], ends[j]
                if a < b:
                    best.add(own.scores(doc[a:b] - i, term[a:b], value[a:b], j - i), ids[i:j])
        yield pa.RecordBatch.from_pydict(
            {"item": pa.array(best.item, pa.int32()), "score": pa.array(best.score, pa.int64()),
             "doc_id": pa.array(best.doc, pa.int64(), mask=best.doc == _NO_ID)}
        )

    return postings.mapInArrow(run, "item int, score long, doc_id long")


def _best(rows: DataFrame, key: list[str], k: int) -> DataFrame:
    order = Window.partitionBy(*key).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _items(items: DataFrame, item: str, text: str, block_bytes: int) -> Iterator[tuple[list, list[Counter]]]:
    """(ids, terms) of items that have terms, in blocks of about `block_bytes` bytes of text."""
    rows = items.select(F.col(item).alias("i"), F.col(text).alias("t")).where("t is not null").distinct()
    n = max(1, -(-(rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0) // block_bytes))
    for b in range(n):  # bounded: block_bytes of text
        held: dict = {}
        for r in (rows if n == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(n)) == b)).collect():
            own = words(r.t.encode())
            if own:
                held.setdefault(r.i, Counter()).update(own)
        ids = sorted(held, key=lambda x: (x is None, x))
        yield ids, [held[i] for i in ids]


def search(
    docs: DataFrame, items: DataFrame, *, k: int = BEST, doc_id: str = "doc_id", text: str = "text",
    item: str = "item_id", item_text: str = "text", block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """item_id, rank, doc_id and score of each item's `k` best documents with a score above 0."""
    spark = docs.sparkSession
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    id_type = items.schema[item].dataType
    found = None
    for b, (ids, terms) in enumerate(_items(items, item, item_text, block_bytes)):
        if not ids:
            continue
        plan = Plan.of(terms)
        shared, name = spark.sparkContext.broadcast([plan]), f"lexical {b} {hash(tuple(plan.terms))} {plan.nodes}"
        postings = stage(_postings(rows, shared, name), "postings")
        best = _found(postings, shared, name, _corpus(postings, len(plan.terms)), len(ids), k)
        salted = best.withColumn("salt", F.spark_partition_id() % SALTS)
        names = spark.createDataFrame(list(enumerate(ids)), "item int, item_id " + id_type.simpleString())
        # broadcast: one row per item of the block
        own = _best(_best(salted, ["item", "salt"], k), ["item"], k).join(F.broadcast(names), "item")
        own = own.select("item_id", "rank", "doc_id", "score")
        found = own if found is None else found.unionByName(own)
    if found is None:
        return spark.createDataFrame([], f"item_id {id_type.simpleString()}, rank int, doc_id long, score long")
    return found
