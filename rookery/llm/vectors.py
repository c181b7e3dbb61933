"""Embedding near-duplicates: a subspace pigeonhole join.

Unit vectors with a cosine of at least t differ by at most 2 - 2t in squared distance. A fixed random
rotation spreads that difference, and vectors are split into `BLOCKS` subspaces. By the pigeonhole
principle two linked vectors differ, in some block, by at most the block's part of the budget, in
proportion to its dimensions. Each block is joined by range: its space is cut into boxes (medians of
a bounded sample), a vector lies in one box and also visits the later boxes that its ball touches, and
pairs meet inside boxes. Candidates of all blocks are verified with the cosine of the whole vectors.

A pair is counted in the first block whose budget it meets, so a task can add up links and join its
own links to a forest: it returns a row per vector and not a row per pair. Boxes with many vectors are
cut into tiles of about TILE x TILE. Equal unit vectors of a label are one class with a weight.

Cases: vectors that are null, zero, empty or hold null or non-finite components, and those with a
null label, link with nothing; vectors of different lengths don't link; repeated rows are copies and
link each other; a null id names no component; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rookery.llm.components import connected_components
from rookery.llm.staging import stage

BLOCKS = 8
TILE = 8192
MOST_BOXES = 256
SAMPLE = 10_000
_EDGE = 1e-9  # for rounding: budgets are met up to this


def unit(vector: list | None) -> np.ndarray | None:
    """The vector over its length; None if it has no direction."""
    if not vector or any(x is None for x in vector):
        return None
    v = np.array(vector, np.float64)
    most = np.abs(v).max()
    if not np.isfinite(most) or not np.isfinite(v).all() or most == 0:
        return None
    v = v / most + 0.0  # no overflow, no negative zero
    return v / np.sqrt((v * v).sum())


def rotation(dim: int) -> np.ndarray:
    """A random rotation, the same for every run and machine."""
    q, r = np.linalg.qr(np.random.default_rng(97 + dim).normal(size=(dim, dim)))
    return q * np.sign(np.diag(r))


def block_edges(dim: int, blocks: int = BLOCKS) -> np.ndarray:
    return np.linspace(0, dim, min(blocks, dim) + 1).round().astype(int)


def block_distances(a: np.ndarray, b: np.ndarray, edges: np.ndarray) -> np.ndarray:
    """Squared distance of each pair in each block; the same for (a, b) and (b, a)."""
    return np.add.reduceat((a - b) ** 2, edges[:-1], axis=1)


def boxes(points: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Lower and upper corners of up to n boxes that tile the space, cut at medians."""
    dim = points.shape[1]
    parts = [(points, np.full(dim, -np.inf), np.full(dim, np.inf))]
    while len(parts) < n:
        parts.sort(key=lambda p: -len(p[0]))
        own, lo, hi = parts[0]
        spread = own.max(0) - own.min(0) if len(own) else np.zeros(dim)
        axis = int(spread.argmax())
        cut = float(np.median(own[:, axis])) if len(own) else 0.0
        left = own[:, axis] <= cut
        if left.all() or not left.any():
            break
        upper, lower = hi.copy(), lo.copy()
        upper[axis] = lower[axis] = cut
        parts[0] = (own[left], lo, upper)
        parts.append((own[~left], lower, hi))
    return np.array([p[1] for p in parts]), np.array([p[2] for p in parts])


def _units(rows: DataFrame) -> DataFrame:
    """v, label, x (unit vector), fp (its digest); x is null without a direction or label."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            units = [unit(e) if la is not None else None for e, la in zip(batch.column("e").to_pylist(), batch.column("label").to_pylist())]
            x = [None if u is None else u.tobytes() for u in units]
            fp = [None if b is None else xxhash.xxh3_128_digest(b) for b in x]
            yield pa.RecordBatch.from_pydict(
                {"v": batch.column("v"), "label": batch.column("label"), "x": pa.array(x, pa.binary()), "fp": pa.array(fp, pa.binary())}
            )

    return rows.mapInArrow(run, "v long, label string, x binary, fp binary")


def _stack(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.float64).reshape(len(column), -1)


def _routed(classes: DataFrame, budget: float, cuts: dict[int, list]) -> DataFrame:
    """One row per class, block and box that it lies in (own) or visits."""
    shared = classes.sparkSession.sparkContext.broadcast(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            dims = np.array(batch.column("dim").to_pylist())
            for dim in np.unique(dims):
                own = batch.filter(pa.array(dims == dim))
                x, edges = _stack(own.column("x")) @ rotation(dim), block_edges(dim)
                for j, (lo, hi) in enumerate(shared.value[int(dim)]):
                    y = x[:, edges[j] : edges[j + 1]]
                    away = np.maximum(np.maximum(lo[None] - y[:, None], y[:, None] - hi[None]), 0)
                    away = (away * away).sum(2)
                    home = away.argmin(1)
                    limit = budget * (edges[j + 1] - edges[j]) / dim + _EDGE
                    later = np.arange(len(lo))[None] > home[:, None]
                    row, box = np.nonzero((away <= limit) & later | (np.arange(len(lo))[None] == home[:, None]))
                    take = pa.array(row)
                    yield pa.RecordBatch.from_pydict(
                        {
                            "label": own.column("label").take(take), "dim": own.column("dim").take(take),
                            "block": pa.array(np.full(len(row), j, np.int32)), "box": pa.array(box.astype(np.int32)),
                            "own": pa.array(box == home[row]), "rep": own.column("rep").take(take),
                            "weight": own.column("weight").take(take), "x": own.column("x").take(take),
                        }
                    )

    return classes.select("label", "dim", "rep", "weight", "x").mapInArrow(
        run, "label string, dim int, block int, box int, own boolean, rep long, weight long, x binary"
    )


def tile_links(
    x: np.ndarray, own: np.ndarray, chunk: np.ndarray, across: bool, block: int, threshold: float
) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Linked pairs (i, j) of one tile that no earlier block has, in pieces of at most 65,536."""
    dim = x.shape[1]
    edges, budget = block_edges(dim), 2 - 2 * threshold
    y = x @ rotation(dim)
    part = y[:, edges[block] : edges[block + 1]]
    limits = budget * np.diff(edges) / dim + _EDGE
    squares = (part * part).sum(1)
    for i in range(0, len(x), 256):
        near = squares[i : i + 256, None] + squares[None] - 2 * (part[i : i + 256] @ part.T) <= limits[block] + _EDGE
        near &= np.arange(len(x))[None] > np.arange(i, min(i + 256, len(x)))[:, None]
        near &= own[i : i + 256, None] | own[None]
        if across:
            near &= chunk[i : i + 256, None] != chunk[None]
        a, b = np.nonzero(near)
        a += i
        for k in range(0, len(a), 1 << 16):  # verified in bounded pieces
            p, q = a[k : k + (1 << 16)], b[k : k + (1 << 16)]
            apart = block_distances(y[p], y[q], edges) <= limits
            first = apart[:, block] & ~apart[:, :block].any(1)
            p, q = p[first], q[first]
            linked = np.einsum("ij,ij->i", x[p], x[q]) >= threshold
            yield p[linked], q[linked]


def forest(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """Least index of each index's component under the links (a, b)."""
    top = np.arange(n)
    while True:
        least = np.minimum(top[a], top[b])
        new = top.copy()
        np.minimum.at(new, a, least)
        np.minimum.at(new, b, least)
        np.minimum.at(new, top[a], least)
        np.minimum.at(new, top[b], least)
        new = new[new]
        if (new == top).all():
            return top
        top = new


def _tiled(routed: DataFrame, threshold: float) -> DataFrame:
    """u, w (weight of linked classes in a tile), v (a class in its component there)."""
    where = ["label", "dim", "block", "box"]
    sizes = routed.groupBy(where).agg(F.ceil(F.count(F.lit(1)) / TILE).cast("int").alias("cuts"))
    order = [*where, "i", "j"]
    tiles = (
        routed.join(sizes, where)
        .withColumn("chunk", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumns({"i": F.least("chunk", "other"), "j": F.greatest("chunk", "other")})
        .select(*order, "chunk", "own", "rep", "weight", "x")
        .repartition(*order)
        .sortWithinPartitions(*order)
    )

    def solve(key: tuple, parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        rows = pa.Table.from_batches(parts).sort_by("rep")
        rep, weight = rows["rep"].to_numpy(), rows["weight"].to_numpy()
        own, chunk = rows["own"].to_numpy(), rows["chunk"].to_numpy()
        x = _stack(rows["x"].combine_chunks())
        links, top = np.zeros(len(rep)), np.arange(len(rep))
        for a, b in tile_links(x, own, chunk, key[4] != key[5], key[2], threshold):
            if len(a):
                links += np.bincount(a, weight[b], len(rep)) + np.bincount(b, weight[a], len(rep))
                top = forest(top[a], top[b], len(rep))[top]
        at = np.flatnonzero(links > 0)
        return pa.RecordBatch.from_pydict(
            {"u": pa.array(rep[at]), "w": pa.array(links[at].astype(np.int64)), "v": pa.array(rep[top[at]])}
        )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []
        for batch in batches:
            if not batch.num_rows:
                continue
            keys = list(zip(*(batch.column(c).to_pylist() for c in order)))
            starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
            for s, e in zip(starts, starts[1:]):
                if key is not None and keys[s] != key:
                    yield solve(key, held)
                    held = []
                key = keys[s]
                held.append(batch.slice(s, e - s))
        if held:
            yield solve(key, held)

    return tiles.mapInArrow(run, "u long, w long, v long")


def near_vectors(
    vectors: DataFrame, *, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", threshold: float = 0.93
) -> DataFrame:
    """Per row: vec_id, n_links (other rows linked directly), component_id, kept."""
    rows = vectors.select(
        F.col(vec_id).cast("long").alias("v"), F.col(embedding).alias("e"), F.col(label).cast("string").alias("label")
    )
    units = stage(_units(rows), "units")
    classes = (
        units.where("x is not null").groupBy("label", "fp")
        .agg(F.min("v").alias("rep"), F.count(F.lit(1)).alias("weight"), F.first("x").alias("x"))
        .withColumn("dim", (F.octet_length("x") / 8).cast("int"))
    )
    classes = stage(classes, "vector-classes")
    named = classes.where("rep is not null")
    cuts = {}
    for r in named.groupBy("dim", "label").count().groupBy("dim").agg(F.max("count").alias("n")).collect():
        n = int(min(MOST_BOXES, max(1, 2 ** int(np.ceil(np.log2(max(r.n / TILE, 1)))))))
        some = named.where(F.col("dim") == r.dim).orderBy(F.xxhash64("rep")).limit(SAMPLE if n > 1 else 1).select("x").collect()
        x = np.frombuffer(b"".join(bytes(s.x) for s in some), np.float64).reshape(-1, r.dim) @ rotation(r.dim)
        edges = block_edges(r.dim)
        cuts[r.dim] = [boxes(x[:, a:b], n) for a, b in zip(edges, edges[1:])]

    found = stage(_tiled(_routed(named, 2 - 2 * threshold, cuts), threshold), "vector-links")
    comps = connected_components(found.select("u", "v"))
    links = found.groupBy("u").agg(F.sum("w").alias("w")).withColumnRenamed("u", "rep")
    known = (
        classes.select("label", "fp", "rep", "weight")
        .join(links, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
        .select("label", "fp", (F.coalesce("w", F.lit(0)) + F.col("weight") - 1).alias("n"), F.coalesce("component", "rep").alias("c"))
    )
    own = F.when(F.col("fp").isNull(), F.col("v")).otherwise(F.col("c"))
    return units.select("v", "label", "fp").join(known, ["label", "fp"], "left").select(
        F.col("v").alias("vec_id"), F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), own.alias("component_id"),
        F.coalesce(F.col("v") == own, own.isNull()).alias("kept"),
    )
