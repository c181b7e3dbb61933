"""Near-duplicate documents: universal hash minima, banding, signature checks, exact confirmation.

Words are runs without white space after A-Z became a-z; a document's set holds its distinct shingles
of `shingle` words (fewer words: the whole sequence). Documents of one set are one class, found by a
128-bit digest of the set, so that copies never meet in pairs. Each class has `BANDS` x `ROWS` minima
of multiply-add hashes; classes that agree on a band share a bucket. Two steps then find every link
that a bucket can give:

1. each class against one other member, the least of its buckets' least members; links that hold are
   joined to components;
2. in buckets that still hold several components, members of different components against each
   other, in tiles of bounded size. A pair that shares several buckets is met in the first. Tiles
   first name the members that have a possible partner, then get the full sets of those and return a
   forest of the links that hold: neither step returns pairs. Pairs inside one component need no test.

A pair is first judged by set sizes and by the share of equal minima (`SLACK` below the threshold,
five standard deviations), then on the full sets. A pair at exactly 0.8 misses all bands with a
probability of about 1e-7. Full sets are made again from the texts of documents in pairs; a bitmap of
their ids, bounded by `BITMAP_BITS`, keeps the others out of the shuffle.

Cases: null, empty and blank texts have an empty set and are linked with nothing; repeated rows get a
row each; a null id never names a component; an empty table gives no rows; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rookery.llm.components import connected_components
from rookery.llm.staging import buffer_of, release, slices, stage, utf8

BANDS, ROWS = 40, 5
SLACK = 0.14
TILE = 1024
BITMAP_BITS = 1 << 27
_HASHES = BANDS * ROWS
_SLICE = 1 << 20

_random = np.random.default_rng(20240501)
_A = _random.integers(0, 2**64, _HASHES, np.uint64) | np.uint64(1)
_B = _random.integers(0, 2**64, _HASHES, np.uint64)
_BYTE = _random.integers(0, 2**64, 256, np.uint64)
_ROW = _random.integers(0, 2**64, ROWS, np.uint64) | np.uint64(1)
_BAND = _random.integers(0, 2**64, BANDS, np.uint64)
_STEP = int(_random.integers(0, 2**63)) * 2 + 1
_WORD_STEPS = _random.integers(0, 2**64, 64, np.uint64) | np.uint64(1)
_LOWER = np.array([b + 32 if 65 <= b <= 90 else b for b in range(256)], np.uint8)
_SPACE = np.zeros(256, bool)
_SPACE[[32, *range(9, 14)]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    """Bits of x spread over all positions."""
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    x = (x ^ (x >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, np.uint64(base))
    out[:1] = 1
    return np.multiply.accumulate(out)


_power_cache: list[np.ndarray] = [np.empty(0, np.uint64)] * 2


def _steps(n: int) -> list[np.ndarray]:
    """Powers of the word hash's step and of its inverse modulo 2**64."""
    if len(_power_cache[0]) < n:
        _power_cache[:] = [_powers(_STEP, n), _powers(pow(_STEP, -1, 2**64), n)]
    return _power_cache


def word_hashes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words of a slice, and each text's number of words."""
    first, n = int(offsets[0]), int(offsets[-1] - offsets[0])
    counts = np.zeros(len(offsets) - 1, np.int64)
    if not n:
        return np.empty(0, np.uint64), counts
    data = _LOWER[data[first : first + n]]
    word = ~_SPACE[data]
    cut = np.zeros(n + 1, bool)
    cut[offsets - first] = True
    starts = np.flatnonzero(word & (cut[:n] | ~np.concatenate(([False], word[:-1]))))
    ends = np.flatnonzero(word & (cut[1:] | ~np.concatenate((word[1:], [False])))) + 1
    up, down = _steps(n)
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data] * up[:n], dtype=np.uint64)))
    hashes = (sums[ends] - sums[starts]) * down[starts]
    counts += np.diff(np.searchsorted(starts, offsets - first))
    return _mixed(hashes + (ends - starts).astype(np.uint64)), counts


def shingles(hashes: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all shingles (repeats included), and each text's number of them."""
    stop = np.cumsum(counts)
    left = np.repeat(stop, counts) - np.arange(len(hashes))
    at = np.flatnonzero(left >= size)
    mixed = np.zeros(len(at), np.uint64)
    for j in range(size):
        mixed += hashes[at + j] * _WORD_STEPS[j]
    made = np.maximum(counts - size + 1, 0)
    short = np.flatnonzero((counts > 0) & (counts < size))
    if len(short):
        whole = [np.sum(hashes[stop[i] - counts[i] : stop[i]] * _WORD_STEPS[: counts[i]], dtype=np.uint64) + np.uint64(counts[i]) for i in short]
        mixed = np.insert(mixed, np.cumsum(made)[short], whole)
        made[short] = 1
    return _mixed(mixed), made


def minima(values: np.ndarray, made: np.ndarray) -> np.ndarray:
    """16 bits of each minimum, for the texts that have shingles."""
    full = made[made > 0]
    starts = np.concatenate(([0], np.cumsum(full)[:-1]))
    out, work = np.empty((len(full), _HASHES), np.uint16), np.empty_like(values)
    for j in range(_HASHES):
        np.multiply(values, _A[j], out=work)
        np.add(work, _B[j], out=work)
        least = np.minimum.reduceat(work, starts)
        out[:, j] = (_mixed(least) >> np.uint64(48)).astype(np.uint16)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key per class and band."""
    rows = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    return _mixed((rows * _ROW).sum(2, dtype=np.uint64) + _BAND).view(np.int64)


def _sets(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, np.ndarray]:
    data, offsets = buffer_of(utf8(batch.column("t")))
    return shingles(*word_hashes(data, offsets), size)


def _signatures(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, _HASHES)


def profiles(docs: DataFrame, size: int) -> DataFrame:
    """d, n (set size), fp (digest of the set) and sig of every row of (d, t)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "t", _SLICE):
            values, made = _sets(batch, size)
            sig = iter(minima(values, made)) if len(values) else iter(())
            n, fp, out = [], [], []
            for own in np.split(values, np.cumsum(made)[:-1]):
                own = np.unique(own)
                n.append(len(own))
                fp.append(xxhash.xxh3_128_digest(own) if len(own) else None)
                out.append(next(sig).tobytes() if len(own) else None)
            yield pa.RecordBatch.from_pydict(
                {"d": batch.column("d"), "n": pa.array(n, pa.int64()), "fp": pa.array(fp, pa.binary()), "sig": pa.array(out, pa.binary())}
            )

    return docs.mapInArrow(run, "d long, n long, fp binary, sig binary")


def _bands(classes: DataFrame) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "sig", _SLICE):
            keys = band_keys(_signatures(batch.column("sig")))
            rep = np.repeat(batch.column("rep").to_numpy(), BANDS)
            yield pa.RecordBatch.from_pydict({"key": pa.array(keys.ravel()), "rep": pa.array(rep)})

    return classes.select("rep", "sig").mapInArrow(run, "key long, rep long")


def _similar(pairs: DataFrame, classes: DataFrame, share: float) -> DataFrame:
    """The pairs (u, v) whose sizes and signatures allow a similarity of `share`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "sa", _SLICE):
            same = (_signatures(batch.column("sa")) == _signatures(batch.column("sb"))).mean(1)
            keep = pa.array(same >= share - SLACK)
            yield batch.select(["u", "v"]).filter(keep)

    a = classes.select(F.col("rep").alias("u"), F.col("n").alias("na"), F.col("sig").alias("sa"))
    b = classes.select(F.col("rep").alias("v"), F.col("n").alias("nb"), F.col("sig").alias("sb"))
    close = F.least("na", "nb") >= share * F.greatest("na", "nb")
    return pairs.join(a, "u").join(b, "v").where(close).select("u", "v", "sa", "sb").mapInArrow(run, "u long, v long")


def _place(ids: np.ndarray, bits: int) -> np.ndarray:
    return (_mixed(ids.astype(np.uint64)) & np.uint64(bits - 1)).astype(np.int64)


def _bitmap(ids: DataFrame) -> np.ndarray:
    """Marks of the hashed ids: 16 places an id, BITMAP_BITS at most; the driver gets one number per place."""
    n = ids.count()
    bits = 1 << max(10, min(BITMAP_BITS.bit_length() - 1, (16 * n).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in batches:
            at = _place(batch.column("d").to_numpy(), bits)
            yield pa.RecordBatch.from_pydict({"w": pa.array(at >> 6), "m": pa.array(np.left_shift(1, at & 63))})

    words = ids.mapInArrow(run, "w long, m long").groupBy("w").agg(F.bit_or("m").alias("m")).toPandas()
    out = np.zeros(bits >> 6, np.int64)
    out[words["w"].to_numpy(np.int64)] = words["m"].to_numpy(np.int64)
    return out


def _marked(bitmap: np.ndarray, docs: DataFrame, doc_id: str) -> Column:
    """Whether the bitmap marks a row's id: every id in it, and some others; never a null id."""
    shared = docs.sparkSession.sparkContext.broadcast(bitmap)

    @F.arrow_udf("boolean")
    def marked(ids: pa.Array) -> pa.Array:
        bits = shared.value
        at = _place(pc.fill_null(ids, -1).to_numpy(zero_copy_only=False), 64 * len(bits))
        return pc.and_(pa.array((bits[at >> 6] >> (at & 63) & 1).astype(bool)), ids.is_valid())

    return marked(F.col(doc_id).cast("long"))


def _linked(a: np.ndarray, b: np.ndarray, percent: int) -> bool:
    """100 * intersection >= percent * union of two sorted sets."""
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    both = int((b[at] == a).sum())
    return 100 * both >= percent * (len(a) + len(b) - both)


def _full_sets(docs: DataFrame, ids: DataFrame, size: int) -> DataFrame:
    """(d, s): the sorted full set of each document in `ids` (d)."""
    shared = docs.sparkSession.sparkContext.broadcast(_bitmap(ids))

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        bits = shared.value
        for batch in slices(batches, "t", _SLICE):
            at = _place(pc.fill_null(batch.column("d"), -1).to_numpy(), 64 * len(bits))
            batch = batch.filter(pa.array((bits[at >> 6] >> (at & 63) & 1).astype(bool)))
            if not batch.num_rows:
                continue
            values, made = _sets(batch, size)
            own = [np.unique(x).tobytes() for x in np.split(values, np.cumsum(made)[:-1])]
            yield pa.RecordBatch.from_pydict({"d": batch.column("d"), "s": pa.array(own, pa.binary())})

    return docs.mapInArrow(sets, "d long, s binary").join(ids, "d")


def _confirmed(pairs: DataFrame, docs: DataFrame, size: int, percent: int) -> DataFrame:
    """The pairs (u, v) whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for batch in slices(batches, "sa", _SLICE):
            sets = [[np.frombuffer(x, np.uint64) for x in batch.column(c).to_pylist()] for c in ("sa", "sb")]
            yield batch.select(["u", "v"]).filter(pa.array([_linked(a, b, percent) for a, b in zip(*sets)], pa.bool_()))

    held = _full_sets(docs, pairs.select(F.col("u").alias("d")).union(pairs.select("v")).distinct(), size)
    a, b = held.select(F.col("d").alias("u"), F.col("s").alias("sa")), held.select(F.col("d").alias("v"), F.col("s").alias("sb"))
    return pairs.join(a, "u").join(b, "v").select("u", "v", "sa", "sb").mapInArrow(run, "u long, v long")


def _tiles(members: DataFrame) -> DataFrame:
    """Buckets cut into tiles (i, j) of about TILE x TILE members; a row goes to the tiles of its chunk x."""
    return (
        members.withColumn("cuts", F.ceil(F.col("m") / TILE).cast("int"))
        .withColumn("x", F.pmod(F.xxhash64("rep"), F.col("cuts")).cast("int"))
        .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1)))
        .withColumns({"i": F.least("x", "y"), "j": F.greatest("x", "y")})
        .drop("cuts", "y", "m")
    )


def _groups(batches: Iterator[pa.RecordBatch], key: list[str]) -> Iterator[pa.Table]:
    """Runs of rows that agree on `key`."""
    now, held = None, []
    for batch in batches:
        if not batch.num_rows:
            continue
        keys = list(zip(*(batch.column(c).to_pylist() for c in key)))
        starts = [0, *(i for i in range(1, len(keys)) if keys[i] != keys[i - 1]), len(keys)]
        for s, e in zip(starts, starts[1:]):
            if now is not None and keys[s] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = keys[s]
            held.append(batch.slice(s, e - s))
    if held:
        yield pa.Table.from_batches(held)


def _possible(rows: pa.Table, share: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs (k, o, equal minima) of different components in one tile that sizes and signatures allow.

    Only pairs whose first common band is this bucket's.
    """
    x, rep, comp, n = (rows[c].to_numpy() for c in ("x", "rep", "comp", "n"))
    sig = _signatures(rows["sig"].combine_chunks())
    keys = band_keys(sig)
    band = int((keys[0] == rows["key"][0].as_py()).argmax())
    across = rows["i"][0].as_py() != rows["j"][0].as_py()
    kinds, counts = np.unique(comp, return_counts=True)
    top = kinds[counts.argmax()]
    found = []
    for k in np.flatnonzero(comp != top):  # each pair has at least one of these; if both, the lesser id counts
        open_ = (comp != comp[k]) & ((comp == top) | (rep > rep[k])) & (np.minimum(n, n[k]) >= share * np.maximum(n, n[k]))
        if across:
            open_ &= x != x[k]
        at = np.flatnonzero(open_)
        same = (sig[at] == sig[k]).mean(1)
        at, same = at[same >= share - SLACK], same[same >= share - SLACK]
        first = ~(keys[at, :band] == keys[k, :band]).any(1)
        found.append((np.full(int(first.sum()), k), at[first], same[first]))
    return tuple(map(np.concatenate, zip(*found))) if found else (np.empty(0, int),) * 3


_TILE_KEY = ["key", "i", "j"]


def _involved(tiled: DataFrame, share: float) -> DataFrame:
    """The (key, i, j, rep) of members with a possible partner in their tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in _groups(batches, _TILE_KEY):
            k, o, _ = _possible(rows, share)
            for part in rows.take(pa.array(np.union1d(k, o))).select([*_TILE_KEY, "rep"]).to_batches():
                yield part

    dealt = tiled.repartition(*_TILE_KEY).sortWithinPartitions(*_TILE_KEY)
    return dealt.mapInArrow(run, "key long, i int, j int, rep long")


def _links(tiled: DataFrame, share: float, percent: int) -> DataFrame:
    """Links (u, v) that join different components of a tile; `s` holds the members' full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        release()
        for rows in _groups(batches, _TILE_KEY):
            rep, sets = rows["rep"].to_numpy(), [np.frombuffer(x, np.uint64) for x in rows["s"].to_pylist()]
            top = {c: c for c in rows["comp"].to_pylist()}
            comp, u, v = rows["comp"].to_pylist(), [], []
            k, o, same = _possible(rows, share)
            for p in np.argsort(-same, kind="stable"):
                a, b = k[p], o[p]
                x, y = _root(top, comp[a]), _root(top, comp[b])
                if x != y and _linked(sets[a], sets[b], percent):
                    top[max(x, y)] = min(x, y)
                    u.append(rep[a])
                    v.append(rep[b])
            yield pa.RecordBatch.from_pydict({"u": pa.array(u, pa.int64()), "v": pa.array(v, pa.int64())})

    dealt = tiled.repartition(*_TILE_KEY).sortWithinPartitions(*_TILE_KEY)
    return dealt.mapInArrow(run, "u long, v long")


def _root(top: dict[int, int], x: int) -> int:
    while top[x] != x:
        top[x] = top[top[x]]
        x = top[x]
    return x


def _stars(comps: DataFrame) -> DataFrame:
    return comps.where("node <> component").select(F.col("node").alias("u"), F.col("component").alias("v"))


def near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (least doc_id reachable), kept.

    kept: the row's id is its component's, or the component has no id at all.
    """
    spark, share = docs.sparkSession, percent / 100
    rows = docs.select(F.col(doc_id).cast("long").alias("d"), F.col(text).alias("t"))
    profile = stage(profiles(rows, shingle), "profiles")
    narrow = profile.select("d", "n", "fp")
    classes = stage(
        profile.where("n > 0").groupBy("n", "fp").agg(F.min("d").alias("rep"), F.first("sig").alias("sig")), "classes"
    )
    named = classes.where("rep is not null")
    bands = _bands(named)
    buckets = bands.groupBy("key").agg(F.min("rep").alias("c"), F.count(F.lit(1)).alias("m"))
    members = stage(bands.join(buckets.where("m > 1"), "key"), "buckets")
    star = members.where("rep <> c").groupBy("rep").agg(F.min("c").alias("u")).withColumnRenamed("rep", "v")
    near = stage(_similar(star, named, share), "pairs")
    comps = connected_components(_confirmed(near, rows, shingle, percent))

    known = members.join(comps.withColumnRenamed("node", "rep"), "rep", "left").withColumn("comp", F.coalesce("component", "rep"))
    split = known.groupBy("key").agg(F.min("comp").alias("a"), F.max("comp").alias("b")).where("a <> b").select("key")
    open_ = known.select("key", "m", "rep", "comp").join(split, "key").join(named.select("rep", "n", "sig"), "rep")
    tiled = _tiles(open_)
    some = stage(_involved(tiled, share), "involved")
    if not some.isEmpty():
        full = _full_sets(rows, some.select(F.col("rep").alias("d")).distinct(), shingle).dropDuplicates(["d"])
        filled = tiled.join(some, [*_TILE_KEY, "rep"]).join(full.withColumnRenamed("d", "rep"), "rep")
        comps = connected_components(_links(filled, share, percent).unionByName(_stars(comps)))

    least = classes.select("n", "fp", "rep").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    least = least.select("n", "fp", F.coalesce("component", "rep").alias("component"))
    own = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("d"))
    return narrow.join(least, ["n", "fp"], "left").select(
        F.col("d").alias("doc_id"), F.col("n").alias("n_shingles"), own.alias("component_id"),
        F.coalesce(F.col("d") == own, own.isNull()).alias("kept"),
    )


def drop_near_duplicates(
    docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", shingle: int = 5, percent: int = 80
) -> DataFrame:
    """`docs` with one row of each component: the one with the least id.

    Rows without an id stay. Of rows that share an id one stays.
    """
    verdict = stage(near_duplicates(docs, doc_id=doc_id, text=text, shingle=shingle, percent=percent), "verdict")
    ids = verdict.where("doc_id is not null").groupBy("doc_id").agg(F.bool_or("kept").alias("stays"), F.count(F.lit(1)).alias("n"))
    drop = stage(ids.where("not stays or n > 1"), "drop")
    # only documents whose ids the bitmap marks can be dropped; the others' texts are not shuffled
    marked = _marked(_bitmap(drop.select(F.col("doc_id").alias("d"))), docs, doc_id)
    named = drop.select(F.col("doc_id").alias(doc_id))
    kept = docs.where(~marked).unionByName(docs.where(marked).join(named, doc_id, "left_anti").select(docs.columns))
    repeated = drop.where("stays and n > 1").select(F.col("doc_id").alias(doc_id))
    if repeated.isEmpty():
        return kept
    again = docs.where(marked).join(repeated, doc_id, "left_semi").dropDuplicates([doc_id])
    return kept.unionByName(again.select(docs.columns))
