"""Embedding near-duplicates against all pairs."""

import math

import numpy as np
import pytest

from rookery.llm import vectors
import brute

SCHEMA = "vec_id long, embedding array<float>, label int, n_links string"


def _rows():
    rnd = np.random.default_rng(4)
    rows, n = [], 0
    for label in range(3):
        for _ in range(12):
            base = rnd.normal(size=24)
            for _ in range(8):
                v = base + rnd.normal(size=24) * rnd.uniform(0, 0.5)
                rows.append((n, [float(np.float32(x)) for x in v], label, "c"))
                n += 1
    copy = rows[5][1]
    rows += [(n + i, copy, 0, "c") for i in range(40)]  # equal vectors
    rows += [(n + 40, [2 * x for x in copy], 0, "c"), (n + 41, copy, 1, "c"), (n + 42, copy, None, "c"), (n + 43, None, 0, "c")]
    rows += [(n + 44, [0.0] * 24, 0, "c"), (n + 45, [math.nan] + copy[1:], 0, "c"), (n + 46, [math.inf] + copy[1:], 0, "c")]
    rows += [(n + 47, [None] + copy[1:], 0, "c"), (n + 48, [], 0, "c"), (n + 49, copy[:7], 0, "c"), (n + 50, copy[:7], 0, "c")]
    return rows


@pytest.mark.parametrize("tile", [8192, 12])
def test_links_equal_all_pairs(spark, monkeypatch, tile):
    monkeypatch.setattr(vectors, "TILE", tile)
    rows = _rows()
    good = {}
    for v, e, label, _ in rows:
        if label is not None and e and all(x is not None and math.isfinite(x) for x in e) and any(e):
            good[v] = (label, np.array(e, np.float64))
    links = []
    for a, (la, x) in good.items():
        for b, (lb, y) in good.items():
            if a < b and la == lb and len(x) == len(y) and x @ y / (np.linalg.norm(x) * np.linalg.norm(y)) >= 0.93:
                links.append((a, b))
    comps = brute.components([r[0] for r in rows], links)
    degree = {v: sum(v in pair for pair in links) for v, *_ in rows}
    got = vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    for r in got:
        assert (r.n_links, r.component_id, r.kept) == (degree[r.vec_id], comps[r.vec_id], comps[r.vec_id] == r.vec_id), r


def test_empty_table_and_null_ids(spark):
    assert vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0
    rows = [(None, [1.0, 0.0], 1, "c"), (4, [1.0, 0.0], 1, "c"), (4, [1.0, 0.0], 1, "c")]
    got = vectors.near_vectors(spark.createDataFrame(rows, SCHEMA)).collect()
    assert {(r.n_links, r.component_id) for r in got} == {(2, 4)}


def test_boxes_tile_the_space():
    points = np.random.default_rng(0).normal(size=(500, 3))
    lo, hi = vectors.boxes(points, 16)
    inside = ((points[:, None] >= lo[None]) & (points[:, None] <= hi[None])).all(2)
    assert len(lo) == 16 and inside.any(1).all()
    assert len(vectors.boxes(np.ones((10, 3)), 4)[0]) == 1
