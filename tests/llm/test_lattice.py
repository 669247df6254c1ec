import itertools
import math

import numpy as np
import pytest
from conftest_llm import by_id

from riskvq.llm import lattice as L

SCHEMA = "vec_id bigint, embedding array<float>, label int, n_links int, id string, home boolean"


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", True) for r in rows], SCHEMA)


def plain(rows):
    def usable(r):
        return (r[0] is not None and r[2] is not None and r[1] is not None
                and all(x is not None and math.isfinite(x) for x in r[1]) and any(r[1]))

    unit = [np.array(r[1], np.float32).astype(float) if usable(r) else None for r in rows]
    root = {r[0]: r[0] for r in rows}
    links = [0] * len(rows)

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in itertools.combinations(range(len(rows)), 2):
        u, v = unit[a], unit[b]
        if u is None or v is None or rows[a][2] != rows[b][2] or len(u) != len(v):
            continue
        if u @ v / (np.linalg.norm(u) * np.linalg.norm(v)) >= 0.93:
            links[a] += 1
            links[b] += 1
            x, y = sorted((find(rows[a][0]), find(rows[b][0])))
            root[y] = x
    return sorted(((r[0], n, None if r[0] is None else find(r[0]), r[0] is None or find(r[0]) == r[0])
                   for r, n in zip(rows, links, strict=True)), key=repr)


def vectors():
    rng = np.random.default_rng(3)
    rows, at = [], 0
    for label in (0, 1, 2):
        for _ in range(12):
            c = rng.normal(size=16)
            for _ in range(rng.integers(1, 6)):
                v = c + rng.normal(size=16) * rng.choice([0, 0.02, 0.15])
                rows.append((at, (v * rng.choice([1, 1, 5])).astype(np.float32).tolist(), label))
                at += 1
    odd = [None, [], [0.0] * 16, [float("nan")] * 16, [float("inf")] + [1.0] * 15, [None] + [1.0] * 15, [1.0, 2.0], [1.0, 2.0],
           [1e-30] * 16, [1e30] * 16]
    rows += [(1000 + i, v, 1) for i, v in enumerate(odd)]
    rows += [(2000, rows[0][1], None), (2001, rows[0][1], 0), (None, rows[0][1], 0), (2002, rows[0][1], 1)]
    return rows


@pytest.mark.parametrize("block", [1024, 4])
def test_equals_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(L, "BLOCK", block)
    rows = vectors()
    assert by_id(L.link_embeddings(frame(spark, rows))) == plain(rows)


def test_repeated_rows_and_empty_table(spark):
    v = [1.0, 0.0, 0.5]
    out = by_id(L.link_embeddings(frame(spark, [(1, v, 0), (1, v, 0), (2, v, 0)])))
    assert out == [(1, 2, 1, True), (1, 2, 1, True), (2, 2, 1, False)]
    assert L.link_embeddings(frame(spark, [])).count() == 0


def test_lattice_points():
    near = L.minimal_vectors()
    assert near.shape == (240, 8) and np.allclose((near**2).sum(axis=1), 2)
    rng = np.random.default_rng(0)
    x = rng.normal(size=(500, 8)) * 3
    p = L.nearest_e8(x)
    whole = np.all(p == np.rint(p), axis=1)
    assert np.all((p.sum(axis=1) % 2) == 0) and np.all(whole | np.all(p - 0.5 == np.rint(p - 0.5), axis=1))
    best = ((x - p) ** 2).sum(axis=1)
    assert best.max() <= 1 + 1e-9  # the covering radius is one
    assert all((((x - p) @ near.T) <= 1 + 1e-9).all(axis=1))  # no neighbour is nearer


def test_recall_at_the_threshold():
    rng = np.random.default_rng(1)
    x = L.unit(rng.normal(size=(2000, 64)))
    y = rng.normal(size=x.shape)
    y = L.unit(y - (y * x).sum(axis=1, keepdims=True) * x)
    pair = 0.93 * x + math.sqrt(1 - 0.93**2) * y
    labels = np.zeros(len(x), int)
    assert (L.first_meeting(L.cells(x, labels), L.cells(pair, labels)) != 0).mean() > 0.99
