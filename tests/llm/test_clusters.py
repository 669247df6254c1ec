import hashlib
import random

import numpy as np
import pytest

from riskvq.llm import clusters as C

SCHEMA = "vec_id bigint, embedding array<double>, label int, vec string, n bigint, distance string"


def plain(rows, k, rounds, width, seed=C.SEED):
    kept = [(i, [int(max(-C.LIMIT, min(C.LIMIT, np.floor(np.float64(x) * 256)))) for x in v]) for i, v in rows
            if v is not None and len(v) == width and all(x is not None and np.isfinite(x) for x in v)]
    raw = {tuple(v): w for (_, v), w in zip(kept, kept, strict=True)}
    assert len(raw) <= len(kept)

    def order(r):
        return (r[0] is None, "" if r[0] is None else hashlib.sha256(f"{seed}:{r[0]}".encode()).hexdigest(), r[1])

    centroids = [v for _, v in sorted(kept, key=order)[:k]]

    def assign():
        out = []
        for _, v in kept:
            d = [sum((a - b) ** 2 for a, b in zip(v, c, strict=True)) for c in centroids]
            out.append((d.index(min(d)), min(d)))
        return out

    for _ in range(rounds):
        at = assign()
        for c in range(len(centroids)):
            own = [v for (_, v), (a, _) in zip(kept, at, strict=True) if a == c]
            if own:
                centroids[c] = [sum(col) // len(own) for col in zip(*own, strict=True)]
    at = assign()
    sha = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    own = [sum(d for a, d in at if a == c) for c in range(len(centroids))]
    return sorted(((i, c, d, min(own[c], C.LONGEST), min(sum(own), C.LONGEST), sha[c])
                   for (i, _), (c, d) in zip(kept, at, strict=True)), key=repr)


def vectors(rng, n, width=64, centres=12):
    mid = [[rng.gauss(0, 0.2) for _ in range(width)] for _ in range(centres)]
    return [(i, [m + rng.gauss(0, 0.05) for m in rng.choice(mid)]) for i in range(n)]


def table(spark, rows):
    return spark.createDataFrame([(i, v, 1, "x", 3, "y") for i, v in rows], SCHEMA)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("parts", [1, 7])
def test_equals_plain_rounds(spark, parts):
    rng = random.Random(3)
    rows = vectors(rng, 200)
    rows += [(1000 + i, rows[5][1]) for i in range(60)]                       # a hot vector
    rows += [(7, rows[9][1]), (7, rows[9][1]), (None, rows[3][1]), (None, rows[4][1])]
    rows += [(2000, None), (2001, []), (2002, [1.0] * 63), (2003, [None] + [0.1] * 63), (2004, [float("nan")] * 64),
             (2005, [float("inf")] + [0.0] * 63), (2006, [0.0] * 64), (2007, [-0.0] * 64), (2008, [1e300] * 64),
             (2009, [-1e30] * 64), (2010, [200.0] * 64), (2011, [-0.001] * 64)]
    got = result(C.cluster_vectors(table(spark, rows).repartition(parts)))
    assert got == plain(rows, 40, 5, 64)
    assert len({r[1] for r in got}) > 10


def test_other_parameters_and_small_tables(spark):
    rng = random.Random(4)
    rows = vectors(rng, 90, width=3)
    for k, rounds in ((1, 2), (2, 0), (7, 4), (200, 2)):
        got = result(C.cluster_vectors(table(spark, rows), k, rounds, 3))
        assert got == plain(rows, k, rounds, 3)
    same = [(i, [0.5, 0.5, 0.5]) for i in range(30)]  # equal centroids: all rows go to the first, others stay
    got = result(C.cluster_vectors(table(spark, same), 5, 3, 3))
    assert got == plain(same, 5, 3, 3) and {r[1] for r in got} == {0}
    assert C.cluster_vectors(table(spark, [])).count() == 0
    assert C.cluster_vectors(table(spark, [(1, None)])).collect() == []
    with pytest.raises(ValueError):
        C.cluster_vectors(table(spark, rows), 100_000)


def test_bounds_spare_distances():
    rng = np.random.default_rng(1)
    centres = rng.integers(-200, 200, (30, 16))
    x = centres[rng.integers(0, 30, 5000)] + rng.integers(-12, 12, (5000, 16))
    before = C.Centroids(centres)
    asked = []
    plain_squared = C.Centroids.squared

    class Counting(C.Centroids):
        def squared(self, x, which):
            asked.append(len(x))
            return plain_squared(self, x, which)

    n = len(x)
    state = before.assign(x, np.zeros(n, np.int64), np.ones(n, np.int64), np.full(n, np.inf), np.zeros(n))
    moved = centres + rng.integers(-1, 2, centres.shape)
    state = Counting(moved, centres).assign(x, *state)
    d = ((x[:, None, :] - moved[None]) ** 2).sum(axis=2)
    assert (state[0] == d.argmin(axis=1)).all()
    assert sum(asked) < 2 * n  # of 30 n
