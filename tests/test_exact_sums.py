"""Order-independent sums: exact against fractions, equal bytes under any partitioning."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from riskvq.operators import exact_sums as X
from riskvq.operators.bvq import bvq_step, bvq_train
from riskvq.operators.codebook import Codebook
from riskvq.operators.som import som_step, som_train
from riskvq.sources.labeled import embeddings_labeled

SF = "/root/testdata/sf0.001"


def total(places, g, d):
    return X.rounded({p: int(v[g, d]) for p, v in places.items()})


@settings(max_examples=150, deadline=None)
@given(st.lists(st.floats(allow_nan=False, allow_infinity=False), max_size=30))
def test_sums_are_exact(values):
    sums = X.ExactSums(2, 1)
    cut = len(values) // 2
    for part in (values[:cut], values[cut:]):
        sums.add(np.ones(len(part), np.int64), np.array(part, np.float64).reshape(-1, 1))
    exact = sum((Fraction(v) for v in values), Fraction(0))
    try:
        want = float(exact)
    except OverflowError:
        want = math.inf if exact > 0 else -math.inf
    assert total(sums.places, 1, 0) == want and total(sums.places, 0, 0) == 0.0
    assert all((np.abs(v) < 2**32).all() for v in sums.places.values())


def test_many_rows_and_carries():
    rng = np.random.default_rng(1)
    x = np.concatenate([rng.normal(size=(20_000, 3)) * 10.0 ** rng.integers(-12, 12, (20_000, 1)),
                        np.full((5000, 3), -1e15), np.full((5000, 3), 0.1), np.full((3, 3), 5e-324)])
    g = rng.integers(0, 4, len(x))
    sums = X.ExactSums(4, 3)
    for s in range(0, len(x), 700):
        sums.add(g[s:s + 700], x[s:s + 700])
    for k in range(4):
        for d in range(3):
            assert total(sums.places, k, d) == math.fsum(x[g == k, d])
    assert sums.n.tolist() == np.bincount(g, minlength=4).tolist()


@pytest.fixture(scope="module")
def emb(spark):
    return embeddings_labeled(spark, SF)


def codebook(emb, n=12):
    rows = emb.orderBy("id").limit(n).collect()
    return Codebook(np.arange(1, n + 1), np.array([r.label for r in rows]), np.array([r.features for r in rows]))


def test_vector_sums_by_key(spark, monkeypatch):
    rng = random.Random(2)
    rows = [(rng.choice([1, 1, 1, 2, -7, None]), [rng.uniform(-1, 1) * 10**rng.randint(-9, 9) for _ in range(3)])
            for _ in range(400)]
    rows += [(1, None), (2, [1.0]), (9, None), (1, [float("nan"), 1.0, 1.0]), (2, [None, 1.0, 2.0])]
    df = spark.createDataFrame(rows, "k int, features array<double>")
    want = {k: (len([1 for r in rows if r[0] == k]),
                [math.fsum(v[d] for key, v in rows if key == k and v is not None and len(v) == 3
                           and None not in v and all(map(math.isfinite, v))) for d in range(3)])
            for k in {r[0] for r in rows} - {None}}
    for parts in (1, 7):
        out = X.exact_vec_sum(df.repartition(parts), "k", dims=3).collect()
        assert {r.key: (r.n, r.sums) for r in out} == want
    monkeypatch.setattr(X, "HELD_CELLS", 4)  # hands on its sums in between
    assert {r.key: (r.n, r.sums) for r in X.exact_vec_sum(df.repartition(3), "k", dims=3).collect()} == want
    assert X.exact_vec_sum(df.limit(0), "k", dims=3).count() == 0


def test_codebooks_have_equal_bytes_under_any_partitioning(emb):
    cb = codebook(emb)
    seen = {"som": set(), "train": set(), "bvq": set(), "projection": set(), "bags": set()}
    for parts in (1, 7, 64):
        df = emb.repartition(parts)
        seen["som"].add(som_step(df, cb, 0.1, replicable=True).w.tobytes())
        seen["bvq"].add(bvq_step(df, cb, 0.05, None, replicable=True).w.tobytes())
        seen["projection"].add(bvq_step(df, cb, 0.05, None, target="projection", replicable=True).w.tobytes())
        if parts > 1:
            seen["train"].add(som_train(df, cb, 2, 0.1, 1, sample_fraction=0.7, replicable=True).w.tobytes())
            seen["bags"].add(bvq_train(df, cb, 1, 0.05, None, n_bags=2, bag_size=40, seed=3, replicable=True)[0].w.tobytes())
    assert {k: len(v) for k, v in seen.items()} == dict.fromkeys(seen, 1)


def test_replicable_steps_agree_with_the_others(emb):
    cb = codebook(emb)
    cost = {(a, p): abs(a - p) + 0.5 for a in range(10) for p in range(10) if a != p}
    for step in (lambda **o: som_step(emb, cb, 0.1, radius=1, within_class=True, **o),
                 lambda **o: bvq_step(emb, cb, 0.05, 0.4, cost=cost, **o)):
        np.testing.assert_allclose(step(replicable=True).w, step().w, rtol=1e-12, atol=1e-13)
