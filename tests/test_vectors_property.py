"""Vector column functions against numpy on random arrays (hypothesis)."""

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from riskvq.functions import vectors as V

finite = st.floats(min_value=-1e6, max_value=1e6, allow_nan=False, allow_infinity=False)
pairs = st.integers(min_value=1, max_value=8).flatmap(
    lambda n: st.tuples(st.lists(finite, min_size=n, max_size=n), st.lists(finite, min_size=n, max_size=n)))


@settings(max_examples=25, deadline=None)
@given(st.lists(pairs, min_size=1, max_size=6), finite)
def test_vector_functions_match_numpy(spark, rows, scalar):
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(rows)], "i int, a array<double>, b array<double>")
    out = {r.i: r for r in df.select(
        "i", V.vec_sum("a").alias("s"), V.vec_sum("a", 1).alias("s1"), V.vec_sqdist("a", "b").alias("d2"),
        V.vec_dist("a", "b").alias("d"), V.vec_add("a", "b").alias("add"), V.vec_sub("a", "b").alias("sub"),
        V.vec_dot("a", "b").alias("dot"), V.vec_dot("a", "b", 1).alias("dot1"),
        V.vec_scale(scalar, "a").alias("sc")).collect()}
    for i, (a, b) in enumerate(rows):
        a, b, r = np.array(a), np.array(b), out[i]
        tol = dict(rtol=1e-9, atol=1e-6)
        assert np.isclose(r.s, a.sum(), **tol) and np.isclose(r.s1, a[:-1].sum(), **tol)
        assert np.isclose(r.d2, ((a - b) ** 2).sum(), **tol) and np.isclose(r.d, np.sqrt(((a - b) ** 2).sum()), **tol)
        assert np.allclose(r.add, a + b) and np.allclose(r.sub, a - b)
        assert np.isclose(r.dot, (a * b).sum(), **tol) and np.isclose(r.dot1, (a * b)[:-1].sum(), **tol)
        assert np.allclose(r.sc, scalar * a)
