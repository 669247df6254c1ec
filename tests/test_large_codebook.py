"""Codebooks in parts and the metric tree against measuring every code."""

import numpy as np
import pytest

from riskvq.operators import nearest as N
from riskvq.operators.code_tree import CodeTree, no_codes, tree_finder
from riskvq.operators.codebook import CODEBOOK_SCHEMA, Codebook
from riskvq.operators.large_codebook import CodeParts

SCHEMA = "id long, label int, features array<double>, d2 double"


def brute(x, ids, w, k):
    out = []
    for row in x:
        d = ((w - row) ** 2).sum(axis=1)
        out.append([int(i) for i in ids[np.lexsort((ids, d))[:k]]])
    return out


def clustered(rng, n, dims, centres=20, spread=0.05):
    mid = rng.normal(size=(centres, dims))
    return mid[rng.integers(0, centres, n)] + rng.normal(0, spread, (n, dims))


def exact(w, x, k):
    ids = np.arange(len(w)) * 3 + 1
    tree = CodeTree(ids, w, leaf=7)
    d, i, p = no_codes(len(x), k)
    tree.search(x, d, i, p)
    want = brute(x, ids, w, k)
    for row, (have, places, wanted) in enumerate(zip(i, p, want, strict=True)):
        assert have[:len(wanted)].tolist() == wanted
        assert (ids[places[:len(wanted)]] == wanted).all()
        np.testing.assert_allclose(d[row, :len(wanted)], np.sort(((w - x[row]) ** 2).sum(axis=1))[:k], rtol=1e-12)
    return tree


@pytest.mark.parametrize("k", [1, 2, 5])
@pytest.mark.parametrize("dims", [1, 2, 16])
def test_tree_equals_every_code(k, dims):
    rng = np.random.default_rng(dims * 10 + k)
    w = np.concatenate([clustered(rng, 300, dims), rng.normal(size=(40, dims))])
    w = np.concatenate([w, w[:60], np.zeros((30, dims))])          # equal codes: ties go to the lower id
    exact(w, np.concatenate([clustered(rng, 100, dims), w[:50], np.zeros((2, dims))]), k)
    exact(w[:1], w[:20], k)
    exact(np.full((50, dims), 2.5), w[:10], k)
    exact(w * 1e150, w[:20] * 1e150, k)
    exact(w + 1e9, w[:20] + 1e9, k)


def test_tree_spares_distances():
    rng = np.random.default_rng(5)
    w = clustered(rng, 10_000, 64, 200)
    tree = CodeTree(np.arange(len(w)), w)
    x = clustered(rng, 500, 64, 200)
    x = w[rng.integers(0, len(w), 500)] + rng.normal(0, 0.02, (500, 64))
    tree.search(x, *no_codes(len(x), 2))
    assert tree.evaluations < len(x) * len(w) / 5


def test_probe_leaves_a_tree_that_spares_nothing():
    rng = np.random.default_rng(6)
    w, x = rng.normal(size=(2000, 64)), rng.normal(size=(1500, 64))
    calls = []
    every, _ = N.make_finder(np.zeros(len(w), int), w, 2, False, 0, "arrow")

    def plain(x, lr):
        calls.append(len(x))
        return every(x, lr)

    find = tree_finder(np.zeros(len(w), int), w, 2, False, plain)
    got, want = find(x, None), every(x, None)
    assert calls == [988] and (got[0] == want[0]).all()
    np.testing.assert_allclose(got[1], want[1], rtol=1e-12)
    assert find(x[:0], None)[0].shape == (0, 2)


def frame(spark, x, labels=None):
    rows = [(i, int(labels[i]) if labels is not None else i % 3, v.tolist(), 1.0) for i, v in enumerate(x)]
    rows += [(-1, 0, None, 1.0), (-2, 0, [], 1.0), (-3, 1, [float("nan")] * x.shape[1], 1.0), (-4, None, x[0].tolist(), 1.0),
             (-5, 0, [None] * x.shape[1], 1.0)]
    return spark.createDataFrame(rows, SCHEMA).drop("d2")


def codes(spark, w, labels):
    return spark.createDataFrame([(int(i * 2 + 1), int(c), v.tolist()) for i, (v, c) in enumerate(zip(w, labels))],
                                 CODEBOOK_SCHEMA)


def rows_of(df):
    return sorted((tuple(r) for r in df.drop("features").collect()), key=repr)


def close(a, b):
    assert len(a) == len(b)
    for p, q in zip(a, b, strict=True):
        for u, v in zip(p, q, strict=True):
            assert u == v or (isinstance(u, float) and abs(u - v) <= 1e-9 * max(1.0, abs(u)))


@pytest.mark.parametrize("part_cells", [48, 1000])
def test_parts_equal_the_whole_codebook(spark, part_cells):
    rng = np.random.default_rng(8)
    w = np.concatenate([clustered(rng, 45, 4), np.zeros((6, 4))])
    w = np.concatenate([w, w[:9]])
    labels = rng.integers(0, 3, len(w))
    df = frame(spark, np.concatenate([clustered(rng, 120, 4), w[:10], np.zeros((1, 4))])).repartition(5)
    cb = codes(spark, w, labels).repartition(3)
    whole, parts = Codebook.from_df(cb), CodeParts.of(cb, part_cells)
    close(rows_of(N.assign_nearest(df, parts)), rows_of(N.assign_nearest(df, whole)))
    close(rows_of(N.assign_nearest(df, parts, within_class=True)), rows_of(N.assign_nearest(df, whole, within_class=True)))
    close(rows_of(N.two_nearest(df, parts)), rows_of(N.two_nearest(df, whole)))
    flat = [(r.id, [(e.code_id, e.code_label) for e in r.nearest]) for r in N.k_nearest_codes(df, parts, 7).collect()]
    want = [(r.id, [(e.code_id, e.code_label) for e in r.nearest]) for r in N.k_nearest_codes(df, whole, 7).collect()]
    assert sorted(flat) == sorted(want)
    assert rows_of(N.predict(df, parts)) == rows_of(N.predict(df, whole))
    assert rows_of(N.predict(df, whole, method="tree")) == rows_of(N.predict(df, whole))
    assert N.predict(df.limit(0), parts).count() == 0


def test_a_codebook_above_the_limit_is_searched_in_parts(spark, monkeypatch):
    """A DataFrame codebook beyond the cells one task should hold no longer fails."""
    from riskvq.operators import codebook, large_codebook

    rng = np.random.default_rng(9)
    w = clustered(rng, 64, 3)
    df, cb = frame(spark, clustered(rng, 50, 3)), codes(spark, w, np.arange(64) % 3)
    want = rows_of(N.assign_nearest(df, Codebook.from_df(cb)))
    monkeypatch.setattr(codebook, "MAX_CELLS", 60)
    with pytest.raises(codebook.CodebookTooLarge):
        Codebook.from_df(cb)
    monkeypatch.setattr(CodeParts.of.__func__, "__defaults__", (60,))
    assert large_codebook.CodeParts.of(cb).too_large()
    close(rows_of(N.assign_nearest(df, cb)), want)


def test_bad_codebooks_are_refused(spark):
    for rows in ([(1, 0, [1.0]), (2, 0, [1.0, 2.0])], [(1, 0, None)], [(1, None, [1.0])], [(1, 0, [None])]):
        with pytest.raises(ValueError):
            CodeParts.of(spark.createDataFrame(rows, "code_id long, code_label int, w array<double>"))
    empty = CodeParts.of(spark.createDataFrame([], CODEBOOK_SCHEMA))
    df = frame(spark, np.ones((3, 2)))
    assert all(r.code_id is None for r in N.assign_nearest(df, empty).collect())
