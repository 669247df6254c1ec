"""Properties and edge cases of the operators (brute force on small inputs)."""

import hashlib
import os
import tempfile

import numpy as np
import pytest
from pyspark.sql import functions as F

from riskvq.functions import vectors as V
from riskvq.functions.keys import draw_key, key_threshold
from riskvq.operators import evaluate as E
from riskvq.operators import sampling as S
from riskvq.operators.bvq import bvq_step, bvq_train
from riskvq.operators.codebook import Codebook, CodebookTooLarge, check_size
from riskvq.operators.nearest import assign_nearest, two_nearest
from riskvq.operators.ranking import with_position
from riskvq.operators.som import som_step
from riskvq.sources.generate import uniform_features, uniform_table
from riskvq.sources.labeled import LABELED_SCHEMA, embeddings_labeled, events_labeled, from_matrix, read_labeled_csv, to_labeled

SF = "/root/testdata/sf0.001"


def md5key(seed, purpose, id_):
    return hashlib.md5(f"{seed}:{purpose}:{id_}".encode()).hexdigest()


@pytest.fixture(scope="module")
def emb(spark):
    return embeddings_labeled(spark, SF)


@pytest.fixture(scope="module")
def ev(spark):
    return events_labeled(spark, SF)


def test_keyed_draws_do_not_depend_on_partitioning(ev):
    a = {r.id for r in S.bernoulli_sample(ev, 0.2, 7).collect()}
    b = {r.id for r in S.bernoulli_sample(ev.repartition(13, "label"), 0.2, 7).collect()}
    assert a == b and 0 < len(a) < ev.count()


def test_split_parts_disjoint_and_complete(ev):
    sp = S.split_random(ev, 80, 3)
    parts = {r.id: r.part for r in sp.collect()}
    assert len(parts) == ev.count()
    assert set(parts.values()) == {"train", "test"}


def test_split_by_position_matches_brute_force(ev):
    ids = sorted(r.id for r in ev.select("id").collect())
    cut = len(ids) * 37 // 100
    got = {r.id: r.part for r in S.split_by_position(ev.repartition(5), 37).collect()}
    assert all(got[i] == ("train" if k < cut else "test") for k, i in enumerate(ids))


def test_with_position_is_a_permutation(ev):
    pos = [r.pos for r in with_position(ev.repartition(7), ["label", "id"]).collect()]
    assert sorted(pos) == list(range(1, len(pos) + 1))


def test_shuffle_rows_matches_md5_order(ev):
    rows = {r.id: r.pos for r in S.shuffle_rows(ev, 11).collect()}
    order = sorted(rows, key=lambda i: (md5key(11, 'shuffle', i), i))
    assert [rows[i] for i in order] == list(range(1, len(order) + 1))


def test_draw_bags_wraps_past_the_end(spark, emb):
    small = emb.where(F.col("id") < 30)
    bags = S.draw_bags(small, 4, 20, 5).collect()
    order = sorted(range(30), key=lambda i: (md5key(5, 'bag', i), i))
    expect = {(s // 20 + 1, s % 20 + 1): order[s % 30] for s in range(80)}
    assert {(r.bag, r.pos): r.id for r in bags} == expect
    for b in range(1, 5):
        ids = [r.id for r in bags if r.bag == b]
        assert len(ids) == len(set(ids)) == 20


def test_init_per_class_quota_and_short_class(emb):
    cb = S.init_codebook_per_class(emb, {0: 2, 1: 1000}, 9).collect()
    n1 = emb.where("label = 1").count()
    assert sum(r.code_label == 0 for r in cb) == 2
    assert sum(r.code_label == 1 for r in cb) == n1
    assert sorted(r.code_id for r in cb) == list(range(1, 3 + n1))


def test_init_per_class_brute_force(emb):
    rows = emb.select("id", "label").collect()
    got = {(r.code_label, r.code_id) for r in S.init_codebook_per_class(emb, {3: 4, 7: 2}, 21).collect()}
    exp = set()
    off = 0
    for c, q in [(3, 4), (7, 2)]:
        ids = sorted((md5key(21, 'init', r.id), r.id) for r in rows if r.label == c)[:q]
        exp |= {(c, off + k + 1) for k in range(len(ids))}
        off += q
    assert got == exp


def test_limit_n_and_init_sampled(emb):
    top = S.limit_n(emb, 5, 4).collect()
    ids = sorted((md5key(4, 'limit', r.id), r.id) for r in emb.select("id").collect())[:5]
    assert [r.id for r in sorted(top, key=lambda r: r.pos)] == [i for _, i in ids]
    assert S.init_codebook_sampled(emb, 5, 4).count() == 5
    assert S.init_codebook_sampled(emb.limit(3), 5, 4).count() == 3


def test_vectors_unequal_lengths_are_null(spark):
    df = spark.createDataFrame([([1.0, 2.0], [1.0, 2.0, 3.0])], "a array<double>, b array<double>")
    r = df.select(V.vec_sqdist("a", "b").alias("d"), V.vec_add("a", "b").alias("s"),
                  V.vec_dot("a", "b").alias("p")).collect()[0]
    assert r.d is None and r.s is None and r.p is None


def test_vectors_skip_last(spark):
    df = spark.createDataFrame([([1.0, 2.0, 4.0], [1.0, 1.0, 1.0])], "a array<double>, b array<double>")
    r = df.select(V.vec_sum("a").alias("s"), V.vec_sum("a", 1).alias("s1"), V.vec_dot("a", "b", 1).alias("d1"),
                  V.vec_sum(F.array().cast("array<double>"), 1).alias("e")).collect()[0]
    assert (r.s, r.s1, r.d1, r.e) == (7.0, 3.0, 3.0, 0.0)


@pytest.mark.parametrize("method", ["arrow", "unrolled", "expr"])
def test_nearest_paths_agree_with_numpy(emb, method):
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {c: 2 for c in range(10)}, 1))
    pdf = emb.toPandas().sort_values("id")
    x = np.stack(pdf.features.to_numpy())
    d = ((x[:, None, :] - cb.w[None]) ** 2).sum(-1)
    got = assign_nearest(emb, cb, method=method).toPandas().sort_values("id")
    assert (cb.code_id[d.argmin(1)] == got.code_id.to_numpy()).all()
    assert np.allclose(d.min(1), got.d2.to_numpy(), rtol=1e-12)
    two = two_nearest(emb, cb, method=method).toPandas().sort_values("id")
    second = np.argsort(d, axis=1, kind="stable")[:, 1]
    assert (cb.code_id[second] == two.code_j.to_numpy()).all()


@pytest.mark.parametrize("method", ["arrow", "unrolled", "expr"])
def test_nearest_within_class_and_bad_rows(spark, method):
    cb = Codebook(np.array([1, 2]), np.array([0, 1]), np.array([[0.0, 0.0], [1.0, 1.0]]))
    df = spark.createDataFrame([(1, 1, [0.1, 0.1]), (2, 0, [0.9, 0.9]), (3, 0, [1.0]), (4, 5, [0.0, 0.0])],
                               LABELED_SCHEMA)
    got = {r.id: r.code_id for r in assign_nearest(df, cb, within_class=True, method=method).collect()}
    assert got == {1: 2, 2: 1, 3: None, 4: None}
    plain = {r.id: r.code_id for r in assign_nearest(df, cb, method=method).collect()}
    assert plain == {1: 1, 2: 2, 3: None, 4: 1}


def test_ties_go_to_lower_code_id(spark):
    cb = Codebook(np.array([7, 3]), np.array([0, 1]), np.array([[1.0, 0.0], [-1.0, 0.0]]))
    df = spark.createDataFrame([(1, 0, [0.0, 0.0])], LABELED_SCHEMA)
    for m in ["arrow", "unrolled", "expr"]:
        assert assign_nearest(df, cb, method=m).collect()[0].code_id == 3


def test_som_rate_zero_is_identity_and_empty_code_stays(emb):
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {0: 2, 1: 2}, 1))
    far = cb.w.copy()
    far[0] += 1e6
    cb2 = cb.with_weights(far)
    assert np.array_equal(som_step(emb, cb2, 0.0).w, cb2.w)
    moved = som_step(emb, cb2, 0.5)
    assert np.array_equal(moved.w[0], cb2.w[0])
    assert not np.array_equal(moved.w[1:], cb2.w[1:])


def test_som_step_matches_numpy(emb):
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {c: 1 for c in range(10)}, 2))
    pdf = emb.toPandas()
    x = np.stack(pdf.features.to_numpy())
    win = ((x[:, None, :] - cb.w[None]) ** 2).sum(-1).argmin(1)
    exp = cb.w.copy()
    for k in range(cb.k):
        if (win == k).any():
            exp[k] += 0.3 * (x[win == k].mean(0) - exp[k])
    assert np.allclose(som_step(emb, cb, 0.3).w, exp, atol=1e-12)


def test_som_radius_pulls_neighbours(emb):
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {0: 3}, 2))
    only = emb.where("label = 0")
    a, b = som_step(only, cb, 0.5, radius=0), som_step(only, cb, 0.5, radius=2)
    assert not np.allclose(a.w, b.w)


def test_bvq_equal_labels_move_nothing(spark):
    cb = Codebook(np.array([1, 2]), np.array([1, 1]), np.array([[0.0, 0.0], [1.0, 0.0]]))
    df = spark.createDataFrame([(1, 2, [0.5, 0.0])], LABELED_SCHEMA)
    assert np.array_equal(bvq_step(df, cb, 0.1, window_half_width=10).w, cb.w)


def test_bvq_duplicate_codes_move_nothing(spark):
    cb = Codebook(np.array([1, 2]), np.array([1, 2]), np.array([[0.0, 0.0], [0.0, 0.0]]))
    df = spark.createDataFrame([(1, 2, [0.5, 0.0])], LABELED_SCHEMA)
    assert np.array_equal(bvq_step(df, cb, 0.1, window_half_width=10).w, cb.w)


def test_bvq_batch_equals_sum_of_single_rows(spark):
    cb = Codebook(np.array([1, 2]), np.array([1, 2]), np.array([[0.0, 0.0], [1.0, 0.0]]))
    rows = [(1, 2, [0.45, 0.1]), (2, 1, [0.55, -0.1])]
    both = bvq_step(spark.createDataFrame(rows, LABELED_SCHEMA), cb, 0.1, window_half_width=1)
    d = np.zeros_like(cb.w)
    for r in rows:
        one = bvq_step(spark.createDataFrame([r], LABELED_SCHEMA), cb, 0.1, window_half_width=1)
        d += one.w - cb.w
    assert np.allclose(both.w, cb.w + d, atol=1e-15)


def test_bvq_train_bags_and_epochs(emb):
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {c: 2 for c in range(10)}, 1))
    out, hist = bvq_train(emb, cb, epochs=2, rate=0.05, delta=2.0, n_bags=3, bag_size=40, seed=3,
                          keep_history=True)
    assert len(hist.steps) == 6 and out.k == cb.k
    assert list(out.code_label) == list(cb.code_label)


def test_evaluation(spark):
    pred = spark.createDataFrame([(1, 0, 0), (2, 0, 1), (3, 1, 1), (4, 1, 1)], "id long, label int, pred int")
    assert E.accuracy(pred).collect()[0].accuracy == 0.75
    cost = E.cost_table(spark, [0, 1], [[0, 5], [2, 0]])
    assert E.mean_cost(pred, cost).collect()[0].mean_cost == 1.25
    cm = E.confusion_matrix(pred, [0, 1]).orderBy("actual").collect()
    assert [(r["0"], r["1"], r["other"]) for r in cm] == [(1, 1, 0), (0, 2, 0)]
    odd = spark.createDataFrame([(1, 0, None), (2, 0, 7), (3, None, 0), (4, 0, 0)], "id long, label int, pred int")
    cm = {r["actual"]: (r["0"], r["1"], r["other"]) for r in E.confusion_matrix(odd, [0, 1]).collect()}
    assert cm == {0: (1, 0, 2), None: (1, 0, 0)}
    mc = E.mean_cost(odd, cost).collect()[0]
    assert (mc.mean_cost, mc.n_unlisted) == (0.0, 3)


def test_codebook_bounds():
    with pytest.raises(CodebookTooLarge):
        check_size(10, 2_000_000)


def test_uniform_features_range_and_probe(spark, ev):
    u = uniform_features(ev, 3, 5, -2.0, 3.0).collect()
    vals = np.array([r.features for r in u])
    assert vals.shape == (ev.count(), 3) and vals.min() >= -2.0 and vals.max() < 3.0
    table, probe = uniform_table(spark, 10, 4, 1)
    assert table.count() == 10 and len(probe.collect()[0].features) == 4


def test_read_labeled_csv_quirks(spark):
    d = tempfile.mkdtemp(prefix="riskvq-csv-")
    path = os.path.join(d, "in.csv")
    with open(path, "wb") as fh:
        fh.write("﻿1,1,0.5,-0.25 \r\n2,2.0,1.5,2 \r\n3,1,abc,1\r\n".encode("utf-8"))
    rows = {r.id: r for r in read_labeled_csv(spark, path, 2).collect()}
    assert rows[1].label == 1 and rows[1].features == [0.5, -0.25]
    assert rows[2].label == 2 and rows[2].features == [1.5, 2.0]
    assert rows[3].features[0] is None


def test_labels_that_are_no_int_read_as_null(spark):
    df = spark.createDataFrame([(1, float("nan"), 0.5), (2, 1e30, 0.5), (3, 2.9, 0.5), (4, None, 0.5)], "id long, y double, x double")
    got = {r.id: r.label for r in to_labeled(df, "id", "y", ["x"]).collect()}
    assert got == {1: None, 2: None, 3: 2, 4: None}
    text = spark.createDataFrame([(1, "abc", 0.5), (2, "3", 0.5)], "id long, y string, x double")
    assert {r.id: r.label for r in to_labeled(text, "id", "y", ["x"]).collect()} == {1: None, 2: 3}
    last = spark.createDataFrame([(0.5, float("inf"))], "x double, y double")
    assert from_matrix(last).collect()[0].label is None


def test_empty_table(spark):
    empty = spark.createDataFrame([], LABELED_SCHEMA)
    assert S.row_count(empty).collect()[0].n == 0
    assert S.init_codebook_per_class(empty, {0: 2}, 1).count() == 0
    assert S.draw_bags(empty, 2, 3, 1).count() == 0
    assert with_position(empty, ["id"]).count() == 0


def test_codebook_inline_table_round_trip_is_exact(spark):
    rng = np.random.default_rng(3)
    w = rng.normal(size=(7, 5)) * 10.0 ** rng.integers(-300, 300, size=(7, 5))
    w[0, 0], w[1, 1], w[2, 2] = 0.1, -0.0, 5e-324
    cb = Codebook(np.arange(7) * 3, np.arange(7) % 2, w)
    back = Codebook.from_df(cb.to_df(spark))
    assert np.array_equal(back.w, cb.w) and np.array_equal(back.code_id, cb.code_id)
    plan = cb.to_df(spark)._jdf.queryExecution().optimizedPlan().toString()
    assert "LocalRelation" in plan


def test_draw_bags_prefiltered_matches_brute_force(emb):
    bags = S.draw_bags(emb.repartition(6), 3, 20, 8).collect()
    order = sorted((r.id for r in emb.select("id").collect()), key=lambda i: (md5key(8, 'bag', i), i))
    assert {(r.bag, r.pos): r.id for r in bags} == {(s // 20 + 1, s % 20 + 1): order[s] for s in range(60)}


def test_draw_bags_large_path(emb, monkeypatch):
    monkeypatch.setattr(S, "MAX_TOP_ROWS", 10)
    bags = S.draw_bags(emb, 3, 20, 8).collect()
    order = sorted((r.id for r in emb.select("id").collect()), key=lambda i: (md5key(8, 'bag', i), i))
    assert {(r.bag, r.pos): r.id for r in bags} == {(s // 20 + 1, s % 20 + 1): order[s] for s in range(60)}


@pytest.mark.parametrize("k", [1, 2, 37, 499, 500])
def test_kth_smallest(emb, k):
    ids = sorted(r.id for r in emb.select("id").collect())
    assert S.kth_smallest(emb.repartition(4), "id", k, rel_error=0.01) == ids[k - 1]


@pytest.mark.parametrize("pct", [0, 1, 50, 99, 100])
def test_split_by_position_edges(ev, pct):
    ids = sorted(r.id for r in ev.select("id").collect())
    cut = len(ids) * pct // 100
    got = {r.id: r.part for r in S.split_by_position(ev, pct).collect()}
    assert all(got[i] == ("train" if k < cut else "test") for k, i in enumerate(ids))


def test_split_by_position_general_order(ev):
    rows = sorted((r.label, r.id) for r in ev.select("label", "id").collect())
    cut = len(rows) * 30 // 100
    got = {r.id: r.part for r in S.split_by_position(ev, 30, order_by=["label"]).collect()}
    assert all(got[i] == ("train" if k < cut else "test") for k, (_, i) in enumerate(rows))


def test_bvq_kernel_agrees_with_expressions(emb):
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {c: 2 for c in range(10)}, 1))
    cost = {(a, p): float(abs(a - p)) + (0.5 if a == 3 else 0.0) for a in range(9) for p in range(10)}
    for target in ("sample", "projection"):
        for c in (None, cost):
            kernel = bvq_step(emb, cb, 0.05, delta=2.0, target=target, cost=c)
            rows = bvq_step(emb, cb, 0.05, delta=2.0, target=target, cost=c, method="expr")
            assert np.allclose(kernel.w, rows.w, rtol=0, atol=1e-12) and not np.allclose(kernel.w, cb.w)


def test_som_kernel_agrees_with_expressions(emb):
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {c: 3 for c in range(10)}, 1))
    for radius in (0, 1):
        for within in (False, True):
            a = som_step(emb, cb, 0.3, radius=radius, within_class=within)
            b = som_step(emb, cb, 0.3, radius=radius, within_class=within, method="expr")
            assert np.allclose(a.w, b.w, rtol=0, atol=1e-12)


def test_incomplete_cost_raises(emb):
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {0: 1, 1: 1}, 1))
    with pytest.raises(ValueError, match="not given"):
        bvq_step(emb, cb, 0.1, cost={(0, 0): 0.0, (1, 0): 1.0})


def test_weighted_sums_wide_form_matches_unrolled(emb, monkeypatch):
    import riskvq.operators.aggregates as A
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {c: 2 for c in range(10)}, 1))
    a = som_step(emb, cb, 0.3)
    monkeypatch.setattr(A, "UNROLL_MAX_DIMS", 8)
    b = som_step(emb, cb, 0.3)
    c = bvq_step(emb, cb, 0.05, delta=2.0)
    monkeypatch.setattr(A, "UNROLL_MAX_DIMS", 256)
    d = bvq_step(emb, cb, 0.05, delta=2.0)
    assert np.allclose(a.w, b.w, rtol=0, atol=1e-12) and np.allclose(c.w, d.w, rtol=0, atol=1e-12)


def test_class_profile_wide_form_matches(emb, monkeypatch):
    import riskvq.operators.evaluate as EV
    a = {(r.label, r.dim): r for r in E.class_profile(emb, 64).collect()}
    monkeypatch.setattr(EV, "UNROLL_MAX_DIMS", 8)
    b = {(r.label, r.dim): r for r in E.class_profile(emb, 64).collect()}
    assert a.keys() == b.keys() and len(a) == 640
    for k in a:
        assert a[k].n == b[k].n and np.allclose([a[k].mean, a[k].std, a[k].min, a[k].max],
                                                [b[k].mean, b[k].std, b[k].min, b[k].max], atol=1e-12)


@pytest.mark.parametrize("within", [False, True])
def test_arrow_gemm_ranking_matches_exact(emb, monkeypatch, within):
    import riskvq.operators.nearest as NN
    base = Codebook.from_df(S.init_codebook_per_class(emb, {c: 3 for c in range(10)}, 4))
    # duplicate codes create exact ties that must still go to the lower code_id
    w = np.vstack([base.w, base.w[:5]])
    cb = Codebook(np.arange(1, len(w) + 1), np.concatenate([base.code_label, base.code_label[:5]]), w)
    exact_one = assign_nearest(emb, cb, within_class=within, method="arrow").toPandas().sort_values("id")
    exact_two = two_nearest(emb, cb, method="arrow").toPandas().sort_values("id")
    monkeypatch.setattr(NN, "GEMM_MIN_TERMS", 1)
    gemm_one = assign_nearest(emb, cb, within_class=within, method="arrow").toPandas().sort_values("id")
    gemm_two = two_nearest(emb, cb, method="arrow").toPandas().sort_values("id")
    assert (exact_one.code_id.to_numpy() == gemm_one.code_id.to_numpy()).all()
    assert np.allclose(exact_one.d2.to_numpy(), gemm_one.d2.to_numpy(), rtol=1e-12)
    for c in ("code_i", "code_j"):
        assert (exact_two[c].to_numpy() == gemm_two[c].to_numpy()).all()


@pytest.mark.parametrize("method", ["arrow", "unrolled", "expr"])
def test_null_feature_element_scores_null(spark, method):
    cb = Codebook(np.array([1, 2]), np.array([0, 1]), np.array([[0.0, 0.0], [1.0, 1.0]]))
    df = spark.createDataFrame([(1, 0, [0.1, None]), (2, 1, None), (3, 1, [0.9, 1.0])], LABELED_SCHEMA)
    got = {r.id: (r.code_id, r.d2) for r in assign_nearest(df, cb, method=method).collect()}
    assert got[1] == (None, None) and got[2] == (None, None) and got[3][0] == 2


def test_one_class_table_leaves_bvq_codebook_unchanged(emb):
    one = emb.where("label = 3")
    cb = Codebook.from_df(S.init_codebook_per_class(one, {3: 4}, 2))
    assert np.array_equal(bvq_step(one, cb, 0.1, delta=10.0).w, cb.w)
    out, _ = bvq_train(one, cb, epochs=1, rate=0.1, delta=10.0, n_bags=2, bag_size=10, seed=1)
    assert np.array_equal(out.w, cb.w)


def test_bvq_cost_map_and_join_agree(emb, monkeypatch):
    import riskvq.operators.bvq as B
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {c: 2 for c in range(10)}, 1))
    cost = {(a, p): float(abs(a - p)) + (0.5 if a == 3 else 0.0) for a in range(10) for p in range(10) if a != p}
    a = bvq_step(emb, cb, 0.05, delta=2.0, cost=cost, method="expr")
    monkeypatch.setattr(B, "MAP_COST_CELLS", 1)
    b = bvq_step(emb, cb, 0.05, delta=2.0, cost=cost, method="expr")
    assert np.allclose(a.w, b.w, rtol=0, atol=1e-12) and not np.array_equal(a.w, cb.w)


def test_vec_avg_forms_agree(emb, monkeypatch):
    import riskvq.operators.aggregates as A
    a = {r.label: r.avg for r in A.vec_avg(emb, "label", dims=64).collect()}
    monkeypatch.setattr(A, "UNROLL_MAX_DIMS", 8)
    b = {r.label: r.avg for r in A.vec_avg(emb, "label", dims=64).collect()}
    assert a.keys() == b.keys() and all(np.allclose(a[k], b[k], atol=1e-12) for k in a)


def test_k_nearest_arrow_matches_expression_path(emb):
    from riskvq.operators.nearest import k_nearest_codes
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {c: 2 for c in range(10)}, 1))
    for k in (1, 2, 4):
        a = {r.id: [(n.code_id, n.code_label) for n in r.nearest] for r in k_nearest_codes(emb, cb, k).collect()}
        b = {r.id: [(n.code_id, n.code_label) for n in r.nearest]
             for r in k_nearest_codes(emb, cb, k, method="expr").collect()}
        assert a == b and all(len(v) == k for v in a.values())


def test_codebook_collect_checks_size_first(emb, monkeypatch):
    import riskvq.operators.codebook as CBM
    cbdf = S.init_codebook_per_class(emb, {c: 2 for c in range(10)}, 1)
    assert Codebook.from_df(cbdf).k == 20
    monkeypatch.setattr(CBM, "MAX_CELLS", 100)
    with pytest.raises(CodebookTooLarge):
        Codebook.from_df(cbdf)
    with pytest.raises(CodebookTooLarge):
        Codebook.from_df(cbdf, max_codes=5)


# -- draws are independent of each other ----------------------------------------

def test_sample_of_a_test_part_keeps_its_fraction(spark):
    ev = events_labeled(spark, "/root/testdata/sf0.01")
    train, test = S.train_test(S.split_random(ev, 80, 15))
    for part in (train, test):
        n = part.count()
        kept = S.bernoulli_sample(part, 0.5, 15).count()
        assert abs(kept - 0.5 * n) < 5 * (0.25 * n) ** 0.5
    again = {r.part: r["count"] for r in S.split_random(test, 50, 15, salt="again").groupBy("part").count().collect()}
    n = sum(again.values())
    assert abs(again["train"] - n / 2) < 5 * (0.25 * n) ** 0.5


def test_bags_do_not_prefer_code_vectors(spark):
    ev = events_labeled(spark, "/root/testdata/sf0.01")
    codes = {tuple(r.w) for r in S.init_codebook_per_class(ev, {c: 40 for c in range(5)}, 15).collect()}
    bag = S.draw_bags(ev, 1, 1000, 15).collect()
    inside = sum(tuple(r.features) in codes for r in bag)
    n = ev.count()
    assert inside <= 1000 * 200 / n + 5 * (1000 * 200 / n) ** 0.5


def test_som_epochs_draw_samples_of_their_own(ev):
    a, b = ({r.id for r in S.bernoulli_sample(ev, 0.5, 3, salt=f"som:{e}").collect()} for e in range(2))
    assert abs(len(a & b) / len(a) - 0.5) < 0.1


def test_tiny_fractions_have_a_threshold(ev):
    assert int(key_threshold(1e-15), 16) > 0 and int(key_threshold(33 / 1e14), 16) > 0
    assert key_threshold(1.0) is None and key_threshold(0.0) == "0" * 16
    n = ev.count()
    few = S._smallest_keys(ev, draw_key("id", 1, "bag"), 5, n, slack_sd=0.0)  # too tight at first: takes a larger threshold
    assert 5 <= few.count() < n


def test_codes_come_from_whole_rows_only(spark):
    rows = [(1, 0, None), (2, None, [1.0, 2.0]), (3, 0, [1.0, None]), (4, 0, [float("nan"), 1.0]), (5, 0, [1.0, 2.0]), (6, 1, [3.0, 4.0])]
    df = spark.createDataFrame(rows, LABELED_SCHEMA)
    for cb in (S.init_codebook_first(df, 5), S.init_codebook_sampled(df, 5, 1), S.init_codebook_per_class(df, {0: 5, 1: 5}, 1)):
        assert sorted(Codebook.from_df(cb).w.tolist()) == [[1.0, 2.0], [3.0, 4.0]]
    bad = spark.createDataFrame([(1, 0, None)], "code_id long, code_label int, w array<double>")
    with pytest.raises(ValueError, match="whole vector"):
        Codebook.from_df(bad)


def test_limit_by_other_orders(spark, emb):
    ids = sorted(r.id for r in emb.select("id").collect())
    assert [r.id for r in sorted(S.limit_n(emb, 7, order_by=["id"]).collect(), key=lambda r: r.pos)] == ids[:7]
    rows = sorted((r.label, r.id) for r in emb.select("label", "id").collect())
    top = sorted(S.limit_n(emb, 7, order_by=["label"]).collect(), key=lambda r: r.pos)
    assert [r.id for r in top] == [i for _, i in rows[:7]]
    nulls = spark.createDataFrame([(None, 1), (5, 2), (3, 3), (4, 4)], "id long, x int")
    assert [r.id for r in sorted(S.limit_n(nulls, 3, order_by=["id"]).collect(), key=lambda r: r.pos)] == [None, 3, 4]


def test_with_position_many_ranges_ties_and_nulls(spark):
    rows = [(i, None if i % 7 == 0 else float(i % 5), f"s{i % 3}") for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, x double, s string").repartition(9)
    got = {r.id: r.pos for r in with_position(df, ["x", "s", "id"]).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0.0, r[2], r[0]))
    assert all(got[r[0]] == k + 1 for k, r in enumerate(order))


# -- one rule for NULLs in both forms ---------------------------------------------

ODD = [(1, None, [1.0, 2.0, 3.0]), (2, 0, None), (3, 1, [4.0]), (4, 1, [6.0, None, 1.0]), (5, 1, [1.0, 2.0, 3.0, 9.0])]


def test_class_profile_forms_agree_on_odd_rows(spark, monkeypatch):
    import riskvq.operators.evaluate as EV
    df = spark.createDataFrame(ODD, LABELED_SCHEMA)
    narrow = sorted(map(tuple, E.class_profile(df, 3).collect()), key=repr)
    monkeypatch.setattr(EV, "UNROLL_MAX_DIMS", 1)
    wide = sorted(map(tuple, E.class_profile(df, 3).collect()), key=repr)
    assert narrow == wide and len(narrow) == 9
    assert (0, 0, 1, None, None, None, None) in narrow


def test_vec_avg_forms_agree_on_odd_rows(spark, monkeypatch):
    import riskvq.operators.aggregates as A
    df = spark.createDataFrame(ODD, LABELED_SCHEMA)
    narrow = sorted(map(tuple, A.vec_avg(df, "label", dims=3).collect()), key=repr)
    long = sorted(map(tuple, A.vec_avg_long(df, "label", dims=3).collect()), key=repr)
    monkeypatch.setattr(A, "UNROLL_MAX_DIMS", 1)
    assert narrow == sorted(map(tuple, A.vec_avg(df, "label", dims=3).collect()), key=repr)
    assert long == sorted(map(tuple, A.vec_avg_long(df, "label", dims=3).collect()), key=repr) and len(long) == 9
    free = {r.label: (r.avg, r.n) for r in A.vec_avg(df, "label").collect()}
    assert free[0] == ([], 1) and len(free[1][0]) == 4 and free[None] == ([1.0, 2.0, 3.0], 1)


@pytest.mark.parametrize("features", [[0.1, None], [0.1, float("nan")], [float("inf"), 0.0], [0.1], [], None])
def test_paths_agree_on_bad_values(spark, features):
    cb = Codebook(np.array([1, 2]), np.array([0, 1]), np.array([[0.0, 0.0], [1.0, 1.0]]))
    df = spark.createDataFrame([(1, 0, features), (2, 1, [0.9, 1.0])], LABELED_SCHEMA)
    for m in ("arrow", "unrolled", "expr"):
        got = {r.id: (r.code_id, r.code_label, r.d2) for r in assign_nearest(df, cb, method=m).collect()}
        assert got[1] == (None, None, None) and got[2][0] == 2
        two = {r.id: (r.code_i, r.code_j) for r in two_nearest(df, cb, method=m).collect()}
        assert two == {1: (None, None), 2: (2, 1)}


def test_one_bad_row_does_not_slow_a_batch():
    import time

    import pyarrow as pa
    from riskvq.operators.nearest import make_finder
    rng = np.random.default_rng(0)
    x = rng.normal(size=(20_000, 64))
    _, matrix = make_finder(np.array([0]), np.zeros((1, 64)), 1, False, 10**9)
    clean = pa.array(list(x), pa.list_(pa.float64()))
    rows = x.tolist()
    rows[7], rows[9], rows[11] = None, [1.0], [None] * 64
    odd = pa.array(rows, pa.list_(pa.float64()))

    def seconds(col):
        best = 9.0
        for _ in range(5):
            t = time.perf_counter()
            m, ok = matrix(col)
            best = min(best, time.perf_counter() - t)
        return best, m, ok

    t0, _, _ = seconds(clean)
    t1, m, ok = seconds(odd)
    assert np.flatnonzero(~ok).tolist() == [7, 9, 11] and np.array_equal(m[ok], x[ok])
    assert t1 < 10 * t0 + 0.05  # a Python loop over the batch would take seconds


def test_large_codebook_step_needs_no_table_of_pairs(spark, emb):
    import resource
    rng = np.random.default_rng(1)
    cb = Codebook(np.arange(1, 2001), np.arange(2000) % 10, rng.normal(size=(2000, 64)) / 8)
    before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss
    out = bvq_step(emb, cb, 0.05, delta=2.0)
    assert not np.array_equal(out.w, cb.w)
    assert resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before < 1_000_000  # KB


def test_exact_pick_in_blocks(monkeypatch):
    from riskvq.operators.nearest import make_finder
    rng = np.random.default_rng(2)
    w = np.repeat(rng.normal(size=(30, 6)), 2, axis=0)  # every code twice: all rows are ties
    x = rng.normal(size=(500, 6))
    labels = np.arange(60) % 3
    exact, gemm = (make_finder(labels, w, 2, False, t)[0](x, None) for t in (10**9, 1))
    assert np.array_equal(exact[0], gemm[0]) and np.allclose(exact[1], gemm[1])
