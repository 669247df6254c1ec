"""Bags in one task, rows one by one, and training that goes on after a loss."""

import numpy as np
import pytest

from riskvq.operators import bvq as B
from riskvq.operators import som as M
from riskvq.operators.codebook import Codebook
from riskvq.operators.sampling import draw_bags
from riskvq.sources.labeled import embeddings_labeled

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def emb(spark):
    df = embeddings_labeled(spark, SF)
    odd = spark.createDataFrame([(-1, 3, None), (-2, None, [0.1] * 64), (-3, 2, [float("nan")] * 64), (-4, 1, [1.0])], df.schema)
    return df.unionByName(odd)


@pytest.fixture(scope="module")
def cb(emb):
    rows = emb.where("id >= 0").orderBy("id").limit(12).collect()
    return Codebook(np.arange(1, 13), np.array([r.label for r in rows]), np.array([r.features for r in rows]))


def serial(rows, cb, rate, half_width, cost=None, target="sample"):
    """The online rule, one row after the other."""
    w, labels = cb.w.copy(), cb.code_label
    active = 0
    for u, x in rows:
        if u is None or x is None or len(x) != cb.dims or not np.isfinite(x).all():
            continue
        x = np.array(x)
        d = ((w - x) ** 2).sum(axis=1)
        i, j = np.argsort(d, kind="stable")[:2]
        n = np.sqrt(((w[i] - w[j]) ** 2).sum())
        if labels[i] == labels[j] or n == 0 or (half_width is not None and (d[j] - d[i]) / (2 * n) > half_width):
            continue
        if cost is not None and u not in {a for a, _ in cost}:
            continue
        b = [(float(u != labels[c]) if cost is None else cost.get((u, labels[c]), 0.0)) for c in (i, j)]
        g = rate * (b[1] - b[0]) / n
        if g == 0:
            continue
        t = x
        if target == "projection":
            t = x - (x - (w[i] + w[j]) / 2) @ (w[i] - w[j]) / n**2 * (w[i] - w[j])
        w[i], w[j] = w[i] - g * (w[i] - t), w[j] + g * (w[j] - t)
        active += 1
    return w, active


@pytest.mark.parametrize("target, cost, block", [("sample", None, 512), ("projection", None, 7),
                                                  ("sample", "abs", 512), ("sample", None, 1)])
def test_online_equals_a_serial_loop(emb, cb, target, cost, block, monkeypatch):
    monkeypatch.setattr(B, "ONLINE_ROWS", block)
    cost = None if cost is None else {(a, p): abs(a - p) + 0.25 for a in range(10) for p in range(10) if a != p}
    bags = draw_bags(emb, 2, 300, 5).orderBy("bag", "pos").collect()
    want, active = serial([(r.label, r.features) for r in bags], cb, 0.3, 0.5, cost, target)
    got, hist = B.bvq_train(emb, cb, 1, 0.3, window_half_width=0.5, cost=cost, target=target, n_bags=2, bag_size=300,
                            seed=5, order="online", keep_history=True)
    assert active > 50 and [s[:2] for s in hist.steps] == [(0, 0), (0, 1)]
    np.testing.assert_allclose(got.w, want, rtol=0, atol=1e-12)
    assert hist.steps[-1][2].w.tobytes() == got.w.tobytes()


def test_chained_bags_equal_one_step_a_bag(spark, emb, cb):
    bags = draw_bags(emb, 6, 40, 7)
    step = cb
    steps = []
    for b in range(1, 7):
        step = B.bvq_step(bags.where(f"bag = {b}"), step, 0.2, 0.6)
        steps.append(step.w)
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("chain", "chain")
    got, hist = B.bvq_train(emb, cb, 3, 0.2, 0.6, n_bags=2, bag_size=40, seed=7, keep_history=True)
    n_jobs = len(jobs.getJobIdsForGroup("chain"))
    spark.sparkContext.setJobGroup("other", "other")
    assert n_jobs <= 5  # count, draw and train in a few stages; not some a bag
    assert [s[:2] for s in hist.steps] == [(e, b) for e in range(3) for b in range(2)]
    for (_, _, have), want in zip(hist.steps, steps, strict=True):
        np.testing.assert_allclose(have.w, want, rtol=1e-11, atol=1e-13)
    exact = [B.bvq_train(emb.repartition(p), cb, 3, 0.2, 0.6, n_bags=2, bag_size=40, seed=7, replicable=True)[0].w.tobytes()
             for p in (1, 9)]
    assert exact[0] == exact[1]
    np.testing.assert_allclose(got.w, np.frombuffer(exact[0]).reshape(got.w.shape), rtol=1e-11, atol=1e-13)


def test_large_bags_are_distributed_steps(emb, cb, monkeypatch):
    want, _ = B.bvq_train(emb, cb, 1, 0.2, 0.6, n_bags=2, bag_size=40, seed=7)
    monkeypatch.setattr(B, "ONE_TASK_ROWS", 39)
    got, _ = B.bvq_train(emb, cb, 1, 0.2, 0.6, n_bags=2, bag_size=40, seed=7)
    np.testing.assert_allclose(got.w, want.w, rtol=1e-11, atol=1e-13)
    with pytest.raises(ValueError):
        B.bvq_train(emb, cb, 1, 0.2, n_bags=2, bag_size=40, order="online")
    with pytest.raises(ValueError):
        B.bvq_train(emb, cb, 1, 0.2, use_bags=False, order="online")


def test_window_returns_the_columns_asked_for(emb, cb):
    whole = B.bvq_window(emb, cb, None)
    some = B.bvq_window(emb, cb, None, keep=["id"])
    assert some.columns == ["id", *whole.columns[3:]]
    assert sorted(map(tuple, some.collect())) == sorted(map(tuple, whole.select(*some.columns).collect()))
    unrolled = B.bvq_window(emb, cb, None, keep=["id"], method="expr")
    assert unrolled.columns[0] == "id" and "features" not in unrolled.columns and unrolled.count() == some.count()


class Lost(Exception):
    pass


def cut_after(monkeypatch, module, name, calls):
    """Fail at the call after ``calls``, as if the driver were lost."""
    plain, done = getattr(module, name), []

    def failing(*a, **k):
        if len(done) == calls:
            raise Lost
        done.append(1)
        return plain(*a, **k)

    monkeypatch.setattr(module, name, failing)
    return done


def test_a_cut_run_goes_on(emb, cb, tmp_path, monkeypatch):
    def bags(**more):
        return B.bvq_train(emb, cb, 4, 0.2, 0.6, n_bags=2, bag_size=40, seed=7, replicable=True, **more)[0]

    def whole(**more):
        return B.bvq_train(emb, cb, 3, 0.1, 0.6, use_bags=False, replicable=True, **more)[0]

    def som(**more):
        return M.som_train(emb, cb, 3, 0.1, sample_fraction=0.6, seed=2, replicable=True, **more)

    for k, (train, module, name) in enumerate(((bags, B, "_trained_in_one_task"), (whole, B, "bvq_step"), (som, M, "som_step"))):
        folder = str(tmp_path / f"run{k}")
        want = train().w.tobytes()
        with monkeypatch.context() as m:
            cut_after(m, module, name, 2)
            with pytest.raises(Lost):
                train(progress=folder)
        with monkeypatch.context() as m:
            done = cut_after(m, module, name, 99)
            assert train(progress=folder).w.tobytes() == want
            assert 0 < len(done) <= 2  # the epochs that were left
        with monkeypatch.context() as m:
            assert cut_after(m, module, name, 99) == [] and train(progress=folder).w.tobytes() == want
    with pytest.raises(ValueError, match="another start"):
        M.som_train(emb, cb, 3, 0.2, sample_fraction=0.6, seed=2, replicable=True, progress=str(tmp_path / "run2"))
