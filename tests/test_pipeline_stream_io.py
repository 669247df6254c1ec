"""End-to-end run, report sink round trip, and scoring on a file stream."""

import os
import tempfile

import pytest

from riskvq.operators import sampling as S
from riskvq.operators.codebook import Codebook
from riskvq.operators.nearest import predict
from riskvq.plans.pipeline import RunParams, classify_pipeline, run_report, stage_codebooks
from riskvq.sources.labeled import embeddings_labeled, table
from riskvq.sources.report import write_run_report
from riskvq.streaming.scoring import read_labeled_stream, start_confusion, start_scoring

SF = "/root/testdata/sf0.001"


def scratch(prefix):
    return tempfile.mkdtemp(prefix=prefix, dir=os.environ.get("RISKVQ_SCRATCH", "/tmp"))


def test_pipeline_launch_shape(spark):
    emb = embeddings_labeled(spark, SF)
    params = RunParams(per_class={c: 1 for c in range(10)}, seed=15, som_epochs=2, bvq_epochs=2, n_bags=3,
                       bag_size=20, delta=0.5)
    res = classify_pipeline(emb, params)
    assert [s for s, _ in res.stages] == ["init", "som", "bvq"]
    conf = res.confusion().collect()
    test_rows = res.split.where("part = 'test'").count()
    assert sum(r.n for r in conf) == test_rows
    acc = res.accuracy().collect()[0].accuracy
    assert acc == sum(r.n for r in conf if r.actual == r.predicted) / test_rows
    report = {r.metric: r.value for r in run_report(res, list(range(10))).collect()}
    assert report["codes"] == "10" and float(report["mean_cost"]) == pytest.approx(1 - acc)
    assert report["param_seed"] == "15" and report["param_bag_size"] == "20" and report["unlisted_rows"] == "0"
    cells = {(int(k[10:]), c): int(v) for k, row in report.items() if k.startswith("confusion_") and k[10:].isdigit()
             for c, v in zip(report["confusion_columns"].split(), row.split(), strict=True)}
    assert sum(cells.values()) == test_rows and all(cells[r.actual, str(r.predicted)] == r.n for r in conf)
    assert float(report["total_sec"]) >= float(report["score_sec"]) > 0


def test_position_split_pipeline(spark):
    emb = embeddings_labeled(spark, SF)
    res = classify_pipeline(emb, RunParams(per_class={0: 1, 1: 1}, split="position", use_som=False,
                                           use_bags=False))
    assert res.split.where("part = 'train'").count() == emb.count() * 80 // 100


def test_report_round_trip(spark):
    emb = embeddings_labeled(spark, SF)
    res = classify_pipeline(emb, RunParams(per_class={0: 1, 1: 1}, use_som=False, use_bags=False))
    out = scratch("riskvq-report-")
    metrics = run_report(res, list(range(10)))
    write_run_report(metrics, stage_codebooks(res), out)
    back = spark.read.option("sep", ";").option("header", "true").csv(f"{out}/metrics")
    assert {r.metric for r in back.collect()} == {r.metric for r in metrics.collect()}
    lines = [r.value for r in spark.read.text(f"{out}/codebooks").collect()]
    assert len(lines) == len(res.stages) * 2
    assert all(v.split(";")[-1] in ('"0"', '"1"') and len(v.split(";")) == 3 + 64 + 1 for v in lines)
    assert len(res.stages) == 2
    write_run_report(metrics, stage_codebooks(res), out + "_pq", fmt="parquet")
    assert spark.read.parquet(out + "_pq/codebooks").count() == len(res.stages) * 2


def test_stream_scoring_matches_batch(spark):
    emb = embeddings_labeled(spark, SF)
    cb = Codebook.from_df(S.init_codebook_per_class(emb, {c: 2 for c in range(10)}, 1))
    src = table(spark, SF, "embeddings")
    stream = read_labeled_stream(spark, f"{SF}/embeddings.parquet", src.schema, "vec_id", "label", "embedding")
    out, ck = scratch("riskvq-sink-"), scratch("riskvq-ck-")
    q = start_scoring(stream, cb, out, ck)
    q.awaitTermination(120)
    streamed = {r.id: r.pred for r in spark.read.parquet(out).collect()}
    batch = {r.id: r.pred for r in predict(emb, cb).collect()}
    assert streamed == batch
    q2 = start_confusion(stream, cb, "riskvq_conf", scratch("riskvq-ck2-"))
    q2.awaitTermination(120)
    total = spark.sql("SELECT sum(n) AS n FROM riskvq_conf").collect()[0].n
    assert total == emb.count()


def test_persisted_train_part_is_released(spark):
    emb = embeddings_labeled(spark, SF)
    a = classify_pipeline(emb, RunParams(per_class={0: 1, 1: 1}, bag_size=20, delta=2.0, persist_train=True))
    b = classify_pipeline(emb, RunParams(per_class={0: 1, 1: 1}, bag_size=20, delta=2.0))
    assert (a.codebook().w == b.codebook().w).all() or abs(a.codebook().w - b.codebook().w).max() < 1e-12
    with pytest.raises(ValueError):
        classify_pipeline(emb, RunParams(per_class={0: 1, 1: 1}, target="other", persist_train=True))
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()
