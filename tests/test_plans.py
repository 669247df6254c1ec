"""Physical-plan shape: where the shuffles are, what the scans read, and how
a hot class is handled."""

import numpy as np
from pyspark.sql import functions as F

from riskvq.functions.keys import draw_key, key_below
from riskvq.operators import evaluate as E
from riskvq.operators import sampling as S
from riskvq.operators.codebook import Codebook
from riskvq.operators.nearest import assign_nearest, predict
from riskvq.operators.ranking import sort_by_first, sort_by_label, with_position
from riskvq.sources.labeled import events_labeled, lineitem_labeled

SF = "/root/testdata/sf0.001"


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def exchanges(df) -> int:
    return plan(df).count("Exchange ") - plan(df).count("BroadcastExchange ")


def test_scoring_is_map_only(spark):
    li = lineitem_labeled(spark, SF)
    cb = Codebook(np.arange(1, 4), np.array([0, 1, 2]), np.ones((3, 4)))
    for m in ("arrow", "unrolled", "expr"):
        assert exchanges(assign_nearest(li, cb, method=m)) == 0


def test_scoring_reads_only_needed_columns(spark):
    li = lineitem_labeled(spark, SF)
    cb = Codebook(np.arange(1, 4), np.array([0, 1, 2]), np.ones((3, 4)))
    p = plan(E.confusion(predict(li, cb)))
    assert "l_shipdate" not in p and "l_linestatus" not in p


def test_confusion_shuffles_partial_aggregates_only(spark):
    li = lineitem_labeled(spark, SF)
    cb = Codebook(np.arange(1, 4), np.array([0, 1, 2]), np.ones((3, 4)))
    conf = E.confusion(predict(S.train_test(S.split_random(li, 80, 1))[1], cb))
    p = plan(conf)
    assert exchanges(conf) == 1 and "partial_count" in p


def test_keyed_split_and_sample_do_not_shuffle(spark):
    ev = events_labeled(spark, SF)
    assert exchanges(S.split_random(ev, 80, 3)) == 0
    assert exchanges(S.bernoulli_sample(ev, 0.1, 3)) == 0
    assert exchanges(S.split_by_position(ev, 80)) == 0


def test_per_class_draw_groups_limit_before_shuffle(spark):
    ev = events_labeled(spark, SF)
    p = plan(S.init_codebook_per_class(ev, {0: 3, 1: 5}, 2))
    assert "WindowGroupLimit" in p


def test_hot_class_ranks_only_candidates(spark):
    # one class holds half of the rows
    ev = events_labeled(spark, "/root/testdata/sf0.01")
    hot = ev.withColumn("label", F.when(F.col("id") % 2 == 0, F.lit(0)).otherwise(F.col("label")))
    cb = S.init_codebook_per_class(hot, {0: 4, 1: 4}, 6)
    assert "InMemoryTableScan" not in plan(cb)  # ranked straight from the filtered scan
    cand = hot.where("label = 0").count()
    got = {r.code_id for r in cb.collect()}
    assert got == set(range(1, 9)) and cand > 4000
    # the candidates the window sees for the hot class stay near the quota
    frac = (4 + 8 * 2 + 16) / cand
    kept = hot.where("label = 0").where(key_below(draw_key("id", 6, "init"), frac)).count()
    assert kept < 100


def test_no_operator_keeps_a_copy_of_the_table(spark):
    ev = events_labeled(spark, SF)
    for df in (S.shuffle_rows(ev, 3), sort_by_first(ev.withColumn("x", F.col("features")[0]), "x"), sort_by_label(ev),
               S.limit_n(ev, 5, 1), S.draw_bags(ev, 2, 10, 1), S.init_codebook_sampled(ev, 5, 1),
               S.split_by_position(ev, 30, order_by=["label"])):
        assert "InMemoryTableScan" not in plan(df)
    assert spark.sparkContext._jsc.getPersistentRDDs().isEmpty()


def test_position_counts_read_the_key_alone(spark):
    li = lineitem_labeled(spark, SF)
    df = with_position(li, ["label", "id"])
    assert exchanges(df) == 1


def test_predict_returns_only_what_is_asked_for(spark):
    li = lineitem_labeled(spark, SF)
    cb = Codebook(np.arange(1, 4), np.array([0, 1, 2]), np.ones((3, 4)))
    assert predict(li, cb).columns == ["id", "label", "pred"]
    only = predict(li, cb, keep=["label"])
    assert only.columns == ["label", "pred"] and "l_orderkey" not in plan(only)
