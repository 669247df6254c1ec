"""Golden checks against the one recorded run (codebooks before and after a
BVQ bag, the recorded confusion matrix).  The sample row is not part of the
record; it is solved from the two codebooks as described in FIXTURES.md F3.
"""

import os

import numpy as np
import pytest

from riskvq.operators.bvq import bvq_step, bvq_window, cost_from_matrix
from riskvq.operators.codebook import Codebook
from riskvq.operators.evaluate import confusion_matrix
from riskvq.operators.nearest import predict
from riskvq.sources.labeled import LABELED_SCHEMA, read_labeled_csv

# The recorded codebook before the BVQ bag (w1, w2, label), in file order.
BEFORE_BVQ = [
    (0.3706335645936627, 2.0316682716609527, 1),
    (1.2758813010016734, 0.4929050473307031, 1),
    (0.024807814875361853, 0.37815593653869023, 1),
    (-1.977958120305596, 0.8087264634510726, 1),
    (0.14419492032202866, -0.771726278437228, 1),
    (-0.17880116373783203, -0.14945332749733115, 2),
    (-0.4101334493914892, 0.6473810944255299, 2),
    (-0.20359307279958816, 0.25130794907724574, 2),
    (0.1809705928783249, -0.2576829125070399, 2),
    (0.1848048147604944, 0.1160626969290676, 2),
]
# The recorded codebook after the BVQ bag.
AFTER_BVQ = [
    (0.3706335645936627, 2.0316682716609527, 1),
    (1.2758813010016734, 0.4929050473307031, 1),
    (0.01872147208985219, 0.3750191637533908, 1),
    (-1.977958120305596, 0.8087264634510726, 1),
    (0.14419492032202866, -0.771726278437228, 1),
    (-0.17880116373783203, -0.14945332749733115, 2),
    (-0.4101334493914892, 0.6473810944255299, 2),
    (-0.20359307279958816, 0.25130794907724574, 2),
    (0.1809705928783249, -0.2576829125070399, 2),
    (0.18568071475976122, 0.12773476619259733, 2),
]
# Recorded test confusion matrix (rows actual 1, 2) and accuracy.
RECORDED_CONFUSION = [[542, 392], [281, 679]]
RECORDED_ACCURACY = 0.6446673706441394


def _cb(rows):
    return Codebook(np.arange(1, len(rows) + 1), np.array([r[2] for r in rows]),
                    np.array([[r[0], r[1]] for r in rows]))


def _solved_row():
    before, after = _cb(BEFORE_BVQ).w, _cb(AFTER_BVQ).w
    m3, m10 = before[2], before[9]
    k = 0.01 / np.linalg.norm(m3 - m10)
    return m3 - (after[2] - m3) / k


def test_solved_row_consistent():
    before, after = _cb(BEFORE_BVQ).w, _cb(AFTER_BVQ).w
    m10 = before[9]
    k = 0.01 / np.linalg.norm(before[2] - m10)
    t2 = m10 + (after[9] - m10) / k
    assert np.allclose(_solved_row(), t2, atol=1e-12)


def test_golden_bvq_step(spark):
    t = _solved_row()
    bag = spark.createDataFrame([(1, 2, [float(t[0]), float(t[1])])], LABELED_SCHEMA)
    cost = cost_from_matrix([1, 2], [[0, 1], [1, 0]])
    new = bvq_step(bag, _cb(BEFORE_BVQ), rate=0.01, window_half_width=0.15, cost=cost, target="sample")
    assert np.allclose(new.w, _cb(AFTER_BVQ).w, rtol=0, atol=1e-14)
    assert list(new.code_label) == [r[2] for r in AFTER_BVQ]


def test_golden_row_is_in_window(spark):
    t = _solved_row()
    bag = spark.createDataFrame([(1, 2, [float(t[0]), float(t[1])])], LABELED_SCHEMA)
    win = bvq_window(bag, _cb(BEFORE_BVQ), window_half_width=0.15).collect()
    assert len(win) == 1
    assert {win[0]["code_i"], win[0]["code_j"]} == {3, 10}
    assert win[0]["gap"] == pytest.approx(0.1384, abs=1e-4)
    # the recorded delta 0.2 (half width 0.1) would leave the row outside
    assert bvq_window(bag, _cb(BEFORE_BVQ), delta=0.2).count() == 0


def test_default_cost_equals_01_matrix(spark):
    t = _solved_row()
    bag = spark.createDataFrame([(1, 2, [float(t[0]), float(t[1])])], LABELED_SCHEMA)
    a = bvq_step(bag, _cb(BEFORE_BVQ), rate=0.01, window_half_width=0.15)
    assert np.allclose(a.w, _cb(AFTER_BVQ).w, rtol=0, atol=1e-14)


def test_recorded_accuracy():
    c = RECORDED_CONFUSION
    assert (c[0][0] + c[1][1]) / sum(map(sum, c)) == pytest.approx(RECORDED_ACCURACY, abs=1e-15)


# Confusion matrices of the 201 sample rows (actual 1, 2 by predicted 1, 2) under the recorded codebooks.
SAMPLE_CONFUSION = {"before": [[58, 42], [29, 72]], "after": [[57, 43], [29, 72]]}


@pytest.mark.skipif("RISKVQ_SAMPLE_CSV" not in os.environ, reason="RISKVQ_SAMPLE_CSV names the 201 sample rows (id,label,f1,f2)")
@pytest.mark.parametrize("stage", ["before", "after"])
def test_scoring_of_the_sample_rows(spark, stage):
    rows = read_labeled_csv(spark, os.environ["RISKVQ_SAMPLE_CSV"], 2)
    pred = predict(rows, _cb(BEFORE_BVQ if stage == "before" else AFTER_BVQ))
    got = {r.actual: [r["1"], r["2"]] for r in confusion_matrix(pred, [1, 2]).collect()}
    assert [got[1], got[2]] == SAMPLE_CONFUSION[stage]
