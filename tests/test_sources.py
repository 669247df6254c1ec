"""CSV with rejected lines, reports read back, bounded ranges and wide sums."""

import numpy as np
from pyspark.sql import functions as F

from riskvq.operators.aggregates import partial_sums
from riskvq.operators.ranking import with_position
from riskvq.sources.labeled import good_and_rejected, parse_labeled_csv, read_labeled_csv, reason_counts

SF = "/root/testdata/sf0.001"

LINES = ["﻿1,1,0.5,2", " 2 , 2 ,-1e3, 4 ", "3,1,0.5", "4,1,0.5,2,9", "x5,1,0.5,2", "6,one,0.5,2", "7,1,abc,2", "8,1,,2",
         "9,,1,2", "", "10,2.0,NaN,1", "11,99999999999,1,2", "12,1,1,2 ", ",1,2,3", "13,1,0x1,2", '"14",1,"3.5",2']


def test_lines_by_reason(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_bytes("\r\n".join(LINES).encode())
    parsed = parse_labeled_csv(spark, str(path), 2)
    got = {r.record or r.id: r.reason for r in parsed.collect()}
    assert got == {1: None, 2: None, 12: None, 14: None, 10: None, "3,1,0.5": "columns", "4,1,0.5,2,9": "columns", "x5,1,0.5,2": "id",
                   "6,one,0.5,2": "label", "7,1,abc,2": "feature", "8,1,,2": "feature", "9,,1,2": "label",
                   "11,99999999999,1,2": "label", ",1,2,3": "id", "13,1,0x1,2": "feature"}
    assert {r.reason: r.n for r in reason_counts(parsed).collect()} == {"good": 5, "columns": 2, "id": 2, "label": 3, "feature": 3}
    good, rejected = good_and_rejected(parsed)
    assert rejected.count() == 10 and good.columns == ["id", "label", "features"]
    plain = {r.id: (r.label, str(r.features)) for r in read_labeled_csv(spark, str(path), 2).collect()}
    assert all(plain[r.id] == (r.label, str(r.features)) for r in good.collect())
    empty = tmp_path / "empty.csv"
    empty.write_text("")
    assert parse_labeled_csv(spark, str(empty), 2).count() == reason_counts(parse_labeled_csv(spark, str(empty), 2)).count() == 0


def test_ranges_do_not_grow_with_the_shuffle_partitions(spark):
    df = spark.range(0, 5000).select((F.col("id") * 37 % 5000).alias("v"), F.col("id"))
    sizes = []
    for partitions in (8, 20_000):
        before = spark.conf.get("spark.sql.shuffle.partitions")
        spark.conf.set("spark.sql.shuffle.partitions", partitions)
        try:
            out = with_position(df, ["v", "id"])
            sizes.append(len(out._jdf.queryExecution().optimizedPlan().toString()))
        finally:
            spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sizes[1] < 1.1 * sizes[0]
    rows = sorted((r.pos, r.v) for r in with_position(df, ["v", "id"], num_partitions=7).collect())
    assert rows == [(i + 1, i) for i in range(5000)]


def test_wide_sums_come_as_arrays(spark):
    rng = np.random.default_rng(1)
    v = rng.normal(size=(40, 300))
    rows = [(i % 9, 1, 0.5, v[i].tolist()) for i in range(40)]
    partials = spark.createDataFrame(rows, "code_id bigint, n bigint, s double, v array<double>").repartition(4)
    got = partial_sums(partials, 300, 9)
    for c in range(9):
        at = np.arange(40) % 9 == c
        assert got[c][:2] == (at.sum(), at.sum() / 2)
        np.testing.assert_allclose(got[c][2], v[at].sum(axis=0), rtol=1e-12)
