"""Row numbers of Parquet tables and draws keyed on them, under any cut into tasks."""

import pytest
from pyspark.sql import functions as F

from riskvq.operators import sampling as S
from riskvq.sources import row_index as R

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def files(spark, tmp_path_factory):
    """A table of many files and row groups, one of them with a third of the rows, one empty."""
    path = str(tmp_path_factory.mktemp("rows") / "t")
    df = spark.range(0, 9000).select((F.col("id") * 7 % 1000).alias("v"), F.lit("x").alias("row"))
    df.where("v < 333").coalesce(1).write.option("parquet.block.size", 4096).parquet(path)
    df.where("v >= 333").repartition(7).write.mode("append").parquet(path)
    df.limit(0).coalesce(1).write.mode("append").parquet(path)
    return path


def numbered(spark, path):
    return R.with_row_index(spark.read.parquet(path))


def test_numbers_are_dense_and_follow_the_files(spark, files):
    rows = numbered(spark, files).withColumn("f", F.input_file_name()).collect()
    assert sorted(r.row_index for r in rows) == list(range(9000))
    import pyarrow.parquet as pq
    from pathlib import Path

    want = [v for p in sorted(Path(files).glob("part-*"), key=str) for v in pq.read_table(p)["v"].to_pylist()]
    assert [r.v for r in sorted(rows, key=lambda r: r.row_index)] == want


def test_draws_do_not_depend_on_partitioning(spark, files, monkeypatch):
    seen = set()
    for size, limit in ((134217728, 50_000), (2000, 50_000), (2000, 0)):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        monkeypatch.setattr(R, "BROADCAST_FILES", limit)
        try:
            df = numbered(spark, files)
            tasks = df.rdd.getNumPartitions()
            drawn = S.bernoulli_sample(df, 0.05, 3, id_col="row_index")
            split = S.split_random(df, 80, 3, id_col="row_index")
            seen.add((tuple(sorted(map(tuple, drawn.select("row_index", "v").collect()))),
                      tuple(sorted(map(tuple, split.select("row_index", "v", "part").collect())))))
            assert tasks > 1
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(seen) == 1


def test_one_file_needs_no_join(spark):
    df = R.with_row_index(spark.read.parquet(f"{SF}/lineitem.parquet"))
    assert "Join" not in df._jdf.queryExecution().executedPlan().toString()
    n = df.count()
    assert df.agg(F.max("row_index")).collect()[0][0] == n - 1
    with pytest.raises(ValueError):
        R.with_row_index(df)
