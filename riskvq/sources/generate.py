"""Seeded uniform features (IO5) and integers (IO6).

Values come from the row key, not from a per-task random stream, so they
are the same however the table is partitioned and on every retry.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskvq.functions.keys import key_uniform, seeded_key


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def uniform_double(id_col, seed, lo: float = 0.0, hi: float = 1.0, *salts) -> Column:
    """Uniform double in ``[lo, hi)``."""
    return F.lit(float(lo)) + F.lit(float(hi) - float(lo)) * key_uniform(seeded_key(id_col, seed, *salts))


def uniform_int(id_col, seed, lo: int, hi: int, *salts) -> Column:
    """Uniform integer in ``[lo, hi]``, both ends inclusive (IO6)."""
    u = key_uniform(seeded_key(id_col, seed, *salts))
    return (F.lit(int(lo)) + F.floor(u * F.lit(float(int(hi) - int(lo) + 1)))).cast("long")


def uniform_features(df: DataFrame, dims: int, seed, lo: float = 0.0, hi: float = 1.0,
                     id_col: str = "id") -> DataFrame:
    """``(id, label=0, features)`` with ``dims`` uniform features per row of
    ``df``; feature ``d`` of row ``id`` is keyed on ``seed:d:id``."""
    feats = F.array(*[uniform_double(id_col, seed, lo, hi, d) for d in range(dims)])
    return df.select(_c(id_col).alias("id"), F.lit(0).cast("int").alias("label"), feats.alias("features"))


def uniform_table(spark: SparkSession, rows: int, dims: int, seed, lo: float = 0.0,
                  hi: float = 1.0) -> tuple[DataFrame, DataFrame]:
    """``rows`` x ``dims`` uniform table with label 0, plus one probe point
    (IO5).  Rows are ids ``0..rows-1``; the probe is keyed on id ``-1``."""
    table = uniform_features(spark.range(rows), dims, seed, lo, hi)
    probe = uniform_features(spark.range(-1, 0), dims, seed, lo, hi)
    return table, probe
