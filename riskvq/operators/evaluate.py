"""Evaluation (E1-E7).

All are aggregations with map-side partial aggregation; the cost matrix is a
classes x classes table joined by broadcast (its size is checked).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from riskvq.functions.vectors import vec_dist
from riskvq.operators.aggregates import UNROLL_MAX_DIMS
from riskvq.operators.codebook import local_frame

MAX_COST_CELLS = 1_000_000


def cost_table(spark: SparkSession, classes: list[int], matrix=None) -> DataFrame:
    """Cost matrix as ``(actual, predicted, cost)``.

    ``matrix`` is a nested list indexed in ``classes`` order (rows actual,
    columns predicted), or a callable ``f(actual, predicted)``; the default
    is the 0/1 matrix ``[0 1; 1 0]`` generalised.
    """
    if len(classes) ** 2 > MAX_COST_CELLS:
        raise ValueError("cost matrix too large to broadcast")
    rows = []
    for i, a in enumerate(classes):
        for j, p in enumerate(classes):
            if matrix is None:
                c = 0.0 if a == p else 1.0
            elif callable(matrix):
                c = float(matrix(a, p))
            else:
                c = float(matrix[i][j])
            rows.append((int(a), int(p), c))
    return local_frame(spark, rows, [("actual", "int"), ("predicted", "int"), ("cost", "double")])


def confusion(pred: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Long confusion matrix ``(actual, predicted, n)`` (E1)."""
    return (pred.groupBy(F.col(label_col).alias("actual"), F.col(pred_col).alias("predicted"))
            .agg(F.count(F.lit(1)).alias("n")))


def confusion_matrix(pred: DataFrame, classes: list[int], label_col: str = "label",
                     pred_col: str = "pred") -> DataFrame:
    """Pivoted confusion matrix: rows actual, one column per class of
    ``classes`` and ``other`` for predictions outside it (NULL included), so a
    row sums to its number of rows.  One aggregate, no pivot pass."""
    p = F.col(pred_col)
    known = F.coalesce(p.isin([int(c) for c in classes]), F.lit(False)) if classes else F.lit(False)
    return pred.groupBy(F.col(label_col).alias("actual")).agg(
        *[F.count_if(p == F.lit(int(c))).alias(str(c)) for c in classes], F.count_if(~known).alias("other"))


def accuracy(pred: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Trace over total (E2)."""
    hit = F.when(F.col(label_col) == F.col(pred_col), F.lit(1.0)).otherwise(F.lit(0.0))
    return pred.agg(F.avg(hit).alias("accuracy"))


def mean_cost(pred: DataFrame, cost: DataFrame, label_col: str = "label", pred_col: str = "pred") -> DataFrame:
    """Average misclassification cost and the rows it leaves out (E3): ``(mean_cost, n_unlisted)``.

    Rows whose (actual, predicted) pair the cost table does not list, NULLs
    included, have no cost: they are counted in ``n_unlisted`` and are not part
    of the average.  With 0/1 costs and every pair listed the average is
    1 - accuracy."""
    j = pred.join(F.broadcast(cost), (F.col(label_col) == F.col("actual")) & (F.col(pred_col) == F.col("predicted")),
                  "left")
    return j.agg(F.avg("cost").alias("mean_cost"), F.count_if(F.col("cost").isNull()).alias("n_unlisted"))


def codebook_trace(stages: list[tuple[str, DataFrame]]) -> DataFrame:
    """Stage-tagged codebooks ``(stage_idx, stage, code_id, code_label, w)`` (E5)."""
    out = None
    for i, (name, cb) in enumerate(stages):
        tagged = cb.select(F.lit(i).alias("stage_idx"), F.lit(name).alias("stage"), "code_id", "code_label", "w")
        out = tagged if out is None else out.unionByName(tagged)
    return out


def codebook_shift(trace: DataFrame) -> DataFrame:
    """Distance each code moved since the previous stage (E6); NULL at the first."""
    w = Window.partitionBy("code_id").orderBy("stage_idx")
    prev = F.lag("w").over(w)
    return trace.select("stage_idx", "stage", "code_id", "code_label", vec_dist(F.col("w"), prev).alias("shift"))


def class_profile(df: DataFrame, dims: int, label_col: str = "label") -> DataFrame:
    """Rows per class and per-feature mean, population std, min and max (E7).

    Long form ``(label, dim, n, mean, std, min, max)``: one row for every class
    (NULL is one) and every dimension below ``dims``; ``n`` counts the rows of
    the class, the others are NULL where no row has a value.  One hash aggregate
    with ``4 x dims`` partial aggregates (by (class, dimension) above
    ``UNROLL_MAX_DIMS``), so a hot class costs nothing extra.
    """
    label = F.col(label_col).alias("label")
    if dims > UNROLL_MAX_DIMS:
        per = (df.select(F.col(label_col).alias("_l"), F.posexplode("features").alias("_d", "x"))
               .where(F.col("_d") < F.lit(dims)).groupBy("_l", "_d")
               .agg(F.avg("x").alias("mean"), F.stddev_pop("x").alias("std"), F.min("x").alias("min"),
                    F.max("x").alias("max")))
        grid = (df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
                .select("label", "n", F.explode(F.sequence(F.lit(0), F.lit(dims - 1))).alias("dim")))
        return (grid.join(per, grid["label"].eqNullSafe(per["_l"]) & (grid["dim"] == per["_d"]), "left")
                .select("label", "dim", "n", "mean", "std", "min", "max"))
    x = F.col("features")
    aggs = [F.count(F.lit(1)).alias("n")]
    for d in range(dims):
        xd = F.get(x, d)
        aggs += [F.avg(xd).alias(f"mean{d}"), F.stddev_pop(xd).alias(f"std{d}"),
                 F.min(xd).alias(f"min{d}"), F.max(xd).alias(f"max{d}")]
    wide = df.groupBy(label).agg(*aggs)
    per_dim = F.explode(F.array(*[
        F.struct(F.lit(d).alias("dim"), F.col(f"mean{d}").alias("mean"), F.col(f"std{d}").alias("std"),
                 F.col(f"min{d}").alias("min"), F.col(f"max{d}").alias("max")) for d in range(dims)]))
    return wide.select("label", "n", per_dim.alias("s")).select("label", "s.dim", "n", "s.mean", "s.std",
                                                                 "s.min", "s.max")
