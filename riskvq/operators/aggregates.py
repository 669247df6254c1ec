"""Vector aggregates: element-wise mean per group (V8) and per-code sums.

When the width ``dims`` is known and not too large the aggregate is unrolled
into ``dims`` scalar sums (one codegen'd hash aggregate with map-side partial
aggregation); otherwise the vectors are exploded by position first.  Both forms
give the same rows: every group appears, ``n`` counts its rows, and a mean is
NULL where no row of the group has a value.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


# Up to this width per-group vector sums are one aggregate with a column per
# dimension; wider vectors are aggregated by (key, dimension).
UNROLL_MAX_DIMS = 256


def vec_avg(df: DataFrame, group_col: str, features: str = "features", dims: int | None = None) -> DataFrame:
    """Element-wise mean per group: ``(group, avg array<double>, n)``.

    Without ``dims`` a group's width is that of its longest vector."""
    x = F.col(features)
    if dims is not None and dims <= UNROLL_MAX_DIMS:
        agg = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"),
                                        *[F.avg(F.get(x, d)).alias(f"_m{d}") for d in range(dims)])
        return agg.select(group_col, F.array(*[F.col(f"_m{d}") for d in range(dims)]).alias("avg"), "n")
    per_dim = df.select(F.col(group_col).alias("_g"), F.posexplode(features).alias("dim", "x"))
    if dims is not None:
        per_dim = per_dim.where(F.col("dim") < dims)
    means = (per_dim.groupBy("_g", "dim").agg(F.avg("x").alias("m")).groupBy("_g")
             .agg(F.map_from_entries(F.collect_list(F.struct("dim", "m"))).alias("_s"), F.max("dim").alias("_w")))
    groups = df.groupBy(group_col).agg(F.count(F.lit(1)).alias("n"))
    width = F.lit(dims) if dims is not None else F.coalesce(F.col("_w") + 1, F.lit(0))
    index = F.when(width > 0, F.sequence(F.lit(0), width - 1)).otherwise(F.array().cast("array<int>"))
    return (groups.join(means, groups[group_col].eqNullSafe(means["_g"]), "left")
            .select(group_col, F.transform(index, lambda d: F.try_element_at(F.col("_s"), d)).alias("avg"), "n"))


def vec_avg_long(df: DataFrame, group_col: str, features: str = "features", dims: int | None = None) -> DataFrame:
    """Element-wise mean per group in long form ``(group, dim, avg)``; one row per dimension of ``vec_avg``."""
    return vec_avg(df, group_col, features, dims).select(group_col, F.posexplode("avg").alias("dim", "avg"))


def partial_sums(partials: DataFrame, dims: int, max_keys: int,
                 whole: bool = False) -> dict[int, tuple[int, float, np.ndarray]]:
    """Totals of the kernels' partial rows ``(code_id, n, s, v)`` per code, collected to the driver.

    At most ``max_keys`` codes of ``dims`` sums come back, bounded by the
    codebook size check.  ``whole`` says that one task made all rows, which are
    then totals already.
    """
    if whole:
        return {int(r["code_id"]): (int(r["n"]), float(r["s"]), np.array(r["v"], np.float64))
                for r in partials.take(max_keys + 1)}
    base = [F.sum("n").alias("n"), F.sum("s").alias("s")]
    if dims <= UNROLL_MAX_DIMS:
        rows = partials.groupBy("code_id").agg(
            *base, *[F.sum(F.get("v", F.lit(d))).alias(f"_v{d}") for d in range(dims)]).take(max_keys + 1)
        return {int(r["code_id"]): (int(r["n"]), float(r["s"]), np.array([r[f"_v{d}"] for d in range(dims)], np.float64))
                for r in rows}
    out = {int(r["code_id"]): (int(r["n"]), float(r["s"]), np.zeros(dims))
           for r in partials.groupBy("code_id").agg(*base).take(max_keys + 1)}
    per_dim = partials.select("code_id", F.posexplode("v").alias("d", "x")).groupBy("code_id", "d").agg(F.sum("x").alias("x"))
    # one row a code, as Arrow arrays: K x D doubles without a Python object each
    per_code = per_dim.groupBy("code_id").agg(F.array_sort(F.collect_list(F.struct("d", "x"))).alias("e")).select(
        "code_id", F.transform("e", lambda e: e.x).alias("v"))
    for batch in per_code.toArrow().to_batches():
        for i, code in enumerate(batch.column(0).to_pylist()):
            out[code][2][:] = batch.column(1)[i].values.to_numpy()
    return out


def weighted_sums(df: DataFrame, key_col: str, dims: int, weight: Column | None = None,
                  vec: Column | None = None, max_keys: int = 100_000) -> dict[int, tuple[float, float, np.ndarray]]:
    """Per key: ``(count, sum(weight), sum(weight * vec))`` collected to the driver.

    At most ``max_keys`` keys (code ids) come back, each with ``dims`` sums:
    bounded by the codebook size check.  Both forms aggregate map-side
    first, so a hot code sends one partial row (or ``dims``) per task.
    """
    v = vec if vec is not None else F.col("features")
    wt = weight if weight is not None else F.lit(1.0)
    base = [F.count(F.lit(1)).alias("_n"), F.sum(wt).alias("_s")]
    if dims <= UNROLL_MAX_DIMS:
        aggs = base + [F.sum(wt * F.get(v, d)).alias(f"_v{d}") for d in range(dims)]
        rows = df.groupBy(key_col).agg(*aggs).take(max_keys + 2)
        per_dim = None
    else:
        # position 0 is a constant 1.0: its count and weighted sum are the
        # row count and the weight sum, so one aggregate serves all
        staged = df.select(F.col(key_col).alias("_k"), wt.alias("_w"),
                           F.concat(F.array(F.lit(1.0)), v.cast("array<double>")).alias("_x"))
        exploded = staged.select("_k", "_w", F.posexplode("_x").alias("_d", "_e"))
        sums = exploded.groupBy("_k", "_d").agg(F.count(F.lit(1)).alias("_n"),
                                                F.sum(F.col("_w") * F.col("_e")).alias("_v"))
        per_dim, rows = {}, []
        for r in sums.collect():
            if r["_k"] is None:
                continue
            if r["_d"] == 0:
                rows.append({key_col: r["_k"], "_n": r["_n"], "_s": r["_v"]})
            elif r["_d"] <= dims:
                per_dim.setdefault(int(r["_k"]), np.zeros(dims))[r["_d"] - 1] = r["_v"] or 0.0
    if sum(r[key_col] is not None for r in rows) > max_keys:
        raise ValueError("more groups than codes")
    out = {}
    for r in rows:
        if r[key_col] is None:
            continue
        key = int(r[key_col])
        if per_dim is None:
            vec_sum = np.array([r[f"_v{d}"] if r[f"_v{d}"] is not None else 0.0 for d in range(dims)],
                               dtype=np.float64)
        else:
            vec_sum = per_dim.get(key, np.zeros(dims))
        out[key] = (int(r["_n"]), float(r["_s"] or 0.0), vec_sum)
    return out
