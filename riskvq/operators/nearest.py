"""Nearest code vectors (M1, T3).

Three interchangeable physical paths, all map-only (no shuffle of the data):

``unrolled``  The codebook is folded into the plan as literals and each
              distance is plain arithmetic on scalar feature columns inside
              whole-stage codegen.  JVM-only; for small codebooks (K x D up
              to some 64 terms) -- beyond that the generated method outgrows
              what the JIT compiles.
``expr``      The codebook is one constant column
              ``array<struct<code_id, code_label, w>>`` (folded into a single
              literal) and distances are higher-order functions (interpreted).
              Its arithmetic mirrors SQL list lambdas term for term.
``arrow``     ``mapInArrow``: numpy distances on zero-copy Arrow batches;
              fastest for wide vectors and large codebooks.
``tree``      The Arrow kernel with a metric tree over the codes
              (``code_tree``): exact, far fewer distances where codes cluster
              or have few dimensions.

``auto`` is ``arrow``, from ``TREE_MIN_CODES`` codes with a tree as long as it
spares distances.  The Arrow path is about as fast as the unrolled plan on small
codebooks, far faster on wide ones, and an optimizer barrier, so downstream
filters never get pushed into (and multiply) a generated distance expression.
Every path returns the same columns; ties go to the lower ``code_id``
(codes are sorted by id and compared as ``(d2, code_id)``).  A code whose
distance is not finite does not count, so a row with a NULL, NaN or infinite
feature, or of another width, has no nearest code (NULLs) on any path.

A codebook given as a DataFrame may be larger than one task should hold; it is
then searched part by part (``large_codebook``).
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskvq.functions.vectors import vec_sqdist
from riskvq.operators.code_tree import tree_finder
from riskvq.operators.codebook import Codebook, as_codebook, codebook_literal
from riskvq.operators.large_codebook import CodeParts, nearest_in_parts

# From this many distance terms per row (K x D) the Arrow kernel ranks with a
# BLAS product plus exact re-ranking of a few candidates.
GEMM_MIN_TERMS = 4_096
# From this many codes a tree is tried first.
TREE_MIN_CODES = 1_000

_OUT1 = ["code_id", "code_label", "d2"]
_OUT2 = ["code_i", "label_i", "d2_i", "code_j", "label_j", "d2_j"]


def choose_method(cb: Codebook, method: str = "auto", k: int = 1) -> str:
    if method not in ("auto", "arrow", "tree", "unrolled", "expr"):
        raise ValueError(f"unknown method {method!r}")
    return method


ARROW_METHODS = ("auto", "arrow", "tree")


def _in_parts(codebook, method: str) -> CodeParts | None:
    """The codebook in parts if it is one, or a DataFrame too large for one task."""
    if isinstance(codebook, CodeParts):
        return codebook
    if isinstance(codebook, Codebook) or method not in ARROW_METHODS:
        return None
    parts = CodeParts.of(codebook)
    return parts if parts.too_large() else None


# ---------------------------------------------------------------------------
# per-code distance structs (unrolled / expr)
# ---------------------------------------------------------------------------

def _unrolled_nearest(df: DataFrame, cb: Codebook, k: int, within_class: bool, features: str) -> DataFrame:
    """Nearest (k=1) or two nearest (k=2) codes as generated arithmetic.

    The features become non-null scalar columns once; each code's squared
    distance is a plain sum over dimensions in order (bit-identical to the
    fold of the ``expr`` path and to SQL); the pick is ``array_min`` /
    ``sort_array`` over small ``(miss, d2, idx)`` structs, so ties go to the
    lower ``code_id`` and a pushed-down filter copies the expression at most
    linearly.  ``miss`` marks codes of another class (class-wise search).
    """
    dims = cb.dims
    x = F.col(features)
    nan = F.lit(float("nan"))
    ok = F.size(x) == F.lit(dims)
    for d in range(dims):
        ok = ok & F.get(x, d).isNotNull()
    scal = df.select(*df.columns, *[F.coalesce(F.get(x, d), nan).alias(f"_x{d}") for d in range(dims)],
                     F.coalesce(ok, F.lit(False)).alias("_ok"))
    elems = []
    for c in range(cb.k):
        acc = None
        for d in range(dims):
            diff = F.col(f"_x{d}") - F.lit(float(cb.w[c, d]))
            acc = diff * diff if acc is None else acc + diff * diff
        miss = F.lit(False) if not within_class else (F.col("label") != F.lit(int(cb.code_label[c])))
        elems.append(F.struct(miss.alias("miss"), acc.alias("d2"), F.lit(c).alias("idx")))
    arr = F.array(*elems)
    pick = F.array_min(arr) if k == 1 else F.slice(F.sort_array(arr), 1, 2)
    staged = scal.select(*df.columns, F.when(F.col("_ok"), pick).alias("_p"))
    ids = F.array(*[F.lit(int(v)) for v in cb.code_id])
    labels = F.array(*[F.lit(int(v)) for v in cb.code_label])

    def fields(s: Column) -> list[Column]:
        return [_field(s, "idx", lambda i: F.element_at(ids, i + 1)),
                _field(s, "idx", lambda i: F.element_at(labels, i + 1)), _field(s, "d2")]

    if k == 1:
        return staged.select(*df.columns, *[c.alias(n) for c, n in zip(fields(F.col("_p")), _OUT1)])
    picked = fields(F.get(F.col("_p"), 0)) + fields(F.get(F.col("_p"), 1))
    return staged.select(*df.columns, *[c.alias(n) for c, n in zip(picked, _OUT2)])


def _expr_structs(x: Column, cb_col: Column, same_label: Column | None) -> Column:
    structs = F.transform(cb_col, lambda c: F.struct(
        (F.lit(False) if same_label is None else c.code_label != same_label).alias("miss"),
        vec_sqdist(x, c.w).alias("d2"), c.code_id.alias("code_id"), c.code_label.alias("code_label")))
    return F.filter(structs, lambda e: e.d2.isNotNull() & (e.d2 < F.lit(float("inf"))))


def _structs_frame(df: DataFrame, cb: Codebook, method: str, within_class: bool, features: str,
                   pick) -> DataFrame:
    """``df`` plus ``_p`` = ``pick(array of distance structs)`` (``expr`` path)."""
    x = F.col(features)
    same = F.col("label") if within_class else None
    return df.select(*df.columns, pick(_expr_structs(x, codebook_literal(cb), same)).alias("_p"))


def _field(s: Column, name: str, fn=None) -> Column:
    """Field of a picked distance struct; NULL when no code applied (other
    width, other class, or a NULL feature)."""
    v = s[name] if fn is None else fn(s[name])
    return F.when(s.isNotNull() & ~s.miss & s.d2.isNotNull() & (s.d2 < F.lit(float("inf"))), v)


# ---------------------------------------------------------------------------
# Arrow path
# ---------------------------------------------------------------------------

def make_finder(labels: np.ndarray, w: np.ndarray, k: int, within_class: bool, gemm_min_terms: int,
                method: str = "auto"):
    """``(find, matrix)``: the numpy functions that the Arrow kernels share.

    ``find(x, row_labels)`` gives indices and squared distances of the k nearest
    codes; ``matrix(column)`` an (n x dims) matrix and a validity mask.  They are
    nested here, so they travel to the Python workers by value: executors need
    numpy and pyarrow, not this package.
    """
    dims, ncode = w.shape[1], w.shape[0]
    use_gemm = ncode * dims >= gemm_min_terms and ncode > k
    exact_rows = max(1, 2_000_000 // max(1, ncode * max(dims, 1)))
    gemm_rows = max(1, 2_000_000 // max(1, ncode))
    ww = np.einsum("kd,kd->k", w, w)
    # bound on the rounding error of |x|^2 - 2 x.w + |w|^2 (generous)
    err = 64.0 * max(dims, 1) * np.finfo(np.float64).eps

    def exact_pick(x, lr):
        """k nearest by exact distances to every code, in blocks of rows; first index on ties."""
        n = len(x)
        idx, dist = np.zeros((n, k), np.int64), np.full((n, k), np.inf)
        for s in range(0, n, exact_rows):
            diff = x[s:s + exact_rows, None, :] - w[None, :, :]
            dd = np.einsum("nkd,nkd->nk", diff, diff)
            if lr is not None:
                dd = np.where(labels[None, :] != lr[s:s + exact_rows, None], np.inf, dd)
            rows = np.arange(dd.shape[0])
            for j in range(min(k, ncode)):
                i = np.argmin(dd, axis=1)
                idx[s:s + exact_rows, j], dist[s:s + exact_rows, j] = i, dd[rows, i]
                dd[rows, i] = np.inf
        return idx, dist

    def gemm_pick(x, lr):
        """Large codebooks: BLAS distances pick k + 4 candidates, their exact
        distances rank them, and rows where a non-candidate could tie or win
        (within the rounding bound) are redone exactly."""
        xx = np.einsum("nd,nd->n", x, x)
        approx = xx[:, None] - 2.0 * (x @ w.T) + ww[None, :]
        if lr is not None:
            approx = np.where(labels[None, :] != lr[:, None], np.inf, approx)
        m = min(k + 4, ncode)
        cand = np.argpartition(approx, m - 1, axis=1)[:, :m]
        diff = x[:, None, :] - w[cand]
        ex = np.einsum("nmd,nmd->nm", diff, diff)
        if lr is not None:
            ex = np.where(labels[cand] != lr[:, None], np.inf, ex)
        order = np.lexsort((cand, ex), axis=1)[:, :k]
        idx = np.take_along_axis(cand, order, axis=1)
        dist = np.take_along_axis(ex, order, axis=1)
        edge = np.take_along_axis(approx, cand, axis=1).max(axis=1)
        unsafe = (m < ncode) & ~(edge - err * (xx + ww.max()) > dist[:, -1])
        if unsafe.any():
            idx[unsafe], dist[unsafe] = exact_pick(x[unsafe], None if lr is None else lr[unsafe])
        return idx, dist

    def find(x, lr):
        if not use_gemm:
            return exact_pick(x, lr)
        parts = [gemm_pick(x[s:s + gemm_rows], None if lr is None else lr[s:s + gemm_rows])
                 for s in range(0, len(x), gemm_rows)]
        if not parts:
            return exact_pick(x, lr)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def matrix(col):
        """(n x dims) float64 matrix of an Arrow list column and a validity
        mask (row present, right width, all elements finite); no Python loop."""
        import pyarrow as pa
        import pyarrow.compute as pc

        if isinstance(col, pa.ChunkedArray):
            col = col.combine_chunks()
        lengths = pc.list_value_length(col)
        ok = pc.fill_null(pc.equal(lengths, pa.scalar(dims, lengths.type)), False).to_numpy(zero_copy_only=False)
        whole = col if ok.all() else col.filter(pa.array(ok))
        # a NULL element becomes NaN
        flat = whole.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
        if ok.all():
            x = flat
        else:
            x = np.zeros((len(col), dims))
            x[ok] = flat
        finite = np.isfinite(x).all(axis=1)
        if not finite.all():
            x = np.where(finite[:, None], x, 0.0)
        return x, ok & finite

    if method == "tree" or (method == "auto" and ncode >= TREE_MIN_CODES):
        return tree_finder(labels, w, k, within_class, find if method == "auto" else None), matrix
    return find, matrix


def _nearest_kernel(cb: Codebook, k: int, within_class: bool, keep: list[str], features: str, names: list[str],
                    with_pair_norm: bool, method: str):
    """The per-batch function of the Arrow path: kept columns, then the picks."""
    ids, labels, w = cb.code_id.copy(), cb.code_label.copy(), cb.w.copy()
    find, matrix = make_finder(labels, w, k, within_class, GEMM_MIN_TERMS, method)

    def run(batches):
        import pyarrow as pa

        for rb in batches:
            x, ok = matrix(rb.column(features))
            lr = rb.column("label").cast(pa.float64()).to_numpy(zero_copy_only=False) if within_class else None
            idx, dist = find(x, lr)
            arrays = [rb.column(c) for c in keep]
            for j in range(k):
                bad = ~(ok & np.isfinite(dist[:, j]))
                arrays += [pa.array(ids[idx[:, j]], pa.int64(), mask=bad),
                           pa.array(labels[idx[:, j]].astype(np.int32), pa.int32(), mask=bad),
                           pa.array(dist[:, j], pa.float64(), mask=bad)]
            if with_pair_norm:
                # |w_i - w_j| of the chosen pair, where the classes differ; summed over dimensions in order
                both = ok & np.isfinite(dist[:, 1]) & (labels[idx[:, 0]] != labels[idx[:, 1]])
                n = np.zeros(len(x))
                diff = w[idx[both, 0]] - w[idx[both, 1]]
                if diff.size:
                    n[both] = np.sqrt(np.add.accumulate(diff * diff, axis=1)[:, -1])
                arrays.append(pa.array(n, pa.float64(), mask=~both))
            yield pa.RecordBatch.from_arrays(arrays, names=keep + names)

    return run


def _arrow_nearest(df: DataFrame, cb: Codebook, k: int, within_class: bool, features: str,
                   with_pair_norm: bool = False, keep: list[str] | None = None, method: str = "auto") -> DataFrame:
    """``mapInArrow``: numpy distances per Arrow batch, ties to the lower index.

    Output columns: the columns of ``keep`` (default all of ``df``), then
    ``code_id, code_label, d2`` (k=1), the ``_i``/``_j`` pair (k=2), or
    ``_c<r>, _l<r>, _d<r>`` for ranks ``r = 0..k-1`` (k>2).  Only kept columns
    come back from Python."""
    if k == 1:
        names = list(_OUT1)
    elif k == 2:
        names = list(_OUT2)
    else:
        names = [n for r in range(k) for n in (f"_c{r}", f"_l{r}", f"_d{r}")]
    types = [T.LongType(), T.IntegerType(), T.DoubleType()] * k
    if with_pair_norm:
        names.append("n")
        types.append(T.DoubleType())
    keep = df.columns if keep is None else keep
    needed = list(dict.fromkeys([*keep, features, *(["label"] if within_class else [])]))
    fields = {f.name: f for f in df.schema.fields}
    out_schema = T.StructType([fields[c] for c in keep] + [T.StructField(n, t) for n, t in zip(names, types)])
    kernel = _nearest_kernel(cb, k, within_class, list(keep), features, list(names), with_pair_norm, method)
    return df.select(*needed).mapInArrow(kernel, out_schema)


PARTIAL_SCHEMA = "code_id bigint, n bigint, s double, v array<double>"


# ---------------------------------------------------------------------------
# public operators
# ---------------------------------------------------------------------------

def assign_nearest(df: DataFrame, codebook, within_class: bool = False, method: str = "auto",
                   features: str = "features", keep: list[str] | None = None) -> DataFrame:
    """Add ``code_id, code_label, d2`` of the nearest code vector (M1).

    ``within_class`` restricts the search to codes of the row's own label
    (class-wise SOM passes).  Rows with no valid code get NULLs.  ``keep``
    names the columns of ``df`` to return (default all).
    """
    keep = df.columns if keep is None else keep
    if (parts := _in_parts(codebook, method)) is not None:
        best = F.get("nearest", F.lit(0))
        return nearest_in_parts(df, parts, 1, within_class, features, keep).select(
            *keep, *[best[n].alias(n) for n in _OUT1])
    cb = as_codebook(codebook)
    m = choose_method(cb, method)
    if m in ARROW_METHODS:
        return _arrow_nearest(df, cb, 1, within_class, features, keep=keep, method=m)
    if m == "unrolled":
        return _unrolled_nearest(df, cb, 1, within_class, features).select(*keep, *_OUT1)
    staged = _structs_frame(df, cb, m, within_class, features, F.array_min)
    b = F.col("_p")
    return staged.select(*keep, _field(b, "code_id").alias("code_id"),
                         _field(b, "code_label").alias("code_label"), _field(b, "d2").alias("d2"))


def k_nearest_codes(df: DataFrame, codebook, k: int = 2, method: str = "auto",
                    features: str = "features") -> DataFrame:
    """Add ``nearest``: the ``k`` closest codes as
    ``array<struct<d2, code_id, code_label>>``, ascending ``(d2, code_id)`` (T3)."""
    if (parts := _in_parts(codebook, method)) is not None:
        return nearest_in_parts(df, parts, k, False, features, df.columns)
    cb = as_codebook(codebook)
    m = choose_method(cb, method, k=k)
    if m in ARROW_METHODS:
        flat = _arrow_nearest(df, cb, k, False, features, method=m)
        cols = flat.columns[len(df.columns):]
        ranks = [F.when(F.col(c).isNotNull(), F.struct(F.col(d).alias("d2"), F.col(c).alias("code_id"),
                                                       F.col(lab).alias("code_label")))
                 for c, lab, d in zip(cols[0::3], cols[1::3], cols[2::3])]
        return flat.select(*df.columns, F.array_compact(F.array(*ranks)).alias("nearest"))
    staged = _structs_frame(df, cb, "expr", False, features, lambda a: F.slice(F.sort_array(a), 1, k))
    drop_miss = F.transform(F.col("_p"), lambda e: F.struct(e.d2.alias("d2"), e.code_id.alias("code_id"),
                                                             e.code_label.alias("code_label")))
    return staged.select(*df.columns, F.coalesce(drop_miss, F.array()).alias("nearest"))


def two_nearest(df: DataFrame, codebook, method: str = "auto", features: str = "features") -> DataFrame:
    """T3 with k=2, flattened: ``code_i, label_i, d2_i, code_j, label_j, d2_j``
    (``i`` nearest).  NULLs for a missing second code."""
    if (parts := _in_parts(codebook, method)) is not None:
        i, j = F.get("nearest", F.lit(0)), F.get("nearest", F.lit(1))
        picked = [c[n].alias(out) for c, outs in ((i, _OUT2[:3]), (j, _OUT2[3:])) for n, out in zip(_OUT1, outs)]
        return nearest_in_parts(df, parts, 2, False, features, df.columns).select(*df.columns, *picked)
    cb = as_codebook(codebook)
    m = choose_method(cb, method, k=2)
    if m in ARROW_METHODS:
        return _arrow_nearest(df, cb, 2, False, features, method=m)
    if m == "unrolled":
        return _unrolled_nearest(df, cb, 2, False, features)
    staged = _structs_frame(df, cb, m, False, features, lambda a: F.slice(F.sort_array(a), 1, 2))
    i, j = F.get(F.col("_p"), 0), F.get(F.col("_p"), 1)
    return staged.select(*df.columns,
                         _field(i, "code_id").alias("code_i"), _field(i, "code_label").alias("label_i"),
                         _field(i, "d2").alias("d2_i"), _field(j, "code_id").alias("code_j"),
                         _field(j, "code_label").alias("label_j"), _field(j, "d2").alias("d2_j"))


def predict(df: DataFrame, codebook, method: str = "auto", pred_col: str = "pred",
            features: str = "features", keep: list[str] | None = None) -> DataFrame:
    """Label of the nearest code vector (M7) with the columns of ``keep``
    (default all but the features, so the true ``label`` stays)."""
    keep = [c for c in df.columns if c != features] if keep is None else keep
    assigned = assign_nearest(df, codebook, method=method, features=features, keep=keep)
    return assigned.select(*keep, F.col("code_label").alias(pred_col))
