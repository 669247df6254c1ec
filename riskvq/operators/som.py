"""Self-organising-map passes used to place an initial codebook (M2, M3).

Batch map: every row of a pass is assigned to its nearest code against the
codebook at the start of the pass, then each code moves toward the mean of
the rows it (or a neighbour within ``radius``) won::

    w_k <- w_k + rate * (mean_k - w_k)          codes with no rows stay

Neighbours are codes of the same class whose position in ``code_id`` order
differs by at most ``radius`` (a bubble kernel on a 1-D chain); ``radius=0``
is winner-only.  Labels never change.  One pass = one Spark job: each task sums
its rows per winning code, the partial sums are added, and at most K rows of D
sums reach the driver, which spreads them over the neighbours.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame

from riskvq.operators.aggregates import partial_sums, weighted_sums
from riskvq.operators.codebook import Codebook, as_codebook
from riskvq.operators.exact_sums import SLICES, ExactSums, collected
from riskvq.operators.nearest import ARROW_METHODS, GEMM_MIN_TERMS, PARTIAL_SCHEMA, assign_nearest, make_finder
from riskvq.operators.progress import Progress
from riskvq.operators.sampling import bernoulli_sample


def _som_kernel(cb: Codebook, within_class: bool, method: str, replicable: bool):
    """Per task: rows and sums of features by winning code (``replicable``: in exact slices)."""
    ids, k, dims = cb.code_id.copy(), cb.k, cb.dims
    find, matrix = make_finder(cb.code_label.copy(), cb.w.copy(), 1, within_class, GEMM_MIN_TERMS, method)

    def run(batches):
        import pyarrow as pa

        n, v = np.zeros(k, np.int64), np.zeros((0 if replicable else k, dims))
        exact = ExactSums(k, dims)
        for rb in batches:
            x, ok = matrix(rb.column(0))
            lr = rb.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False) if within_class else None
            idx, dist = find(x, lr)
            won = ok & np.isfinite(dist[:, 0])
            if replicable:
                exact.add(idx[won, 0], x[won])
                continue
            np.add.at(v, idx[won, 0], x[won])
            n += np.bincount(idx[won, 0], minlength=k)
        if replicable:
            yield exact.rows(ids)
            return
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[used], pa.int64()), pa.array(n[used], pa.int64()), pa.array(n[used], pa.float64()),
             pa.array(list(v[used]), pa.list_(pa.float64()))], names=["code_id", "n", "s", "v"])

    return run


def spread(cb: Codebook, n: np.ndarray, v: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Counts and sums per code with those of its class within ``radius`` places of the code_id chain."""
    if radius <= 0:
        return n, v
    out_n, out_v = np.zeros_like(n), np.zeros_like(v)
    for lab in np.unique(cb.code_label):
        at = np.flatnonzero(cb.code_label == lab)
        for i, code in enumerate(at):
            near = at[max(0, i - radius):i + radius + 1]
            out_n[code], out_v[code] = n[near].sum(), v[near].sum(axis=0)
    return out_n, out_v


def som_step(df: DataFrame, codebook, rate: float, radius: int = 0, within_class: bool = False,
             sample_fraction: float | None = None, seed: int = 0, method: str = "auto", salt: str = "som",
             replicable: bool = False) -> Codebook:
    """One batch SOM pass; returns the moved codebook.

    ``sample_fraction`` reads a keyed sample; ``salt`` names it.  ``replicable``
    adds in whole numbers (``exact_sums``): the same bytes under any partitioning."""
    cb = as_codebook(codebook)
    if cb.k == 0:
        return cb
    data = df if sample_fraction is None else bernoulli_sample(df, sample_fraction, seed, salt=salt)
    if method in ARROW_METHODS or replicable:
        columns = ["features", "label"] if within_class else ["features"]
        kernel = _som_kernel(cb, within_class, method, replicable)
        partials = data.select(*columns).mapInArrow(kernel, SLICES if replicable else PARTIAL_SCHEMA)
        if replicable:
            sums = {c: (m, float(m), total) for c, (m, total) in collected(partials, cb.dims).items()}
        else:
            sums = partial_sums(partials, cb.dims, cb.k)
    else:
        # rows without a code (NULL key) form one group that is left out
        sums = weighted_sums(assign_nearest(data, cb, within_class=within_class, method=method), "code_id", cb.dims,
                             max_keys=cb.k)
    n, v = np.zeros(cb.k), np.zeros((cb.k, cb.dims))
    place = {int(c): i for i, c in enumerate(cb.code_id)}
    for code, (count, _, total) in sums.items():
        n[place[code]], v[place[code]] = count, total
    n, v = spread(cb, n, v, radius)
    w = cb.w.copy()
    for i in np.flatnonzero(n > 0):
        w[i] = w[i] + rate * (v[i] / n[i] - w[i])
    return cb.with_weights(w)


def som_train(df: DataFrame, codebook, epochs: int, rate: float, radius: int = 0, within_class: bool = False,
              sample_fraction: float | None = None, seed: int = 0, method: str = "auto",
              replicable: bool = False, progress: str | None = None) -> Codebook:
    """``epochs`` SOM passes (M3), each against the codebook of the last.

    With ``sample_fraction`` each epoch uses its own keyed sample.  ``progress``
    names a shared folder: the codebook is written there after each epoch, and a
    run that finds one of its own goes on from the last.
    """
    cb = as_codebook(codebook)
    saved = Progress(df.sparkSession, progress, cb, ("som", rate, radius, within_class, sample_fraction, seed, replicable))
    done, cb = saved.last(cb)
    for e in range(done, epochs):
        cb = som_step(df, cb, rate, radius, within_class, sample_fraction, seed, method, f"som:{e}", replicable)
        saved.save(e + 1, cb)
    return cb
