"""Bayes Vector Quantizer training under a cost matrix (M4-M6).

For a row ``x`` of class ``u`` whose two nearest codes are ``i`` (nearest,
label ``l_i``) and ``j`` (label ``l_j``), with cost ``b(actual, decided)`` and
``n = |m_i - m_j|``::

    g   = rate * (b(u, l_j) - b(u, l_i)) / n
    m_i <- m_i - g * (m_i - t)
    m_j <- m_j + g * (m_j - t)

only when ``l_i != l_j``, ``n > 0`` and ``x`` lies inside the window around
the bisector: ``(d_j^2 - d_i^2) / (2 n) <= window_half_width`` (default
``delta / 2``).  ``t`` is the row itself (``target="sample"``) or its
projection on the bisector (``target="projection"``).

Batch semantics: all contributions of a bag are taken against the codebook
at the start of the bag and summed per code.  Per code the update is
``m_k <- m_k + S_k * m_k - V_k`` with ``S_k = sum(coef)`` and
``V_k = sum(coef * t)``: each task sums its own rows, the partial sums are
added, and at most K rows of D sums come back per bag.  With one active row
this equals the online rule exactly.

A cost table must list every class it names against every label of the
codebook; rows of a class that it does not name are not trained on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskvq.operators.aggregates import partial_sums, weighted_sums
from riskvq.operators.codebook import Codebook, as_codebook, local_frame
from riskvq.operators.exact_sums import SLICES, ExactSums, collected, rounded
from riskvq.operators.nearest import ARROW_METHODS, GEMM_MIN_TERMS, PARTIAL_SCHEMA, _arrow_nearest, make_finder, two_nearest
from riskvq.operators.progress import Progress
from riskvq.operators.sampling import draw_bags


def check_cost(cost: dict | None, cb: Codebook) -> None:
    """Raise if a class of the cost table lacks its cost against a label of the codebook."""
    if cost is None:
        return
    if len(cost) > MAX_COST_CELLS:
        raise ValueError("cost matrix too large to broadcast")
    labels = {int(x) for x in cb.code_label}
    missing = [(a, p) for a in {a for a, _ in cost} for p in labels if a != p and (a, p) not in cost]
    if missing:
        raise ValueError(f"cost of {sorted(missing)[:5]} (actual, decided) is not given")


def _cost_lookup(cost, actual: Column, decided: Column) -> Column:
    """``b(actual, decided)``: 0/1 by default, a dict ``{(a, p): c}`` literal
    map otherwise (classes x classes entries, small by construction); deciding
    the actual class costs 0 unless the table says otherwise."""
    if cost is None:
        return F.when(actual == decided, F.lit(0.0)).otherwise(F.lit(1.0))
    pairs = []
    for (a, p), c in sorted(cost.items()):
        pairs += [F.lit(f"{int(a)}:{int(p)}"), F.lit(float(c))]
    m = F.create_map(*pairs)
    return F.coalesce(F.element_at(m, F.concat(actual.cast("string"), F.lit(":"), decided.cast("string"))),
                      F.lit(0.0))


def cost_from_matrix(classes: list[int], matrix) -> dict[tuple[int, int], float]:
    """``[[0,1],[1,0]]`` indexed in ``classes`` order to a dict."""
    return {(int(a), int(p)): float(matrix[i][j]) for i, a in enumerate(classes) for j, p in enumerate(classes)}


def _fold_sum(v: Column) -> Column:
    return F.aggregate(v, F.lit(0.0), lambda acc, e: acc + e)


# Cost matrices up to this many cells are a literal map in the plan; larger
# ones are joined by broadcast.
MAP_COST_CELLS = 1_024
MAX_COST_CELLS = 1_000_000

# Bags up to this size are summed by one task (same sums, no aggregate).
ONE_TASK_ROWS = 50_000


def _with_vectors(df: DataFrame, cb: Codebook) -> DataFrame:
    """Attach ``w_i``, ``w_j`` (one broadcast relation, joined twice)."""
    cbw = F.broadcast(cb.to_df(df.sparkSession).select("code_id", "w"))
    return (df.join(cbw, df.code_i == cbw.code_id).withColumnRenamed("w", "w_i").drop("code_id")
            .join(cbw, F.col("code_j") == cbw.code_id).withColumnRenamed("w", "w_j").drop("code_id"))


def bvq_candidates(df: DataFrame, codebook, features: str = "features", method: str = "auto",
                   keep: list[str] | None = None) -> DataFrame:
    """Rows whose two nearest codes carry different labels, with
    ``n = |w_i - w_j|`` and the distance from the bisector ``gap``.

    ``keep`` names the columns of ``df`` to return (default all).

    The two nearest codes come from the map-only nearest-code operator, whose
    Arrow form also returns ``n`` of the chosen pair; it is an optimizer barrier,
    so the label filter is not pushed into a generated distance expression.
    """
    cb = as_codebook(codebook)
    differ = F.col("label_j").isNotNull() & (F.col("label_i") != F.col("label_j"))
    if method in ARROW_METHODS:
        nrm = _arrow_nearest(df, cb, 2, False, features, with_pair_norm=True, keep=keep, method=method).where(differ)
    else:
        joined = _with_vectors(two_nearest(df, cb, method=method, features=features).where(differ), cb)
        dw = joined.withColumn("_dw", F.zip_with("w_i", "w_j", lambda a, b: a - b))
        nrm = dw.withColumn("n", F.sqrt(_fold_sum(F.zip_with("_dw", "_dw", lambda a, b: a * b)))).drop(
            "_dw", "w_i", "w_j")
        if keep is not None:
            nrm = nrm.drop(*[c for c in df.columns if c not in keep])
    return nrm.withColumn("gap", (F.col("d2_j") - F.col("d2_i")) / (F.lit(2.0) * F.col("n")))


def _half_width(delta: float | None, window_half_width: float | None) -> float | None:
    if window_half_width is not None:
        return window_half_width
    return None if delta is None else delta / 2.0


def bvq_window(df: DataFrame, codebook, delta: float | None = 0.2, window_half_width: float | None = None,
               features: str = "features", method: str = "auto", keep: list[str] | None = None) -> DataFrame:
    """Rows whose two nearest codes disagree on the class and which lie
    inside the window around their bisector (M4); only the columns of ``keep``
    (default all) come back from the kernel."""
    hw = _half_width(delta, window_half_width)
    c = bvq_candidates(df, codebook, features, method, keep)
    cond = F.col("n") > 0
    if hw is not None:
        cond = cond & (F.col("gap") <= F.lit(hw))
    return c.where(cond)


def bvq_contributions(df: DataFrame, codebook, rate: float, delta: float | None = 0.2,
                      window_half_width: float | None = None, cost: dict | None = None,
                      target: str = "sample", features: str = "features", method: str = "auto") -> DataFrame:
    """Two rows per active sample: ``(code_id, coef, t)`` (M5 before the sum)."""
    check_cost(cost, as_codebook(codebook))
    active = bvq_window(df, codebook, delta, window_half_width, features, method)
    u = F.col("label")
    if cost is None or len(cost) <= MAP_COST_CELLS:
        g = (F.lit(rate) * (_cost_lookup(cost, u, F.col("label_j")) - _cost_lookup(cost, u, F.col("label_i")))
             / F.col("n"))
    x = F.col(features)
    if target == "sample":
        t = x
    elif target == "projection":
        # vector work only for the rows inside the window
        active = _with_vectors(active, as_codebook(codebook))
        active = active.withColumn("dw", F.zip_with("w_i", "w_j", lambda a, b: a - b))
        active = active.withColumn("_xm", F.zip_with(x, F.zip_with("w_i", "w_j", lambda a, b: (a + b) / F.lit(2.0)),
                                                     lambda a, b: a - b))
        active = active.withColumn("_pc", _fold_sum(F.zip_with("_xm", "dw", lambda a, b: a * b))
                                   / (F.col("n") * F.col("n")))
        t = F.zip_with(x, F.col("dw"), lambda a, b: a - F.col("_pc") * b)
    else:
        raise ValueError(f"unknown target {target!r}")
    if cost is not None and len(cost) > MAP_COST_CELLS:
        # many classes: look the two costs up by broadcast joins instead of a literal map
        table = F.broadcast(local_frame(df.sparkSession, [(int(a), int(p), float(c)) for (a, p), c in cost.items()],
                                        [("_a", "int"), ("_p", "int"), ("_c", "double")]))
        active = (active.join(table.withColumnRenamed("_c", "_bi"),
                              (F.col("label") == F.col("_a")) & (F.col("label_i") == F.col("_p")), "left")
                  .drop("_a", "_p")
                  .join(table.withColumnRenamed("_c", "_bj"),
                        (F.col("label") == F.col("_a")) & (F.col("label_j") == F.col("_p")), "left")
                  .drop("_a", "_p"))
        g = (F.lit(rate) * (F.coalesce(F.col("_bj"), F.lit(0.0)) - F.coalesce(F.col("_bi"), F.lit(0.0)))
             / F.col("n"))
    act = active.select(F.col("code_i"), F.col("code_j"), g.alias("g"), t.alias("t")).where(F.col("g") != 0)
    pair = F.explode(F.array(F.struct(F.col("code_i").alias("code_id"), (-F.col("g")).alias("coef")),
                             F.struct(F.col("code_j").alias("code_id"), F.col("g").alias("coef"))))
    return act.select(pair.alias("c"), "t").select("c.code_id", "c.coef", "t")


def _mover(cb: Codebook, rate: float, half_width: float | None, cost: dict | None, target: str, method: str):
    """``(moves, matrix, active)``: the rule of a step in numpy.

    ``moves(w, x, ok, u)``: what rows contribute against codes ``w``, as two
    (code, coefficient, target) triples.  ``active(w, x, u, i, j, d_i, d_j)``: of
    rows with their two nearest codes, those that move them, with their factor
    and target.  Nested, so that they travel to the workers by value.
    """
    labels, dims = cb.code_label.copy(), cb.dims
    _, matrix = make_finder(labels, cb.w.copy(), 2, False, GEMM_MIN_TERMS, "arrow")
    classes = decided = costs = None
    if cost is not None:
        classes, decided = np.unique([a for a, _ in cost]), np.unique(labels)
        costs = np.array([[cost.get((int(a), int(p)), 0.0) for p in decided] for a in classes])

    def active(w, x, u, i, j, d_i, d_j):
        at = np.flatnonzero(np.isfinite(u) & np.isfinite(d_j) & (labels[i] != labels[j]))
        if classes is not None:
            at = at[np.isin(u[at], classes)]
        dw = w[i[at]] - w[j[at]]
        norm = np.sqrt(np.add.accumulate(dw * dw, axis=1)[:, -1]) if dw.size else np.zeros(len(at))
        near = norm > 0
        if half_width is not None:
            with np.errstate(divide="ignore", invalid="ignore"):
                near &= (d_j[at] - d_i[at]) / (2.0 * norm) <= half_width
        at, dw, norm = at[near], dw[near], norm[near]
        i, j, u, x = i[at], j[at], u[at], x[at]
        if classes is None:
            b_i, b_j = (u != labels[i]).astype(float), (u != labels[j]).astype(float)
        else:
            c = np.searchsorted(classes, u)
            b_i, b_j = (costs[c, np.searchsorted(decided, labels[k])] for k in (i, j))
        g = rate * (b_j - b_i) / norm
        t = x
        if target == "projection":
            mid = (w[i] + w[j]) / 2.0
            t = x - (np.einsum("nd,nd->n", x - mid, dw) / (norm * norm))[:, None] * dw
        moved = g != 0
        return at[moved], g[moved], t[moved]

    def moves(w, x, ok, u, find=None):
        find = find or make_finder(labels, w, 2, False, GEMM_MIN_TERMS, method)[0]
        idx, dist = find(x, None)
        i, j = idx[:, 0], idx[:, 1]
        at, g, t = active(w, x, np.where(ok, u, np.nan), i, j, dist[:, 0], dist[:, 1])
        return (i[at], -g, t), (j[at], g, t)

    return moves, matrix, active


def _bvq_kernel(cb: Codebook, rate: float, half_width: float | None, cost: dict | None, target: str, method: str,
                replicable: bool):
    """Per task: rows, sum of coefficients and sum of coefficient times target by code.

    ``replicable``: the sums in exact slices, the coefficient as one more dimension."""
    ids, w, k, dims = cb.code_id.copy(), cb.w.copy(), cb.k, cb.dims
    moves, matrix, _ = _mover(cb, rate, half_width, cost, target, method)
    find, _ = make_finder(cb.code_label.copy(), w, 2, False, GEMM_MIN_TERMS, method)

    def run(batches):
        import pyarrow as pa

        n, s, v = np.zeros(k, np.int64), np.zeros(k), np.zeros((0 if replicable else k, dims))
        exact = ExactSums(k, dims + 1)
        for rb in batches:
            x, ok = matrix(rb.column(0))
            u = rb.column(1).cast(pa.float64()).to_numpy(zero_copy_only=False)
            for code, coef, t in moves(w, x, ok, u, find):
                if replicable:
                    exact.add(code, np.concatenate([coef[:, None] * t, coef[:, None]], axis=1))
                    continue
                n += np.bincount(code, minlength=k)
                np.add.at(s, code, coef)
                np.add.at(v, code, coef[:, None] * t)
        if replicable:
            yield exact.rows(ids)
            return
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays(
            [pa.array(ids[used], pa.int64()), pa.array(n[used], pa.int64()), pa.array(s[used], pa.float64()),
             pa.array(list(v[used]), pa.list_(pa.float64()))], names=["code_id", "n", "s", "v"])

    return run


# Rows whose distances to all codes are held together when a bag is trained row by row.
ONLINE_ROWS = 512
CHAIN_SCHEMA = "bag int, code_id bigint, w array<double>"


def _chain_kernel(cb: Codebook, rate: float, half_width: float | None, cost: dict | None, target: str, method: str,
                  replicable: bool, order: str, keep_history: bool):
    """Rows (bag, features, label) in order of bag and place to the codebook after the last bag, or after each.

    ``batch``: a bag's contributions are summed against the codebook at its
    start.  ``online``: every row sees the codes as the rows before it left them.
    A moved pair touches only the later rows' distances to those two codes, so
    the distances of a block of rows to all codes are kept, the next row that
    moves anything is found from them, and its two columns are measured again.
    """
    ids, k, dims = cb.code_id.copy(), cb.k, cb.dims
    start = cb.w.copy()
    moves, matrix, active = _mover(cb, rate, half_width, cost, target, method)
    rounded_total = rounded

    def online(w, x, u):
        for a in range(0, len(x), ONLINE_ROWS):
            xb, ub = x[a:a + ONLINE_ROWS], u[a:a + ONLINE_ROWS]
            d = np.stack([np.einsum("nd,nd->n", xb - c, xb - c) for c in w], axis=1)
            at = 0
            while at < len(xb):
                rest = d[at:]
                i = rest.argmin(axis=1)
                rows = np.arange(len(rest))
                d_i = rest[rows, i]
                second = rest.copy()
                second[rows, i] = np.inf
                j = second.argmin(axis=1)
                on, g, t = active(w, xb[at:], ub[at:], i, j, d_i, second[rows, j])
                if not len(on):
                    break
                r, g, t = on[0], g[0], t[0]  # the first row that moves anything
                p, q = i[r], j[r]
                w[p], w[q] = w[p] - g * (w[p] - t), w[q] + g * (w[q] - t)
                at += r + 1
                for c in (p, q):
                    d[at:, c] = np.einsum("nd,nd->n", xb[at:] - w[c], xb[at:] - w[c])
        return w

    def run(batches):
        import pyarrow as pa

        w = start.copy()
        bag = None
        n, s, v, exact = np.zeros(k, np.int64), np.zeros(k), np.zeros((k, dims)), ExactSums(k, dims + 1)

        def apply():
            if replicable:
                for c in np.flatnonzero(exact.n):
                    total = np.array([rounded_total({p: int(m[c, d]) for p, m in exact.places.items()})
                                      for d in range(dims + 1)])
                    w[c] = w[c] + total[-1] * w[c] - total[:-1]
            else:
                used = n > 0
                w[used] = w[used] + s[used, None] * w[used] - v[used]

        def codes():
            return pa.RecordBatch.from_arrays(
                [pa.array(np.full(k, bag, np.int32), pa.int32()), pa.array(ids, pa.int64()),
                 pa.array(list(w), pa.list_(pa.float64()))], names=["bag", "code_id", "w"])

        for rb in batches:
            bags = rb.column(0).to_numpy()
            x, ok = matrix(rb.column(1))
            u = np.where(ok, rb.column(2).cast(pa.float64()).to_numpy(zero_copy_only=False), np.nan)
            cuts = [0, *(np.flatnonzero(np.diff(bags)) + 1).tolist(), len(bags)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if bags[a] != bag:
                    if bag is not None:
                        apply()
                        if keep_history:
                            yield codes()
                    bag = int(bags[a])
                    n[:], s[:], v[:] = 0, 0, 0
                    exact = ExactSums(k, dims + 1)
                if order == "online":
                    online(w, x[a:b], u[a:b])
                    continue
                for code, coef, t in moves(w, x[a:b], ok[a:b], u[a:b]):
                    if replicable:
                        exact.add(code, np.concatenate([coef[:, None] * t, coef[:, None]], axis=1))
                    else:
                        n += np.bincount(code, minlength=k)
                        np.add.at(s, code, coef)
                        np.add.at(v, code, coef[:, None] * t)
        if bag is not None:
            apply()
            yield codes()

    return run


def _trained_in_one_task(bags: DataFrame, cb: Codebook, kernel) -> list[tuple[int, Codebook]]:
    """(bag, codebook) for the bags that the kernel hands back; the last is the last bag's."""
    rows = bags.coalesce(1).sortWithinPartitions("bag", "pos").select("bag", "features", "label")
    place = {int(c): i for i, c in enumerate(cb.code_id)}
    found: dict[int, np.ndarray] = {}
    # the codes of the bags asked for, as Arrow arrays
    for batch in rows.mapInArrow(kernel, CHAIN_SCHEMA).toArrow().to_batches():
        numbers, ids = batch.column(0).to_numpy(), batch.column(1).to_pylist()
        w = batch.column(2).flatten().to_numpy().reshape(len(ids), -1)
        for bag in np.unique(numbers).tolist():
            at = np.flatnonzero(numbers == bag)
            found.setdefault(bag, np.empty_like(cb.w))[[place[ids[i]] for i in at]] = w[at]
    return [(bag, cb.with_weights(w)) for bag, w in sorted(found.items())]


def bvq_step(bag: DataFrame, codebook, rate: float, delta: float | None = 0.2,
             window_half_width: float | None = None, cost: dict | None = None,
             target: str = "sample", features: str = "features", method: str = "auto",
             one_task: bool = False, replicable: bool = False) -> Codebook:
    """One batch BVQ step on a bag (M5); returns the new codebook.

    ``one_task`` says that the bag is small and in one partition: its sums are
    then whole and need no aggregate.  ``replicable`` adds in whole numbers
    (``exact_sums``): the same bytes under any partitioning."""
    cb = as_codebook(codebook)
    if cb.k < 2:
        return cb
    check_cost(cost, cb)
    if target not in ("sample", "projection"):
        raise ValueError(f"unknown target {target!r}")
    if method in ARROW_METHODS or replicable:
        kernel = _bvq_kernel(cb, rate, _half_width(delta, window_half_width), cost, target, method, replicable)
        partials = bag.select(features, "label").mapInArrow(kernel, SLICES if replicable else PARTIAL_SCHEMA)
        if replicable:
            sums = {c: (n, float(v[-1]), v[:-1]) for c, (n, v) in collected(partials, cb.dims + 1).items()}
        else:
            sums = partial_sums(partials, cb.dims, cb.k, one_task)
    else:
        contrib = bvq_contributions(bag, cb, rate, delta, window_half_width, cost, target, features, method)
        sums = weighted_sums(contrib, "code_id", cb.dims, weight=F.col("coef"), vec=F.col("t"), max_keys=cb.k)
    w = cb.w.copy()
    for i, cid in enumerate(cb.code_id):
        got = sums.get(int(cid))
        if got:
            _, s, v = got
            w[i] = w[i] + s * w[i] - v
    return cb.with_weights(w)


@dataclass
class BvqHistory:
    steps: list = field(default_factory=list)  # (epoch, bag, codebook)


def bvq_train(train: DataFrame, codebook, epochs: int, rate: float, delta: float | None = 0.2,
              window_half_width: float | None = None, cost: dict | None = None, target: str = "sample",
              n_bags: int | None = None, bag_size: int | None = None, seed: int = 0,
              use_bags: bool = True, id_col: str = "id", keep_history: bool = False,
              features: str = "features", method: str = "auto", replicable: bool = False,
              order: str = "batch", progress: str | None = None) -> tuple[Codebook, BvqHistory]:
    """``epochs`` x ``n_bags`` BVQ steps, codebook chained bag to bag (M6).

    With bags, all ``epochs * n_bags`` bags are drawn once (a count and one
    keyed pass over the training table).  A bag needs the codebook of the bag
    before, so bags of at most ``ONE_TASK_ROWS`` rows are trained one after the
    other in one task that holds a batch of rows and the codebook: one job for
    all bags if they have at most ``ONE_TASK_ROWS`` rows together, else one an
    epoch.  Larger bags are one distributed step each; their rows are laid out
    by bag and kept until the last step (a lost block is drawn again with the
    same keys).  Without bags every epoch is one step over the whole training
    table.

    ``order="online"`` trains the rows of a bag one by one in the order drawn,
    as a serial program does, instead of summing a bag (small bags only).
    ``progress`` names a shared folder: the codebook is written there after each
    epoch, and a run that finds one of its own goes on from the last.
    """
    if order not in ("batch", "online"):
        raise ValueError(f"unknown order {order!r}")
    bagged = bool(use_bags and n_bags and bag_size)
    small = bagged and bag_size <= ONE_TASK_ROWS and method in ARROW_METHODS
    if order == "online" and not small:
        raise ValueError(f"rows are trained one by one in bags of at most {ONE_TASK_ROWS} rows only")
    cb = as_codebook(codebook)
    hist = BvqHistory()
    if cb.k < 2 or epochs < 1:
        return cb, hist
    check_cost(cost, cb)
    if target not in ("sample", "projection"):
        raise ValueError(f"unknown target {target!r}")
    saved = Progress(train.sparkSession, progress, cb, ("bvq", rate, delta, window_half_width, sorted((cost or {}).items()),
                                                        target, n_bags, bag_size, seed, bagged, order, replicable))
    done, cb = saved.last(cb)
    if done >= epochs:
        return cb, hist
    half_width = _half_width(delta, window_half_width)
    bags = None
    if bagged:
        bags = draw_bags(train, epochs * n_bags, bag_size, seed, id_col).select("bag", "pos", F.col(features).alias("features"),
                                                                               "label")
    one_job = small and progress is None and epochs * n_bags * bag_size <= ONE_TASK_ROWS
    if bagged and not one_job:
        bags = bags.repartitionByRange("bag").sortWithinPartitions("bag", "pos").persist(StorageLevel.MEMORY_AND_DISK)
    try:
        e = done
        while e < epochs:
            if small:
                until = epochs if one_job else e + 1
                kernel = _chain_kernel(cb, rate, half_width, cost, target, method, replicable, order, keep_history)
                own = bags.where((F.col("bag") > e * n_bags) & (F.col("bag") <= until * n_bags))
                for bag, moved in _trained_in_one_task(own, cb, kernel):
                    cb = moved
                    if keep_history:
                        hist.steps.append(((bag - 1) // n_bags, (bag - 1) % n_bags, cb))
                e = until
            else:
                for b in range(n_bags if bagged else 1):
                    rows = bags.where(F.col("bag") == F.lit(e * n_bags + b + 1)) if bagged else train
                    cb = bvq_step(rows, cb, rate, delta, window_half_width, cost, target,
                                  "features" if bagged else features, method, replicable=replicable)
                    if keep_history:
                        hist.steps.append((e, b, cb))
                e += 1
            saved.save(e, cb)
    finally:
        if bagged and not one_job:
            bags.unpersist()
    return cb, hist
