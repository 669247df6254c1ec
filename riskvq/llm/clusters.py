"""Operator 11: centroid clustering (Lloyd rounds) by Shallot search.

Every vector remembers its nearest and second-nearest centroid, an upper bound
of its distance to the first and a lower bound of that to all others.  When
centroids move, bounds are widened by how far they moved; a vector whose bounds
still part needs no distance at all.  Otherwise both remembered centroids are
measured and the search starts at the closer one: its neighbours are scanned in
order of their distance from it, until that exceeds the vector's distance to
the start plus that to the second-nearest centroid seen so far, a radius that
shrinks as better ones are found.  Survivors are measured and compared in
integers; bounds are floating point and rounded outwards.

A round is one map-only pass: it writes the vectors (integers of two or four
bytes) with their new state to the shared checkpoint folder, and beside them
one row per centroid and task with the sums of its vectors.  The sums of these
rows, at most centroids x components numbers, come to the driver.

Cases: vectors that are NULL, of another width, or with NULL or non-finite
components are left out; integers beyond +-LIMIT (components beyond 65,536) are
taken as LIMIT, so that distances are exact in 64 bits; sums of distances above
the largest long are given as that; rows without vec_id never start a centroid
before those with one; rows that share a vec_id count one by one, and start in
the order of their vectors; with fewer vectors than centroids each one is a
start; an empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import hashlib
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import ddl
from riskvq.session import ensure_checkpoint_dir

WIDTH, CENTROIDS, ROUNDS, SEED, SCALE = 64, 40, 5, 2, 256
LIMIT = 1 << 24
MOST_CELLS = 4_000_000  # centroids x width, and centroids squared
ROWS = 4096             # vectors of one numpy step
LONGEST = (1 << 63) - 1

STATE = [("vec_id", "bigint"), ("vec", "binary"), ("cluster", "int"), ("second", "int"), ("upper", "float"),
         ("lower", "float"), ("distance", "bigint"), ("n", "bigint"), ("sums", "array<bigint>")]
TYPES = [pa.int64(), pa.binary(), pa.int32(), pa.int32(), pa.float32(), pa.float32(), pa.int64(), pa.int64(),
         pa.list_(pa.int64())]  # of STATE


def integers(x: np.ndarray) -> np.ndarray:
    """floor(SCALE * x), held within +-LIMIT."""
    with np.errstate(over="ignore"):
        return np.clip(np.floor(x.astype(np.float64) * SCALE), -LIMIT, LIMIT).astype(np.int64)


def packed(x: np.ndarray) -> list[bytes]:
    """Each row in two bytes a component if they suffice, else in four."""
    small = (np.abs(x) < 1 << 15).all(axis=1)
    narrow, wide = x.astype(np.int16), x.astype(np.int32)
    return [(narrow if s else wide)[i].tobytes() for i, s in enumerate(small.tolist())]


def unpacked(raws: list[bytes], width: int) -> np.ndarray:
    out = np.empty((len(raws), width), np.int64)
    small = np.array([len(r) == 2 * width for r in raws], bool)
    for which, kind in ((small, np.int16), (~small, np.int32)):
        at = np.flatnonzero(which)
        if len(at):
            out[at] = np.frombuffer(b"".join(raws[i] for i in at), kind).reshape(len(at), width)
    return out


class Centroids:
    """Integer centroids with the distances between them and, for each, the others by distance."""

    def __init__(self, points: np.ndarray, before: np.ndarray | None = None):
        self.points = points
        k = len(points)
        self.gaps = np.empty((k, k))
        for i in range(k):
            self.gaps[i] = np.sqrt(((points - points[i]) ** 2).sum(axis=1))
        self.order = np.argsort(self.gaps, axis=1, kind="stable")
        for i in range(k):  # itself first, also among equal ones
            row = self.order[i]
            self.order[i] = np.concatenate([[i], row[row != i]])
        self.moved = np.zeros(k) if before is None else np.sqrt(((points - before) ** 2).sum(axis=1)) * (1 + 1e-9)
        # the farthest that any other centroid moved
        top = int(self.moved.argmax()) if k else 0
        self.others = np.full(k, self.moved.max() if k else 0.0)
        if k > 1:
            self.others[top] = np.delete(self.moved, top).max()

    def squared(self, x: np.ndarray, which: np.ndarray) -> np.ndarray:
        return ((x - self.points[which]) ** 2).sum(axis=1)

    def search(self, x: np.ndarray, first: np.ndarray, second: np.ndarray) -> tuple[np.ndarray, ...]:
        """Nearest and second-nearest centroid and both squared distances, from two remembered ones."""
        d1, d2 = self.squared(x, first), self.squared(x, second)
        swap = (d2 < d1) | ((d2 == d1) & (second < first))
        best, other = np.where(swap, second, first), np.where(swap, first, second)
        d1, d2 = np.where(swap, d2, d1), np.where(swap, d1, d2)
        start, seen, radius = best.copy(), other.copy(), np.sqrt(d1)
        live = np.arange(len(x))
        for j in range(1, len(self.points)):
            c = self.order[start[live], j]
            reach = (radius[live] + np.sqrt(d2[live])) * (1 + 1e-9) + 1e-6
            near = self.gaps[start[live], c] <= reach
            live, c = live[near], c[near]
            if not len(live):
                break
            new = c != seen[live]
            at, c = live[new], c[new]
            d = self.squared(x[at], c)
            win = (d < d1[at]) | ((d == d1[at]) & (c < best[at]))
            w, l = at[win], at[~win]
            other[w], d2[w] = best[w], d1[w]
            best[w], d1[w] = c[win], d[win]
            closer = d[~win] < d2[l]
            other[l[closer]], d2[l[closer]] = c[~win][closer], d[~win][closer]
        return best, other, d1, d2

    def assign(self, x: np.ndarray, cluster: np.ndarray, second: np.ndarray, upper: np.ndarray,
               lower: np.ndarray) -> tuple[np.ndarray, ...]:
        """The state of vectors after the centroids moved: cluster, second, upper, lower."""
        cluster, second = cluster.astype(np.int64), second.astype(np.int64)
        if len(self.points) == 1:
            return np.zeros_like(cluster), np.zeros_like(second), upper, np.full(len(x), np.inf)
        upper = (upper + self.moved[cluster]) * (1 + 1e-9)
        lower = (lower - self.others[cluster]) * (1 - 1e-9)
        open_ = np.flatnonzero(~(upper < lower))
        upper[open_] = np.sqrt(self.squared(x[open_], cluster[open_])) * (1 + 1e-9)
        open_ = open_[~(upper[open_] < lower[open_])]
        if len(open_):
            best, other, d1, d2 = self.search(x[open_], cluster[open_], second[open_])
            cluster[open_], second[open_] = best, other
            upper[open_], lower[open_] = np.sqrt(d1) * (1 + 1e-9), np.sqrt(d2) * (1 - 1e-9)
        return cluster, second, upper, lower


def _outwards(upper: np.ndarray, lower: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Bounds in single precision, rounded to the safe side."""
    return (np.nextafter(upper.astype(np.float32), np.float32(np.inf)),
            np.nextafter(lower.astype(np.float32), np.float32(-np.inf)))


def _round(points: np.ndarray, before: np.ndarray | None, final: bool):
    """Rows of vectors (first round: vec_id, components; later: vec_id, vec, state) to STATE rows, then sums."""
    k, width = points.shape

    def run(batches):
        centroids = Centroids(points, before)
        counts, sums = np.zeros(k, np.int64), np.zeros((k, width + 2), np.int64)
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS):
                part = batch.slice(s, ROWS)
                m = part.num_rows
                if before is None:
                    x = integers(part.column(1).flatten().to_numpy(zero_copy_only=False)).reshape(m, width)
                    vecs = pa.array(packed(x), pa.binary())
                    state = (np.zeros(m, np.int64), np.full(m, min(1, k - 1)), np.full(m, np.inf), np.zeros(m))
                else:
                    vecs = part.column(1)
                    x = unpacked(vecs.to_pylist(), width)
                    state = [c.to_numpy(zero_copy_only=False) for c in part.columns[2:6]]
                    state = (*state[:2], state[2].astype(np.float64), state[3].astype(np.float64))
                cluster, second, upper, lower = centroids.assign(x, *state)
                np.add.at(counts, cluster, 1)
                np.add.at(sums, (cluster, slice(0, width)), x)
                distance = pa.nulls(m, pa.int64())
                if final:  # two halves, whose sums stay within 64 bits
                    d = centroids.squared(x, cluster)
                    np.add.at(sums, (cluster, width), d >> 31)
                    np.add.at(sums, (cluster, width + 1), d & (2**31 - 1))
                    distance = pa.array(d, pa.int64())
                upper, lower = _outwards(upper, lower)
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), vecs, pa.array(cluster.astype(np.int32)), pa.array(second.astype(np.int32)),
                     pa.array(upper), pa.array(lower), distance, pa.nulls(m, pa.int64()),
                     pa.nulls(m, pa.list_(pa.int64()))], names=[n for n, _ in STATE])
        at = np.flatnonzero(counts)
        if len(at):
            nulls = [pa.nulls(len(at), t) for t in TYPES]
            nulls[2], nulls[7] = pa.array(at.astype(np.int32)), pa.array(counts[at])
            nulls[8] = pa.array(sums[at].tolist(), TYPES[8])
            yield pa.RecordBatch.from_arrays(nulls, names=[n for n, _ in STATE])

    return run


def usable(column: Column, width: int) -> Column:
    bad = F.exists(column, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    return column.isNotNull() & (F.size(column) == width) & ~bad


def start_points(vectors: DataFrame, k: int, seed: int) -> np.ndarray:
    """The integer vectors of the k smallest sha256 of ``seed:vec_id``; k rows come to the driver."""
    order = F.sha2(F.concat(F.lit(f"{seed}:"), F.col("vec_id").cast("string")), 256)
    rows = vectors.select(order.alias("h"), "x").orderBy(F.col("h").asc_nulls_last(), "x").limit(k).collect()
    return integers(np.array([r.x for r in rows], np.float64))


def _sums(state: DataFrame, k: int, width: int) -> tuple[list[int], list[list[int]]]:
    """Number of vectors and sums by centroid: at most k * (width + 2) numbers."""
    rows = (state.where(F.col("n").isNotNull())
            .select("cluster", "n", F.posexplode("sums").alias("i", "v"))
            .groupBy("cluster", "i").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect())
    counts, sums = [0] * k, [[0] * (width + 2) for _ in range(k)]
    for r in rows:
        counts[r.cluster] = r.n
        sums[r.cluster][r.i] = r.v
    return counts, sums


def cluster_vectors(table: DataFrame, k: int = CENTROIDS, rounds: int = ROUNDS, width: int = WIDTH,
                    seed: int = SEED) -> DataFrame:
    """Per usable row of (vec_id, embedding): vec_id, cluster, distance, cluster_inertia, inertia, centroid_sha256."""
    if k * max(k, width) > MOST_CELLS:
        raise ValueError(f"{k} centroids of {width} components exceed {MOST_CELLS} cells a task")
    spark = table.sparkSession
    folder = f"{ensure_checkpoint_dir(spark)}/clusters-{uuid.uuid4().hex}"
    x = F.col("embedding").cast("array<double>")
    vectors = (table.select(F.col("vec_id").cast("bigint").alias("vec_id"), x.alias("x"))
               .where(usable(F.col("x"), width)))
    points, before, state = start_points(vectors, k, seed), None, vectors
    k = len(points)
    if not k:
        return spark.createDataFrame([], "vec_id bigint, cluster int, distance bigint, cluster_inertia bigint, "
                                         "inertia bigint, centroid_sha256 string")
    for turn in range(rounds + 1):
        out = state.mapInArrow(_round(points, before, turn == rounds), ddl(STATE))
        out.write.parquet(f"{folder}/{turn}")
        written = spark.read.parquet(f"{folder}/{turn}")
        counts, sums = _sums(written, k, width)
        state = written.where(F.col("n").isNull()).select("vec_id", "vec", "cluster", "second", "upper", "lower")
        if turn < rounds:
            before = points
            points = np.array([[v // n for v in s[:width]] if n else p
                               for n, s, p in zip(counts, sums, before.tolist(), strict=True)], np.int64)
    inertia = [(s[width] << 31) + s[width + 1] for s in sums]
    ends = [(c, min(i, LONGEST), min(sum(inertia), LONGEST),
             hashlib.sha256(",".join(map(str, points[c].tolist())).encode()).hexdigest())
            for c, i in enumerate(inertia)]
    # k rows
    named = spark.createDataFrame(ends, "cluster int, cluster_inertia bigint, inertia bigint, centroid_sha256 string")
    return (written.where(F.col("n").isNull()).select("vec_id", "cluster", "distance")
            .join(F.broadcast(named), "cluster")
            .select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256"))
