"""Sums of doubles that do not depend on the order of the rows (SP11, with M2, M5, V8, E7).

Floating-point sums change with the order of their terms, so with partitions,
executors and retries.  Here every double is cut into whole numbers at fixed
places of the binary point: ``value = sum of slice[b] * 2^(32 b - OFFSET)``.
Slices of one place are added as 64-bit integers, first inside a task, then by
Spark, and whole-number sums are the same in any order.  At the end the total of
all places is an exact fraction, rounded once to the nearest double.

Only places that occur take room (two or three for values of similar size).
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow, not this package

BITS = 32
OFFSET = 1152            # a multiple of BITS above 1126: the last bit of the smallest double is 2^-1126 here
HELD_CELLS = 4_000_000   # numbers that a task holds before it hands on its sums

SLICES = "key long, n long, place int, v array<long>"


def slices(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Finite doubles as three whole numbers below 2^32 in size, and the place of the first."""
    m, e = np.frexp(x)
    whole = np.abs(m * 2.0**53).astype(np.uint64)
    at = np.where(whole > 0, e.astype(np.int64) - 53 + OFFSET, 0)
    place, shift = at // BITS, (at % BITS).astype(np.uint64)
    mask, width = np.uint64(2**BITS - 1), np.uint64(BITS)
    low = (whole & mask) << shift
    high = ((whole >> width) << shift) + (low >> width)
    out = np.stack([low & mask, high & mask, high >> width]).astype(np.int64)
    return out * np.where(x < 0, -1, 1), place


class ExactSums:
    """Sums of vectors by group number 0..groups-1, in slices.

    Slices stay below 2^32 in size when handed on: carries go to the next place,
    so some 2^31 tasks or batches add up without overflow.
    """

    def __init__(self, groups: int, dims: int):
        self.groups, self.dims = groups, dims
        self.n = np.zeros(groups, np.int64)
        self.places: dict[int, np.ndarray] = {}

    def _add(self, place: int, group: np.ndarray, v: np.ndarray) -> None:
        if place not in self.places:
            self.places[place] = np.zeros((self.groups, self.dims), np.int64)
        np.add.at(self.places[place], group, v)

    def add(self, group: np.ndarray, x: np.ndarray) -> None:
        """Add rows of finite x (n x dims) to their groups, at most 2^30 rows at a time."""
        self.n += np.bincount(group, minlength=self.groups)
        if not x.size:
            return
        parts, place = slices(x)
        for p in np.unique(place).tolist():
            here = place == p
            rows = here.any(axis=1)
            for k in range(3):
                v = np.where(here[rows], parts[k][rows], 0)
                if v.any():
                    self._add(p + k, group[rows], v)
        self.carry()

    def carry(self) -> None:
        todo = sorted(self.places)
        while todo:
            p = todo.pop(0)
            over = self.places[p] >> BITS  # rounds down, the rest is 0..2^32-1
            negative = over < 0
            over = np.where(negative & (self.places[p] > -(1 << BITS)), 0, over)
            if over.any():
                self.places[p] -= over << BITS
                if p + 1 not in self.places:
                    self.places[p + 1] = np.zeros((self.groups, self.dims), np.int64)
                    todo.insert(0, p + 1)
                self.places[p + 1] += over

    def rows(self, keys: np.ndarray):
        """A record batch of SLICES, with one row of counts a group (place NULL)."""
        import pyarrow as pa

        used = np.flatnonzero(self.n)
        key, n, place, v = [keys[used]], [self.n[used]], [np.full(len(used), -1)], [None] * len(used)
        for p, sums in sorted(self.places.items()):
            at = np.flatnonzero(sums.any(axis=1))
            key.append(keys[at])
            n.append(np.zeros(len(at), np.int64))
            place.append(np.full(len(at), p))
            v += list(sums[at])
        places = np.concatenate(place)
        return pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate(key), pa.int64()), pa.array(np.concatenate(n), pa.int64()),
             pa.array(places.astype(np.int32), pa.int32(), mask=places < 0), pa.array(v, pa.list_(pa.int64()))],
            names=["key", "n", "place", "v"])


def rounded(places: dict[int, int]) -> float:
    """The double nearest to an exact total given by place."""
    total = sum(v << (BITS * p) for p, v in places.items())
    if not total:
        return 0.0
    sign, total = (-1.0, -total) if total < 0 else (1.0, total)
    try:
        # Python rounds a quotient of whole numbers once, to the nearest even double
        return sign * (total / (1 << OFFSET))
    except OverflowError:
        return sign * float("inf")


def merged(partials: DataFrame) -> DataFrame:
    """Slice sums of all tasks: (key, n) with place NULL, else (key, place, d, v)."""
    counts = partials.where("place IS NULL").groupBy("key").agg(F.sum("n").alias("n"))
    cells = (partials.where("place IS NOT NULL").select("key", "place", F.posexplode("v").alias("d", "v"))
             .groupBy("key", "place", "d").agg(F.sum("v").alias("v")))
    return (counts.select("key", "n", F.lit(None).cast("int").alias("place"), F.lit(None).cast("int").alias("d"),
                          F.lit(None).cast("long").alias("v"))
            .unionByName(cells.select("key", F.lit(None).cast("long").alias("n"), "place", "d", "v")))


def _by_key(dims: int):
    """Rows (key, vector) to SLICES; rows without a whole finite vector count but add nothing."""
    def run(batches):
        import pyarrow as pa
        import pyarrow.compute as pc

        keys = np.zeros(0, np.int64)
        sums = ExactSums(0, dims)
        for rb in batches:
            col, key = rb.column(1), rb.column(0)
            have = key.is_valid().to_numpy(zero_copy_only=False)
            col, key = col.filter(pa.array(have)), key.filter(pa.array(have)).to_numpy(zero_copy_only=False)
            lengths = pc.list_value_length(col)
            ok = pc.fill_null(pc.equal(lengths, pa.scalar(dims, lengths.type)), False).to_numpy(zero_copy_only=False)
            x = np.zeros((len(key), dims))
            x[ok] = (col.filter(pa.array(ok)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
                     .reshape(-1, dims))
            x[~np.isfinite(x).all(axis=1)] = 0.0
            own, at = np.unique(key, return_inverse=True)
            if len(np.setdiff1d(own, keys)):
                if sums.groups * dims * (len(sums.places) + 1) > HELD_CELLS:
                    yield sums.rows(keys)
                    keys, sums = np.zeros(0, np.int64), ExactSums(0, dims)
                both = np.union1d(keys, own)
                grown = ExactSums(len(both), dims)
                to = np.searchsorted(both, keys)
                grown.n[to] = sums.n
                for p, v in sums.places.items():
                    grown.places[p] = np.zeros((len(both), dims), np.int64)
                    grown.places[p][to] = v
                keys, sums = both, grown
            sums.add(np.searchsorted(keys, own)[at], x)
        if len(keys):
            yield sums.rows(keys)

    return run


def _finish(dims: int, mean: bool):
    """Rows (key, n, cells: d, place, v) to (key, n, sums)."""
    def run(batches):
        import pyarrow as pa

        for rb in batches:
            out = []
            for n, cells in zip(rb.column(1).to_pylist(), rb.column(2).to_pylist(), strict=True):
                places: list[dict[int, int]] = [{} for _ in range(dims)]
                for c in cells or []:
                    places[c["d"]][c["place"]] = c["v"]
                sums = [rounded(p) for p in places]
                out.append([s / n for s in sums] if mean else sums)
            yield pa.RecordBatch.from_arrays([rb.column(0), rb.column(1), pa.array(out, pa.list_(pa.float64()))],
                                             names=["key", "n", "sums"])

    return run


def totals(partials: DataFrame, dims: int, mean: bool = False) -> DataFrame:
    """``(key, n, sums)`` of all tasks' slices, each sum rounded once."""
    # at most dims x places cells a key
    grouped = merged(partials).groupBy("key").agg(
        F.sum("n").alias("n"), F.collect_list(F.when(F.col("d").isNotNull(), F.struct("d", "place", "v"))).alias("cells"))
    return grouped.mapInArrow(_finish(dims, mean), "key long, n long, sums array<double>")


def collected(partials: DataFrame, dims: int) -> dict[int, tuple[int, np.ndarray]]:
    """Count and sums by key, on the driver as Arrow arrays; the caller bounds the number of keys."""
    out = {}
    for batch in totals(partials, dims).toArrow().to_batches():
        for i, (key, n) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)):
            out[key] = n, batch.column(2)[i].values.to_numpy()
    return out


def exact_vec_sum(df: DataFrame, key_col: str, features: str = "features", dims: int = 1, mean: bool = False) -> DataFrame:
    """Element-wise sum (or mean) by a whole-number key: ``(key, n, sums)``, the same bytes for any partitioning.

    Rows without key are left out; rows without a whole finite vector of
    ``dims`` elements count in ``n`` and add nothing.  Each task adds its rows
    up first, so a hot key sends a few rows a task; keys may be many.
    """
    rows = df.select(F.col(key_col).cast("long").alias("key"), F.col(features).cast("array<double>").alias("x"))
    return totals(rows.mapInArrow(_by_key(dims), SLICES), dims, mean)
