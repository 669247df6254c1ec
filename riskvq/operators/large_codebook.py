"""Nearest codes in a codebook of any size (M1, T3, M7).

A codebook that one task should not hold is cut into parts of at most
``PART_CELLS`` numbers, in the order of ``code_id``.  Parts are written once to
the shared checkpoint folder, one row each, and pass the driver one at a time.
Each part is one map-only pass over the rows: the kernel lets its codes compete
with the k best of the passes before, which the rows carry as a list (distance,
code).  So the rows never meet two parts in one task, nothing is shuffled, and
the last list is the same as that of the whole codebook; ties go to the lower
``code_id`` as everywhere.  A pass costs codes x rows distances at most (a tree
over the part's codes spares many), which far outweighs reading and writing the
rows, so rows are simply written between passes.
"""

from __future__ import annotations

import sys
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from riskvq.operators.code_tree import CodeTree, no_codes
from riskvq.operators.codebook import MAX_CELLS, MAX_CODES
from riskvq.operators.ranking import with_position
from riskvq.session import ensure_checkpoint_dir

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # executors need numpy and pyarrow, not this package

PART_CELLS = MAX_CELLS
ROWS_AT_ONCE = 8_192

NEAREST = "array<struct<d2:double,code_id:bigint,code_label:int>>"


@dataclass
class CodeParts:
    """A codebook ``(code_id, code_label, w)`` left as a DataFrame, with its size."""

    codes: DataFrame
    k: int
    dims: int
    part_cells: int = PART_CELLS

    @classmethod
    def of(cls, codes: DataFrame, part_cells: int = PART_CELLS) -> "CodeParts":
        bad = (F.col("code_id").isNull() | F.col("code_label").isNull() | F.col("w").isNull()
               | F.exists("w", lambda x: x.isNull()))
        meta = codes.agg(F.count(F.lit(1)).alias("k"), F.min(F.size("w")).alias("least"), F.max(F.size("w")).alias("d"),
                         F.count_if(bad).alias("bad")).collect()[0]
        if meta["bad"]:
            raise ValueError("a code without id, label or whole vector")
        if meta["least"] != meta["d"]:
            raise ValueError(f"code vectors of unequal width: {meta['least']} to {meta['d']}")
        return cls(codes, int(meta["k"]), int(meta["d"] or 0), part_cells)

    def too_large(self) -> bool:
        return self.k > MAX_CODES or self.k * self.dims > self.part_cells


PACKED = "part bigint, ids binary, labels binary, w binary"


def _pack(dims: int):
    """Rows (part, code_id, code_label, w) sorted by the first two to one row a part."""
    def packed(part, held):
        import pyarrow as pa

        ids, labels, w = (np.concatenate(c) for c in zip(*held, strict=True))
        return pa.RecordBatch.from_arrays(
            [pa.array([part], pa.int64()), *[pa.array([c.tobytes()], pa.binary()) for c in (ids, labels, w)]],
            names=["part", "ids", "labels", "w"])

    def run(batches):
        part, held = None, []
        for rb in batches:
            parts, ids = rb.column(0).to_numpy(), rb.column(1).to_numpy()
            labels = rb.column(2).to_numpy().astype(np.int64)
            w = rb.column(3).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)
            cuts = [0, *(np.flatnonzero(np.diff(parts)) + 1).tolist(), len(parts)]
            for a, b in zip(cuts[:-1], cuts[1:]):
                if a == b:
                    continue
                if held and parts[a] != part:
                    yield packed(part, held)
                    held = []
                part = int(parts[a])
                held.append((ids[a:b], labels[a:b], w[a:b]))
        if held:
            yield packed(part, held)

    return run


def _matrix(column, dims: int):
    """Features as a matrix, and which rows have ``dims`` finite ones."""
    import pyarrow as pa
    import pyarrow.compute as pc

    lengths = pc.list_value_length(column)
    ok = pc.fill_null(pc.equal(lengths, pa.scalar(dims, lengths.type)), False).to_numpy(zero_copy_only=False)
    x = np.zeros((len(column), dims))
    whole = column if ok.all() else column.filter(pa.array(ok))
    x[ok] = whole.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False).reshape(-1, dims)
    finite = np.isfinite(x).all(axis=1)
    x[~finite] = 0.0
    return x, ok & finite


def _part_kernel(ids: np.ndarray, labels: np.ndarray, w: np.ndarray, k: int, within_class: bool, keep: list[str],
                 features: str, first: bool):
    """One pass: the codes of a part compete with each row's ``nearest`` list so far."""
    groups = [np.flatnonzero(labels == c) for c in np.unique(labels)] if within_class else [np.arange(len(ids))]
    trees = [(labels[g[0]] if within_class else None, g, CodeTree(ids[g], w[g])) for g in groups]

    def run(batches):
        import pyarrow as pa

        code_type = pa.struct([("d2", pa.float64()), ("code_id", pa.int64()), ("code_label", pa.int32())])
        for batch in batches:
            for s in range(0, batch.num_rows, ROWS_AT_ONCE):
                rb = batch.slice(s, ROWS_AT_ONCE)
                x, ok = _matrix(rb.column(features), w.shape[1])
                n = len(x)
                dist, best, places = no_codes(n, k)
                lab = np.zeros((n, k), np.int64)
                if not first:
                    had = rb.column("nearest")
                    size = np.diff(had.offsets.to_numpy())
                    row = np.repeat(np.arange(n), size)
                    slot = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
                    flat = had.flatten()
                    dist[row, slot] = flat.field("d2").to_numpy(zero_copy_only=False)
                    best[row, slot] = flat.field("code_id").to_numpy(zero_copy_only=False)
                    lab[row, slot] = flat.field("code_label").to_numpy(zero_copy_only=False)
                lr = rb.column("label").cast(pa.float64()).to_numpy(zero_copy_only=False) if within_class else None
                for label, group, tree in trees:
                    rows = np.flatnonzero(ok if label is None else ok & (lr == label))
                    d, b, p = dist[rows], best[rows], places[rows]
                    held = lab[rows]
                    # places of codes found before are marked by their slot below -1, to bring their labels along
                    p[:] = -2 - np.arange(k)
                    tree.search(x[rows], d, b, p)
                    old = p < 0
                    dist[rows], best[rows] = d, b
                    lab[rows] = np.where(old, np.take_along_axis(held, np.where(old, -2 - p, 0), axis=1),
                                         labels[group][np.where(old, 0, p)])
                found = np.isfinite(dist) & ok[:, None]
                offsets = np.concatenate([[0], np.cumsum(found.sum(axis=1))]).astype(np.int32)
                items = pa.StructArray.from_arrays(
                    [pa.array(dist[found]), pa.array(best[found]), pa.array(lab[found].astype(np.int32))],
                    fields=list(code_type))
                out = [rb.column(c) for c in keep] + [pa.ListArray.from_arrays(pa.array(offsets), items)]
                yield pa.RecordBatch.from_arrays(out, names=[*keep, "nearest"])

    return run


def nearest_in_parts(df: DataFrame, parts: CodeParts, k: int, within_class: bool = False, features: str = "features",
                     keep: list[str] | None = None) -> DataFrame:
    """The columns of ``keep`` and ``nearest``: the k closest codes, ascending ``(d2, code_id)``.

    Rows without whole finite features of the codes' width have an empty list.
    """
    spark = df.sparkSession
    keep = df.columns if keep is None else keep
    if "nearest" in df.columns:
        raise ValueError("the rows already have a column nearest")
    if not parts.k:
        return df.select(*keep, F.array().cast(NEAREST).alias("nearest"))
    folder = f"{ensure_checkpoint_dir(spark)}/codes-{uuid.uuid4().hex}"
    per_part = max(1, min(MAX_CODES, parts.part_cells // max(1, parts.dims)))
    codes = parts.codes.select(F.col("code_id").cast("bigint").alias("code_id"), F.col("code_label").cast("int"),
                               F.col("w").cast("array<double>"))
    (with_position(codes, ["code_id"]).withColumn("part", F.expr(f"(pos - 1) div {per_part}"))
     .select("part", "code_id", "code_label", "w").repartition("part").sortWithinPartitions("part", "code_id")
     .mapInArrow(_pack(parts.dims), PACKED).write.parquet(f"{folder}/codes"))
    packed = spark.read.parquet(f"{folder}/codes")
    n_parts = -(-parts.k // per_part)
    fields = {f.name: f for f in df.schema.fields}
    carried = list(dict.fromkeys([*keep, features, *(["label"] if within_class else [])]))
    nearest = T.StructField("nearest", T.ArrayType(T.StructType([
        T.StructField("d2", T.DoubleType()), T.StructField("code_id", T.LongType()),
        T.StructField("code_label", T.IntegerType())])))
    rows = df.select(*carried)
    for turn in range(n_parts):
        part = packed.where(F.col("part") == turn).collect()[0]  # one part at a time
        ids, labels = (np.frombuffer(part[c], np.int64) for c in ("ids", "labels"))
        w = np.frombuffer(part["w"], np.float64).reshape(len(ids), -1)
        last = turn == n_parts - 1
        out = list(keep) if last else carried
        kernel = _part_kernel(ids, labels, w, k, within_class, out, features, turn == 0)
        rows = rows.mapInArrow(kernel, T.StructType([fields[c] for c in out] + [nearest]))
        if not last:
            rows.write.parquet(f"{folder}/{turn}")
            rows = spark.read.parquet(f"{folder}/{turn}")
    return rows
