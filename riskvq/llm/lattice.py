"""Operator 9: near-duplicate embeddings by E8 lattice hashing.

Equal vectors of a label form one class.  Each of TABLES random projections maps
a unit vector to eight dimensions and decodes it to the nearest E8 lattice point;
the label and that point name its cell, and the PROBES lattice neighbours whose
cells are nearest are probed too.  Classes that meet in a cell, one of them at
home there, are compared, large cells block against block: first by SIGNS signs
of random projections, which travel as a few bytes; then those with a partner
that may be near by cosine in double precision.  A pair that meets in several cells is counted in the first one
only, which both vectors' cells tell without a shuffle of pairs.

Cases: vectors that are NULL, empty, zero or hold NULL or non-finite components,
and rows without label or vec_id, link with nothing and are kept; vectors of
different widths never link; rows that repeat a vec_id count as rows of their own.
"""

from __future__ import annotations

from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import arrow_rows, checkpointed, mix64
from riskvq.llm.graph import components, local_roots, runs

COSINE = 0.93
TABLES, PROBES, SCALE = 5, 8, 0.75  # a pair of cosine 0.93 is missed with a chance of about 0.0003
BLOCK = 1024
# Signs of random projections, and the most that differ at COSINE: five standard deviations above the mean of 30.6.
SIGNS, MOST_DIFFERENT = 256, 57


def minimal_vectors() -> np.ndarray:
    """The 240 shortest vectors of E8: two entries of one, or all halves with an even number of minus signs."""
    out = []
    for i, j in combinations(range(8), 2):
        for a, b in product((1, -1), repeat=2):
            v = np.zeros(8)
            v[i], v[j] = a, b
            out.append(v)
    out += [np.array(s) / 2 for s in product((1, -1), repeat=8) if np.prod(s) > 0]
    return np.stack(out)


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """Nearest integer points of even sum."""
    r = np.rint(x)
    odd = np.flatnonzero(r.sum(axis=1).astype(np.int64) & 1)
    if len(odd):
        d = x[odd] - r[odd]
        worst = np.abs(d).argmax(axis=1)
        r[odd, worst] += np.where(d[np.arange(len(odd)), worst] >= 0, 1, -1)
    return r


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """Nearest E8 lattice points (Conway and Sloane): the better of D8 and D8 shifted by a half."""
    a, b = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - a) ** 2).sum(axis=1) <= ((x - b) ** 2).sum(axis=1)
    return np.where(closer[:, None], a, b)


def projection(table: int, width: int) -> np.ndarray:
    return np.random.default_rng([913, table, width]).normal(0, SCALE, (width, 8))


def signs(units: np.ndarray) -> np.ndarray:
    """SIGNS signs of random projections of unit vectors, as bits."""
    width = units.shape[1]
    return np.packbits(units @ np.random.default_rng([914, width]).normal(size=(width, SIGNS)) > 0, axis=1)


def cells(units: np.ndarray, labels: np.ndarray, tables: int = TABLES, probes: int = PROBES) -> np.ndarray:
    """Keys (rows, tables, 1 + probes): the home cell first, then the probed neighbours."""
    n, width = units.shape
    near = minimal_vectors()
    odd = mix64(np.arange(8, dtype=np.uint64) + np.uint64(77)) | np.uint64(1)
    out = np.empty((n, tables, 1 + probes), np.uint64)

    def key(points, table):
        with np.errstate(over="ignore"):
            twice = np.rint(points * 2).astype(np.int64).astype(np.uint64)
            base = mix64(labels.astype(np.int64).astype(np.uint64) + np.uint64((table << 40) + (width << 8)))
            return mix64((twice * odd).sum(axis=1, dtype=np.uint64) ^ base)

    for t in range(tables):
        x = units @ projection(t, width)
        home = nearest_e8(x)
        out[:, t, 0] = key(home, t)
        if probes:
            toward = (x - home) @ near.T
            best = np.argpartition(-toward, probes - 1, axis=1)[:, :probes]
            for p in range(probes):
                out[:, t, 1 + p] = key(home + near[best[:, p]], t)
    return out


def first_meeting(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The one cell that counts a pair: of the first table where they meet; a is the vector of the smaller id.

    a and b: (pairs, tables, 1 + probes).  Zero where they do not meet.
    """
    out = np.zeros(len(a), np.uint64)
    todo = np.ones(len(a), bool)
    for t in range(a.shape[1]):
        at_a = todo & (b[:, t] == a[:, t, :1]).any(axis=1)          # b is at home in, or probes, a's cell
        at_b = todo & ~at_a & (a[:, t] == b[:, t, :1]).any(axis=1)
        out[at_a], out[at_b] = a[at_a, t, 0], b[at_b, t, 0]
        todo &= ~(at_a | at_b)
    return out


def unit(raw: np.ndarray) -> np.ndarray:
    """Rows scaled to length one, safe for very large and small components."""
    x = raw / np.abs(raw).max(axis=1, keepdims=True)
    return x / np.linalg.norm(x, axis=1, keepdims=True)


def _hash_vectors(batches):
    """Rows (id, label, v) to (id, unit vector, cell keys), both as bytes."""
    for b in batches:
        ids, labels, vectors = (c.to_pylist() for c in b.columns)
        by_width: dict[int, list[int]] = {}
        for i, v in enumerate(vectors):
            by_width.setdefault(len(v), []).append(i)
        for at in by_width.values():
            u = unit(np.array([vectors[i] for i in at], float))
            c = cells(u, np.array([labels[i] for i in at]))
            yield arrow_rows([[ids[i] for i in at], [r.tobytes() for r in u], [r.tobytes() for r in c],
                              [r.tobytes() for r in signs(u)]],
                             [("id", "bigint"), ("u", "binary"), ("cells", "binary"), ("signs", "binary")])


def _cell_rows(batches):
    """Rows (id, cells) to (cell, id, home)."""
    for b in batches:
        if b.num_rows:
            c = np.frombuffer(b"".join(b.column(1).to_pylist()), np.int64).reshape(b.num_rows, TABLES, 1 + PROBES)
            home = np.zeros(c.shape, bool)
            home[:, :, 0] = True
            ids = np.repeat(b.column(0).to_numpy(), TABLES * (1 + PROBES))
            yield arrow_rows([c.ravel(), ids, home.ravel()], [("cell", "bigint"), ("id", "bigint"), ("home", "boolean")])


def _meeting(block, home, x, y) -> np.ndarray:
    """Which pairs of a cell are compared: one of them is at home there, and of two blocks one is in each."""
    pairs = np.triu(home[:, None] | home[None, :], 1)
    if x != y:
        pairs &= block[:, None] != block[None, :]
    return pairs


def _may_link(batches):
    """Rows (cell, x, y, block, id, home, signs) sorted by the first three: those with a partner that may be near."""
    fields = [("cell", "bigint"), ("x", "int"), ("y", "int"), ("block", "int"), ("id", "bigint"), ("home", "boolean")]
    for (cell, x, y), (block, ids, home, raw) in runs(batches, 3):
        if len(ids) < 2:
            continue
        block, ids, home = (np.array(c) for c in (block, ids, home))
        bits = np.unpackbits(np.frombuffer(b"".join(raw), np.uint8).reshape(len(ids), -1), axis=1).astype(np.float32)
        ones = bits.sum(axis=1)
        different = ones[:, None] + ones[None, :] - 2 * (bits @ bits.T)
        near = _meeting(block, home, x, y) & (different <= MOST_DIFFERENT)
        used = np.flatnonzero(near.any(axis=0) | near.any(axis=1))
        if len(used):
            yield arrow_rows([[cell] * len(used), [x] * len(used), [y] * len(used), block[used].tolist(), ids[used].tolist(),
                              home[used].tolist()], fields)


def _compare(batches):
    """Rows (cell, x, y, block, id, home, m, u, cells) sorted by the first three to (id, links, root)."""
    fields = [("id", "bigint"), ("links", "bigint"), ("root", "bigint")]
    for (cell, x, y), (block, ids, home, m, u, own) in runs(batches, 3):
        if len(ids) < 2:
            continue
        order = np.argsort(ids, kind="stable")
        ids, m, block, home = (np.array(c)[order] for c in (ids, m, block, home))
        vectors = np.stack([np.frombuffer(u[i], np.float64) for i in order])
        linked = (vectors @ vectors.T >= COSINE) & _meeting(block, home, x, y)
        i, j = np.nonzero(linked)
        if not len(i):
            continue
        keys = np.stack([np.frombuffer(own[k], np.uint64) for k in order]).reshape(len(ids), TABLES, 1 + PROBES)
        links = np.zeros(len(ids), np.int64)
        here = np.int64(cell).astype(np.uint64)
        for s in range(0, len(i), 200_000):
            a, b = i[s:s + 200_000], j[s:s + 200_000]
            first = first_meeting(keys[a], keys[b]) == here
            np.add.at(links, a[first], m[b[first]])
            np.add.at(links, b[first], m[a[first]])
        root = ids[local_roots(len(ids), i, j)]
        used = np.flatnonzero((links > 0) | (root != ids))
        if len(used):
            yield arrow_rows([ids[used], links[used], root[used]], fields)


def link_embeddings(vectors: DataFrame) -> DataFrame:
    """Per row of (vec_id, embedding, label): vec_id, n_links, component_id, kept."""
    rows = vectors.select("vec_id", "label", F.col("embedding").cast("array<double>").alias("v"))
    usable = (F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("v").isNotNull()
              & F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
              & F.exists("v", lambda x: x != 0))
    rows = rows.withColumn("_usable", F.coalesce(usable, F.lit(False)))
    classes = (rows.where("_usable").groupBy("label", "v")
               .agg(F.min(F.col("vec_id").cast("bigint")).alias("id"), F.count("*").alias("m")))
    hashed = checkpointed(classes.join(
        classes.select("id", "label", "v").mapInArrow(_hash_vectors, "id bigint, u binary, cells binary, signs binary"), "id"))
    at = hashed.select("id", "cells").mapInArrow(_cell_rows, "cell bigint, id bigint, home boolean")
    sizes = (at.groupBy("cell").agg(F.count("*").alias("n"), F.max("home").alias("any"))
             .where("n > 1 and any").select("cell", F.ceil(F.col("n") / BLOCK).cast("int").alias("b")))
    placed = (at.join(sizes, "cell")
              .withColumn("block", F.pmod(F.xxhash64("id"), F.col("b")).cast("int"))
              .withColumn("o", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
              .select("cell", F.least("block", "o").alias("x"), F.greatest("block", "o").alias("y"), "block", "id",
                      "home"))
    key = ["cell", "x", "y"]
    placed = (placed.join(hashed.select("id", "signs"), "id").select(*key, "block", "id", "home", "signs")
              .repartition(*key).sortWithinPartitions(*key)
              .mapInArrow(_may_link, "cell bigint, x int, y int, block int, id bigint, home boolean"))
    compared = checkpointed(
        placed.join(hashed.select("id", "m", "u", "cells"), "id")
        .select("cell", "x", "y", "block", "id", "home", "m", "u", "cells")
        .repartition(*key).sortWithinPartitions(*key)
        .mapInArrow(_compare, "id bigint, links bigint, root bigint"))
    links = compared.groupBy("id").agg(F.sum("links").alias("links"))
    linked = components(compared.select(F.col("id").alias("a"), F.col("root").alias("b")))
    of_class = (hashed.select("label", "v", "id", "m").join(links, "id", "left").join(linked, "id", "left")
                .select("label", "v", (F.col("m") - 1 + F.coalesce("links", F.lit(0))).alias("n"),
                        F.coalesce("component", "id").alias("component")))
    out = rows.where("_usable").join(of_class, ["label", "v"], "left").select(
        "vec_id", F.coalesce("n", F.lit(0)).cast("bigint").alias("n_links"), F.col("component").alias("component_id"))
    out = out.unionByName(rows.where("not _usable").select(
        "vec_id", F.lit(0).cast("bigint").alias("n_links"), F.col("vec_id").cast("bigint").alias("component_id")))
    return out.withColumn("kept", F.coalesce(F.col("component_id") == F.col("vec_id"), F.lit(True)))
