"""Connected components of a graph given as edges, by alternating star steps."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import settled


def components(edges: DataFrame) -> DataFrame:
    """(id, component): every node that has an edge (a, b), with the smallest id it reaches.

    Edges point from the larger id to the smaller.  A step first hands each
    node the smallest neighbour of its neighbour, then makes all smaller
    neighbours of a node children of the smallest; each step is a few joins and
    aggregates of edges, checkpointed, until all edges form stars.
    """
    e = (edges.where(F.col("a") != F.col("b"))
         .select(F.greatest("a", "b").alias("hi"), F.least("a", "b").alias("lo")).distinct())
    e = settled(e)
    while True:
        # kept apart from the edges, so that Spark can split the joins at a hub
        low = settled(e.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m"), F.count("*").alias("n")))
        # a star: every node has one smaller neighbour, which has none
        deeper = e.select(F.col("lo").alias("k")).join(low, "k", "left_semi").limit(1).count()
        if not deeper and not low.where("n > 1").limit(1).count():
            break
        e = (e.join(low.select("k", "m"), F.col("lo") == F.col("k"), "left")
             .select("hi", F.coalesce("m", "lo").alias("lo")).distinct())
        low = e.groupBy(F.col("hi").alias("k")).agg(F.min("lo").alias("m"))
        j = e.join(low, F.col("hi") == F.col("k"))
        e = (j.where(F.col("lo") != F.col("m")).select(F.col("lo").alias("hi"), F.col("m").alias("lo"))
             .unionByName(low.select(F.col("k").alias("hi"), F.col("m").alias("lo"))).distinct())
        e = settled(e)
    roots = e.select(F.col("lo").alias("id")).distinct()
    return (e.select(F.col("hi").alias("id"), F.col("lo").alias("component"))
            .unionByName(roots.select("id", F.col("id").alias("component"))))


def local_roots(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For n nodes with edges a[i]-b[i]: the smallest node that each one reaches."""
    root = np.arange(n)
    while len(a):
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        new = new[new]
        while (new[new] != new).any():
            new = new[new]
        if (new == root).all():
            break
        root = new
    return root


def runs(batches, width: int) -> Iterator[tuple[tuple, list[list]]]:
    """Groups of consecutive rows equal in the first ``width`` columns: the key and the other columns.

    Rows arrive sorted by the key; a group may span batches, and one group is held at a time.
    """
    key, rest = None, None
    for batch in batches:
        columns = [c.to_pylist() for c in batch.columns]
        keys = list(zip(*columns[:width], strict=True))
        start = 0
        for i in range(1, len(keys) + 1):
            if i == len(keys) or keys[i] != keys[start]:
                piece = [c[start:i] for c in columns[width:]]
                if keys[start] == key:
                    for have, more in zip(rest, piece, strict=True):
                        have.extend(more)
                else:
                    if key is not None:
                        yield key, rest
                    key, rest = keys[start], piece
                start = i
    if key is not None:
        yield key, rest
