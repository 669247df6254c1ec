"""Operator 13: how quality filters interact, by the Hart-Mas-Colell potential.

A document's failures form a set of filters.  The game of a part gives each
coalition of filters the number of documents that it removes, that is, those
that fail one of its filters.  The potential of a coalition follows from those
of the coalitions with one filter less:

    P(S) = (v(S) + sum of P(S without i) over i in S) / |S|,   P(none) = 0

and a filter's Shapley value is P(all) - P(all without it).  Filters in a given
order remove v(S with i) - v(S) documents at the step that adds i to S.  So one
pass over the texts gives each document its set, one aggregate counts the sets
of each part, and 32 coalitions per part tell all 120 orders.  Potentials are
carried times 120, which keeps them whole numbers.

Cases: a NULL text is empty (it fails A alone, and E after a smaller id with an
empty text); rows without doc_id fail no comparison of ids, stand before no
other and have no labels; rows that share a doc_id count one by one and are not
smaller than each other; a NULL source is the empty string; a document is good
or toxic if any of its label rows says so; other columns are not read; an empty
table has no parts.
"""

from __future__ import annotations

import hashlib
import re
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import arrow_rows, checkpointed, ddl, map_texts, settled

FILTERS = "ABCDE"
# what the filters compare with
LEAST_WORDS = 200
DISTINCT_PERCENT = 50
CAPITAL_PERCENT = 2
CAPITALS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ"
MARKS = rb"[#$%&*|]"

FIELDS = [("part", "string"), ("filter_order", "string"), ("step", "int"), ("kept", "bigint"), ("removed", "bigint"),
          ("redundant", "bigint"), ("unique_fails", "bigint"), ("good_lost", "bigint"), ("toxic_lost", "bigint"),
          ("shapley", "bigint")]


def _make_failures():
    mark = re.compile(MARKS)

    def of_text(text):
        raw = text.encode("utf-8", "surrogatepass")
        words = raw.split()
        failed = (len(words) < LEAST_WORDS) * 1
        failed |= (100 * len(set(words)) < DISTINCT_PERCENT * len(words)) * 2
        failed |= (100 * (len(raw) - len(raw.translate(None, CAPITALS))) > CAPITAL_PERCENT * len(text)) * 4
        failed |= (mark.search(raw) is not None) * 8
        return failed, hashlib.sha256(raw).digest()

    return of_text


def failures(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Per document: part, failed (bit k: filter k of FILTERS), good, toxic.  Only ids and digests are shuffled."""
    sources = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text",
                          F.coalesce(F.col("source").cast("string"), F.lit("")).alias("part"))
    own = checkpointed(map_texts(sources, _make_failures, [("failed", "int"), ("digest", "binary")],
                                 carry=("doc_id", "part")))
    # aggregates that are joined back are kept apart, so that Spark can split the joins at a hot text or id
    repeated = settled(own.where(F.col("doc_id").isNotNull()).groupBy("digest")
                       .agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"))
                       .where("first < last").select("digest", "first"))
    marked = settled(labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("bigint").alias("doc_id"))
                     .agg(F.max((F.col("quality") == 1).cast("int")).alias("good"),
                          F.max((F.col("toxic") == 1).cast("int")).alias("toxic"))
                     .where("good = 1 OR toxic = 1"))
    copied = F.coalesce(F.col("doc_id") > F.col("first"), F.lit(False)).cast("int") * 16
    return (own.join(repeated, "digest", "left").join(marked, "doc_id", "left")
            .select("part", (F.col("failed") + copied).alias("failed"),
                    F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic")))


def games(counts: np.ndarray) -> np.ndarray:
    """Documents that each coalition removes, from counts by exact set of failures: (..., 2^n) to (..., 2^n)."""
    size = counts.shape[-1]
    sets = np.arange(size)
    return counts @ ((sets[:, None] & sets[None, :]) != 0).astype(np.int64)


def potentials(game: np.ndarray) -> np.ndarray:
    """n! times the potential of each coalition of a game (..., 2^n), from that of smaller coalitions."""
    size = game.shape[-1]
    n = size.bit_length() - 1
    whole = int(np.prod(np.arange(1, n + 1)))
    out = np.zeros_like(game)
    for s in range(1, size):  # the subsets of s are smaller numbers
        members = [s ^ (1 << i) for i in range(n) if s >> i & 1]
        out[..., s] = (whole * game[..., s] + out[..., members].sum(axis=-1)) // len(members)
    return out


def steps(n: int = len(FILTERS)) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
    """Every order, and for each of its steps: number, filter, coalition before."""
    orders, number, member, before = [], [], [], []
    for order in permutations(range(n)):
        done = 0
        for k, i in enumerate(order):
            orders.append("".join(FILTERS[j] for j in order))
            number.append(k + 1)
            member.append(i)
            before.append(done)
            done |= 1 << i
    return orders, np.array(number), np.array(member), np.array(before)


def _audit(batches):
    """Rows (part, sets: failed, n, good, toxic) to one row per order and step."""
    orders, number, member, before = steps()
    after, full, size = before | (1 << member), 2 ** len(FILTERS) - 1, 2 ** len(FILTERS)
    for batch in batches:
        for part, sets in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            counts = np.zeros((3, size), np.int64)
            for s in sets:
                counts[:, s["failed"]] += s["n"], s["good"], s["toxic"]
            game = games(counts)
            docs, good, toxic = game
            potential = potentials(docs)
            shapley = potential[full] - potential[full ^ (1 << np.arange(len(FILTERS)))]
            removed = docs[after] - docs[before]
            yield arrow_rows([[part] * len(orders), orders, number.tolist(), (counts[0].sum() - docs[after]).tolist(),
                              removed.tolist(), (docs[1 << member] - removed).tolist(),
                              (docs[full] - docs[full ^ (1 << member)]).tolist(), (good[after] - good[before]).tolist(),
                              (toxic[after] - toxic[before]).tolist(), shapley[member].tolist()], FIELDS)


def audit_filters(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """FIELDS for every source, order of the filters and step; ``shapley`` is summed over all orders."""
    sets = (failures(docs, labels).groupBy("part", "failed")
            .agg(F.count("*").alias("n"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic")))
    # at most 32 sets a part
    parts = sets.groupBy("part").agg(F.collect_list(F.struct("failed", "n", "good", "toxic")).alias("sets"))
    return parts.mapInArrow(_audit, ddl(FIELDS))
