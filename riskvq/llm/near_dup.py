"""Operator 10: near-duplicate documents by a chosen-path set similarity join.

A document's set is that of its 5-word shingles (64-bit hashes of whole words);
documents of equal sets form one class, whose smallest id stands for it.  Each
class has a sketch of minwise hashes.  A tree sends every class down one or two
randomly chosen sketch coordinates of a node to the child named by its value
there, so classes stay together with a chance that grows with their similarity;
nodes of at most NODE classes compare all their sketches, larger ones branch
again, and what keeps most of its parent, or is still together after DEPTH
levels, is taken as a candidate group.  With TREES independent trees a link of similarity 0.85 is missed with a
chance under 0.01 even if it never leaves large nodes (0.15 ** TREES if its
first node is small).  Candidate groups (joined over all trees) are then compared
on full sets until every link is found or lies inside a component.  Members of a
large group that stay outside its main component are first parted by their
rarest shingles, of which linked sets share one, so a group of texts that follow
one template and never link is not compared all with all.

Cases: documents without words, or without text, have an empty set, are linked
with nothing and kept; with fewer than five words the whole sequence is the
one shingle.  What is linked are rows: a row has the set of its own text and
the links of that set, and its component_id is the smallest doc_id of the rows
that these links reach; rows that share a doc_id but not a text are not linked
by the id.  Rows without doc_id are linked with nothing, have no component and
are kept.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from riskvq.llm.common import annotated, arrow_rows, checkpointed, ddl, forget, map_texts, mix64, settled
from riskvq.llm.graph import components, local_roots, runs
from riskvq.session import ensure_checkpoint_dir

SHINGLE = 5
PERCENT = 85
TREES, DEPTH, NODE = 10, 6, 256
DENSE = 0.6             # share of its parent from which on a large node is a candidate group
COORDINATES = 64
MIN_AGREE = 40          # of COORDINATES: five standard deviations below similarity 0.85
BRANCH = 100 / PERCENT  # expected children of a class in a node
BLOCK_ROWS, BLOCK_SHINGLES = 512, 400_000
PIVOTS = 16             # members of a large group that every block of it is compared with
WORDS_KEPT = 200_000    # words whose hashes a Python worker remembers

_ODD = mix64(np.arange(1, 2 * COORDINATES + 1, dtype=np.uint64)) | np.uint64(1)
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class WordHashes(dict):
    """64-bit hash by word; emptied when full."""

    def __missing__(self, word: bytes) -> int:
        import xxhash

        if len(self) >= WORDS_KEPT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def shingles(text: str, hashes: WordHashes, size: int = SHINGLE) -> np.ndarray:
    """The sorted distinct shingle hashes of a text."""
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    h = np.fromiter(map(hashes.__getitem__, words), np.uint64, len(words))
    k = min(size, len(words))
    with np.errstate(over="ignore"):
        out = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            out = (out + h[i:len(words) - k + 1 + i]) * _MULTIPLIER
    return np.unique(mix64(out))


def sketch(values: np.ndarray) -> np.ndarray:
    """Per coordinate the minwise hash of the set, its low half."""
    out = np.empty(COORDINATES, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(COORDINATES):
            out[i] = ((values ^ _ODD[i]) * _ODD[COORDINATES + i]).min()
    return mix64(out).astype(np.uint32)


def _make_features():
    import xxhash

    forget()
    hashes = WordHashes()

    def of_text(text):
        s = shingles(text, hashes)
        if not len(s):
            return 0, None, None
        return len(s), xxhash.xxh3_128_digest(s.tobytes()), sketch(s).tobytes()

    return of_text


def branches(node: np.ndarray, sketches: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Child nodes of rows in their nodes: (row index, child key).  Equal nodes choose equal coordinates."""
    with np.errstate(over="ignore"):
        h = mix64(node + np.uint64(0x51ED27))
        first = (h % np.uint64(COORDINATES)).astype(np.int64)
        second = ((first + 1 + ((h >> np.uint64(16)) % np.uint64(COORDINATES - 1)).astype(np.int64)) % COORDINATES)
        again = (h >> np.uint64(32)).astype(np.float64) / 2**32 < BRANCH - 1
        rows, keys = [], []
        for chosen, which in ((first, np.ones(len(node), bool)), (second, again)):
            i = np.flatnonzero(which)
            value = sketches[i, chosen[i]].astype(np.uint64)
            rows.append(i)
            keys.append(mix64(node[i] * _MULTIPLIER + mix64(value + (chosen[i].astype(np.uint64) << np.uint64(32)))))
    return np.concatenate(rows), np.concatenate(keys)


def _sketches(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint32).reshape(-1, COORDINATES)


def _first_branch(batches):
    """Rows (id, sketch) to (node, id), for each tree."""
    for b in batches:
        if not b.num_rows:
            continue
        ids, s = b.column(0).to_numpy(), _sketches(b.column(1))
        for tree in range(TREES):
            at, keys = branches(np.full(len(ids), mix64(np.array([tree + 1], np.uint64))[0]), s)
            yield arrow_rows([keys.view(np.int64).tolist(), ids[at].tolist()], [("node", "bigint"), ("id", "bigint")])


def _next_branch(batches):
    """Rows (node, id, n, sketch) to (node, id) of the children and the size n of their parent."""
    for b in batches:
        if b.num_rows:
            at, keys = branches(b.column(0).to_numpy().view(np.uint64), _sketches(b.column(3)))
            yield arrow_rows([keys.view(np.int64).tolist(), b.column(1).to_numpy()[at].tolist(),
                              b.column(2).to_numpy()[at].tolist()],
                             [("node", "bigint"), ("id", "bigint"), ("above", "bigint")])


def _compare_sketches(batches):
    """Rows (node, id, sketch) sorted by node to edges from each id to the smallest of its candidate group."""
    a_ids, b_ids = [], []
    for _, (ids, raw) in runs(batches, 1):
        s = np.frombuffer(b"".join(raw), np.uint32).reshape(-1, COORDINATES)
        left, right = [], []
        for i in range(len(ids) - 1):
            j = np.flatnonzero((s[i + 1:] == s[i]).sum(axis=1) >= MIN_AGREE) + i + 1
            if len(j):
                left.append(np.full(len(j), i))
                right.append(j)
        if left:
            root = local_roots(len(ids), np.concatenate(left), np.concatenate(right))
            for i in np.flatnonzero(root != np.arange(len(ids))):
                a_ids.append(ids[i])
                b_ids.append(ids[root[i]])
        if len(a_ids) >= 20_000:
            yield arrow_rows([a_ids, b_ids], EDGE)
            a_ids, b_ids = [], []
    if a_ids:
        yield arrow_rows([a_ids, b_ids], EDGE)


EDGE = [("a", "bigint"), ("b", "bigint")]


def candidate_edges(reps: DataFrame) -> DataFrame:
    """Edges that join every candidate group of (id, sketch) rows."""
    rows = reps.mapInArrow(_first_branch, "node bigint, id bigint").withColumn("above", F.lit(None).cast("bigint"))
    found, n_reps = [], reps.count()
    for level in range(1, DEPTH + 1):
        # kept apart from the rows' own aggregate, so that Spark can split the join at a large node
        sizes = settled(rows.groupBy("node").agg(F.count("*").alias("n"), F.min("id").alias("least")).where("n > 1"))
        rows = settled(rows.join(sizes, "node"))
        small = rows.where(F.col("n") <= NODE).select("node", "id").join(reps, "id").select("node", "id", "sketch")
        found.append(small.repartition("node").sortWithinPartitions("node")
                     .mapInArrow(_compare_sketches, "a bigint, b bigint"))
        # a node that keeps most of its parent holds copies of one text: branching would not part them
        whole = F.lit(level == DEPTH) | F.coalesce(F.col("n") >= DENSE * F.col("above"), F.lit(False))
        found.append(rows.where((F.col("n") > NODE) & whole).select(F.col("id").alias("a"), F.col("least").alias("b")))
        large = rows.where((F.col("n") > NODE) & ~whole)
        ids = settled(large.select("id").distinct())
        n_ids = ids.count()
        if not n_ids:
            break
        if 2 * n_ids <= n_reps:  # from here on only these classes branch: the other sketches stay where they are
            reps, n_reps = settled(reps.join(ids, "id", "left_semi")), n_ids
        rows = (large.select("node", "id", "n").join(reps, "id").select("node", "id", "n", "sketch")
                .mapInArrow(_next_branch, "node bigint, id bigint, above bigint"))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out


def _intersections(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections, by matrix products over the shingles that two sets share."""
    n = len(sets)
    owner = np.repeat(np.arange(n), [len(s) for s in sets])
    _, code, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    shared = count[code] > 1
    owner, code = owner[shared], np.cumsum(count > 1)[code[shared]] - 1
    out = np.zeros((n, n), np.float32)
    order = np.argsort(code, kind="stable")
    owner, code = owner[order], code[order]
    step = max(256, 4_000_000 // max(1, n))
    for low in range(0, int(code[-1]) + 1 if len(code) else 0, step):
        i, j = np.searchsorted(code, (low, low + step))
        m = np.zeros((n, min(step, int(code[-1]) + 1 - low)), np.float32)
        m[owner[i:j], code[i:j] - low] = 1
        out += m @ m.T
    return out


def _verify(across: bool):
    """Rows (grp, x, y, side, id, text) sorted by the first three to edges of true links, one star per component.

    ``across`` compares rows of different sides only, else all rows of a (grp, x, y)."""
    def run(batches):
        hashes = WordHashes()
        a_ids, b_ids = [], []
        for _, (side, ids, sets) in _as_sets(batches, hashes):
            inter = _intersections(sets)
            size = np.array([len(s) for s in sets], np.float64)
            linked = 100.0 * inter >= PERCENT * (size[:, None] + size[None, :] - inter)
            if across:
                side = np.array(side)
                linked &= side[:, None] != side[None, :]
            i, j = np.nonzero(np.triu(linked, 1))
            if len(i):
                root = local_roots(len(ids), i, j)
                for k in np.flatnonzero(root != np.arange(len(ids))):
                    a_ids.append(ids[k])
                    b_ids.append(ids[root[k]])
            if len(a_ids) >= 20_000:
                yield arrow_rows([a_ids, b_ids], EDGE)
                a_ids, b_ids = [], []
        if a_ids:
            yield arrow_rows([a_ids, b_ids], EDGE)

    return run


def _as_sets(batches, hashes):
    """Groups of ``runs`` with texts turned into sets as they arrive; a text of another set of its doc_id is left out."""
    import pyarrow as pa
    import xxhash

    def convert():
        for b in batches:
            for start in range(0, b.num_rows, 256):
                part = b.slice(start, 256)
                sets = [shingles(t, hashes).tobytes() for t in part.column(5).to_pylist()]
                own = pa.array([xxhash.xxh3_128_digest(s) == sig
                                for s, sig in zip(sets, part.column(6).to_pylist(), strict=True)], pa.bool_())
                yield pa.RecordBatch.from_arrays([*part.columns[:5], pa.array(sets, pa.binary())],
                                                 names=["g", "x", "y", "side", "id", "s"]).filter(own)

    for key, (side, ids, raw) in runs(convert(), 3):
        yield key, (side, ids, [np.frombuffer(r, np.uint64) for r in raw])


def _prefixes(batches):
    """Rows (grp, x, y, side, id, text, sig) sorted by the first three to (bucket, id, outside): the rarest shingles.

    ``side`` adds 1 for a pivot of another block, 2 for one of this block and 4
    for members outside the main component.  Shingles are ordered by the number
    of the group's pivots that have them, then by hash: one order for the whole
    group.  Sets of similarity PERCENT share at least PERCENT of either set, so
    the first of their common shingles is among the 100 - PERCENT percent (and
    one) that come first in each.
    """
    import pyarrow as pa

    out, size = [], 0
    for (grp, *_), (side, ids, sets) in _as_sets(batches, WordHashes()):
        side = np.array(side)
        among = [sets[i] for i in np.flatnonzero(side & 3)]
        common, count = np.unique(np.concatenate([np.zeros(0, np.uint64), *among]), return_counts=True)
        salt = mix64(np.array([grp], np.int64).view(np.uint64))
        for i in np.flatnonzero(side & 1 == 0):
            s = sets[i]
            at = np.minimum(np.searchsorted(common, s), max(0, len(common) - 1))
            seen = np.where(common[at] == s, count[at], 0) if len(common) else np.zeros(len(s), np.int64)
            first = np.argsort(seen, kind="stable")[:len(s) + 1 - -(-PERCENT * len(s) // 100)]
            out.append((mix64(s[first] ^ salt).view(np.int64), np.full(len(first), ids[i]),
                        np.full(len(first), bool(side[i] & 4))))
            size += len(first)
            if size >= 100_000:
                yield arrow_rows([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], PREFIX)
                out, size = [], 0
    if out:
        yield arrow_rows([pa.array(np.concatenate(c)) for c in zip(*out, strict=True)], PREFIX)


PREFIX = [("bucket", "bigint"), ("id", "bigint"), ("outside", "boolean")]


def parted(held: DataFrame, rest: DataFrame, wide: DataFrame) -> DataFrame:
    """(id, grp): members of the groups ``wide`` that may link with one of ``rest``, in smaller groups.

    Members that share one of their rarest shingles stay together, if one of
    them is in ``rest``; no link between a member of ``rest`` and another is lost.
    """
    rows = (held.join(wide.select("grp"), "grp").join(rest.select("grp", "id", F.lit(4).alias("out")), ["grp", "id"], "left")
            .withColumns({"out": F.coalesce("out", F.lit(0)), "pivot": _is_pivot()}))
    own = rows.withColumns({"x": F.col("block"), "y": F.col("block"), "side": F.col("out") + F.when(F.col("pivot"), 2).otherwise(0)})
    guests = (rows.where("pivot").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
              .where(F.col("x") != F.col("block")).withColumns({"y": F.col("x"), "side": F.lit(1)}))
    prefixes = checkpointed(_dealt(own.unionByName(guests)).mapInArrow(_prefixes, ddl(PREFIX)))
    shared = settled(prefixes.groupBy("bucket").agg(F.count("*").alias("k"), F.min("id").alias("least"),
                                                    F.max("outside").alias("outside")).where("k > 1 AND outside"))
    return components(prefixes.join(shared.select("bucket", "least"), "bucket")
                      .select(F.col("id").alias("a"), F.col("least").alias("b"))).withColumnRenamed("component", "grp")


def _is_pivot():
    return F.pmod(F.xxhash64(F.lit("pivot"), "id"), F.col("m")) < PIVOTS


def _dealt(rows: DataFrame) -> DataFrame:
    return (rows.select("grp", "x", "y", "side", "id", "text", "sig").repartition("grp", "x", "y")
            .sortWithinPartitions("grp", "x", "y", "id"))


def _blocks(rows: str, shingles: str):
    return F.greatest(F.ceil(F.col(rows) / BLOCK_ROWS), F.ceil(F.col(shingles) / BLOCK_SHINGLES)).cast("int")


def _ids_repeat(docs: DataFrame) -> bool:
    ids = docs.select("doc_id").where("doc_id IS NOT NULL")
    counts = ids.groupBy("doc_id").count().where("count > 1")
    return counts.limit(1).count() > 0


def verified_edges(docs: DataFrame, members: DataFrame) -> DataFrame:
    """True links among members (id, rep, sig, n, grp), as star edges that join what is linked.

    The text of class ``id`` is that of the row ``rep`` of docs (doc_id, text)
    whose set has the signature ``sig``.

    Groups of bounded rows and shingles are compared whole.  A larger group is
    cut into blocks of that size; each block is compared whole together with
    about PIVOTS members of the group, which usually joins nearly all of it.
    Only what is then outside the group's largest component still needs
    comparing with the others, block against block; two members of one
    component are not compared again.  Where that is more than a block, the
    group is first parted by rarest shingles (``parted``).
    """
    folder = f"{ensure_checkpoint_dir(docs.sparkSession)}/near-dup-{uuid.uuid4().hex}"
    # aggregates that are joined back are kept apart, so that Spark can split the joins at a large group
    sizes = settled(members.groupBy("grp").agg(F.count("*").alias("m"), F.sum("n").alias("s")).where("m > 1")
                         .select("grp", "m", _blocks("m", "s").alias("b")))
    placed = members.join(sizes, "grp").select(
        "grp", "b", "m", "id", "rep", "sig", "n", F.pmod(F.xxhash64("id"), F.col("b")).cast("int").alias("block"))
    texts = docs.select(F.col("doc_id").cast("bigint").alias("rep"), "text").where(
        F.col("rep").isNotNull() & F.col("text").isNotNull())
    if _ids_repeat(docs):  # one row for each text of an id
        texts = texts.groupBy("rep", F.sha2("text", 256).alias("_h")).agg(F.min("text").alias("text")).drop("_h")
    texts.join(placed.hint("shuffle_hash"), "rep").write.parquet(f"{folder}/texts")
    held = docs.sparkSession.read.parquet(f"{folder}/texts")

    def compared(rows: DataFrame, across: bool) -> DataFrame:
        return _dealt(rows).mapInArrow(_verify(across), "a bigint, b bigint")

    own = held.withColumns({"x": F.col("block"), "y": F.col("block"), "side": F.lit(0)})
    pivots = (held.where((F.col("b") > 1) & _is_pivot())
              .withColumn("x", F.explode(F.sequence(F.lit(0), F.col("b") - 1)))
              .where(F.col("x") != F.col("block")).withColumns({"y": F.col("x"), "side": F.lit(0)}))
    edges = settled(compared(own.unionByName(pivots), False))

    held = held.where("b > 1")  # the groups compared whole are done: none of their texts is dealt out again
    large = held.select("grp", "id", "n", "b").distinct()
    if not large.limit(1).count():
        return edges
    at = large.join(components(edges), "id", "left").select(
        "grp", "id", "n", "b", F.coalesce("component", "id").alias("c"))
    main = settled(at.groupBy("grp", "c").agg(F.count("*").alias("k"))
                        .groupBy("grp").agg(F.max(F.struct("k", "c")).alias("top")).select("grp", "top.c"))
    rest = settled(at.join(main.withColumnRenamed("c", "main"), "grp").where(F.col("c") != F.col("main"))
                        .select("grp", "id", "n"))

    def crossed(held: DataFrame, rest: DataFrame, counts: DataFrame) -> DataFrame:
        every = (held.join(counts, "grp").withColumn("x", F.explode(F.sequence(F.lit(0), F.col("b2") - 1)))
                 .withColumns({"y": F.col("block"), "side": F.lit(0)}))
        outside = (held.join(rest.select("grp", "id"), ["grp", "id"]).join(counts, "grp")
                   .withColumns({"x": F.pmod(F.xxhash64(F.lit("rest"), "id"), F.col("b2")).cast("int"), "side": F.lit(1)})
                   .withColumn("y", F.explode(F.sequence(F.lit(0), F.col("b") - 1))))
        columns = ["grp", "x", "y", "side", "id", "text", "sig"]
        return compared(every.select(*columns).unionByName(outside.select(*columns)), True)

    def blocks_of(rest: DataFrame) -> DataFrame:
        return settled(rest.groupBy("grp").agg(F.count("*").alias("m2"), F.sum("n").alias("s2"))
                       .select("grp", _blocks("m2", "s2").alias("b2")))

    counts = blocks_of(rest)
    edges = edges.unionByName(crossed(held, rest, counts.where("b2 = 1")))
    wide = counts.where("b2 > 1")
    if not wide.limit(1).count():
        return edges
    groups = settled(parted(held, rest, wide))
    rest = settled(rest.join(wide.select("grp"), "grp").drop("grp").join(groups, "id"))
    sizes = settled(held.select("id", "n").distinct().join(groups, "id").groupBy("grp")
                    .agg(F.count("*").alias("m"), F.sum("n").alias("s")).select("grp", _blocks("m", "s").alias("b")))
    held = (held.drop("grp", "b", "m", "block").join(groups, "id").join(sizes, "grp")
            .withColumn("block", F.pmod(F.xxhash64("id"), F.col("b")).cast("int")))
    return edges.unionByName(crossed(held, rest, blocks_of(rest)))


def _placed(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, text_hash, n_shingles, root, component_id.

    ``root`` names the component among all rows, also where two components have
    the same smallest doc_id; NULL for rows that can have no link.
    """
    named = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    features = checkpointed(map_texts(named, _make_features,
                                      [("n_shingles", "bigint"), ("sig", "binary"), ("sketch", "binary")],
                                      carry=("doc_id", "text_hash")))
    # a class has a number of its own: two sets of one doc_id are two classes
    classes = checkpointed(features.where(F.col("doc_id").isNotNull() & F.col("sig").isNotNull())
                           .groupBy("sig", "sketch").agg(F.min(F.col("doc_id").cast("bigint")).alias("rep"),
                                                         F.first("n_shingles").alias("n"))
                           .withColumn("id", F.monotonically_increasing_id()))
    groups = components(candidate_edges(classes.select("id", "sketch")))
    members = classes.select("id", "rep", "sig", "n").join(groups.select("id", F.col("component").alias("grp")), "id")
    linked = settled(components(verified_edges(docs, members)))
    least = settled(linked.join(classes.select("id", "rep"), "id").groupBy("component").agg(F.min("rep").alias("least")))
    of_class = (classes.select("sig", "id", "rep").join(linked.join(least, "component"), "id", "left")
                .select("sig", F.coalesce("component", "id").alias("root"), F.coalesce("least", "rep").alias("least")))
    out = features.select("doc_id", "text_hash", "n_shingles", "sig").join(settled(of_class), "sig", "left")
    has = F.col("doc_id").isNotNull()
    return out.select("doc_id", "text_hash", "n_shingles", F.when(has, F.col("root")).alias("root"),
                      F.when(has, F.coalesce("least", "doc_id")).alias("component_id"))


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """The documents kept: one of each component (the smallest id, of its texts the one of the smallest hash).

    Rows equal in id and text count once; documents without words are all kept.
    """
    rows = checkpointed(_placed(docs).where(F.col("root").isNotNull()).select("doc_id", "text_hash", "root"))
    first = settled(rows.groupBy("root").agg(F.min(F.struct("doc_id", "text_hash")).alias("first")))
    gone = (rows.join(first, "root").where(F.struct("doc_id", "text_hash") != F.col("first"))
            .select("doc_id", F.col("text_hash").alias("_h")).distinct())

    def keep(d, _):
        own = F.when(F.col("doc_id").isNull(), F.monotonically_increasing_id())  # rows without id are never equal
        return (d.withColumns({"_h": F.xxhash64("text"), "_own": own}).join(gone, ["doc_id", "_h"], "left_anti")
                .dropDuplicates(["doc_id", "_h", "_own"]))

    out, columns = annotated(docs, keep)
    return out.select(*columns)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """Per row of (doc_id, text): doc_id, n_shingles, component_id, kept."""
    component = F.col("component_id")
    return _placed(docs).select("doc_id", "n_shingles", "component_id",
                                F.coalesce(component == F.col("doc_id"), F.lit(True)).alias("kept"))
