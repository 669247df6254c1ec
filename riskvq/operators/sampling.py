"""Counting, sampling, limits, shuffles, splits and bags (SP1-SP11).

Every draw is keyed on the row id through ``draw_key`` (``replicable``
mode, SP11): the same seed selects the same rows whatever the partitioning,
executor count or retry history, and draws of different purposes (or with
different salts) are independent of each other.  Spark's own ``sample``/``randomSplit`` are
exposed too, but they change with the partitioning.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from riskvq.functions.keys import draw_key, key_below
from riskvq.operators.ranking import with_position


def row_count(df: DataFrame) -> DataFrame:
    """One row ``n`` (SP1); partial counts per task, one tiny shuffle."""
    return df.agg(F.count(F.lit(1)).alias("n"))


def bernoulli_sample(df: DataFrame, fraction: float, seed: int, id_col: str = "id",
                     replicable: bool = True, salt: str = "") -> DataFrame:
    """Sample without replacement (SP2).

    Keyed: keep rows whose seeded key falls below ``fraction``; a pure filter,
    no shuffle, identical under any partitioning.  ``replicable=False`` uses
    Spark's partition-dependent sampler instead.
    """
    if not replicable:
        return df.sample(False, min(max(fraction, 0.0), 1.0), seed)
    return df.where(key_below(draw_key(id_col, seed, "sample", salt), fraction))


def _smallest_keys(df: DataFrame, key: Column, n: int, rows: int, slack_sd: float = 8.0) -> DataFrame:
    """The rows of ``df`` (``rows`` of them) that can be among the ``n`` with the smallest key.

    A key threshold is sized for ``n`` plus ``slack_sd`` standard deviations;
    one count checks it, and a larger one is taken in the rare case that it
    leaves too few rows, so the result always holds the ``n`` smallest.
    """
    if n >= rows:
        return df
    fraction = (n + slack_sd * n ** 0.5 + 16.0) / rows
    while fraction < 1.0:
        below = df.where(key_below(key, fraction))
        if below.count() >= n:
            return below
        fraction *= 4
    return df


def limit_n(df: DataFrame, n: int, seed: int | None = None, id_col: str = "id",
            order_by: list | None = None, pos_col: str = "pos", salt: str = "", purpose: str = "limit") -> DataFrame:
    """First ``n`` rows in a stated order with their 1-based position (SP3).

    Order is ``order_by`` if given, else the seeded key (a random but
    replicable choice).  Only about ``n`` rows reach the task that ranks them:
    a key threshold (seeded draws) or the exact n-th smallest id (order by a
    numeric id) filters the scan first.  Any other order is a top-n per task
    and a merge of at most ``tasks x n`` rows.
    """
    if order_by is None:
        key = draw_key(id_col, seed, purpose, salt)
        order = [key, F.col(id_col)]
        df = _smallest_keys(df, key, n, df.count())
    else:
        order = [F.col(c) if isinstance(c, str) else c for c in order_by] + [F.col(id_col)]
        if order_by == [id_col] and dict(df.dtypes).get(id_col) in NUMERIC:
            ids = df.where(F.col(id_col).isNotNull()).count()
            if 0 < n < ids:  # NULL ids sort first: they stay
                df = df.where(F.col(id_col).isNull() | (F.col(id_col) <= F.lit(kth_smallest(df, id_col, n, n=ids))))
    keyed = df.withColumn("_o", F.struct(*order))
    top = keyed.orderBy("_o").limit(n)
    # The window below sees at most n rows: the limit is the feature.
    return top.withColumn(pos_col, F.row_number().over(Window.orderBy("_o")).cast("long")).drop("_o")


NUMERIC = ("bigint", "int", "smallint", "tinyint", "double", "float")


def usable_codes(df: DataFrame) -> DataFrame:
    """Rows that can become code vectors: a label and a feature vector without NULL, NaN or infinite elements."""
    whole = F.forall("features", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return df.where(F.col("label").isNotNull() & F.col("features").isNotNull() & (F.size("features") > 0) & whole)


def _as_codebook(df: DataFrame, code_id: Column) -> DataFrame:
    return df.select(code_id.cast("long").alias("code_id"), F.col("label").cast("int").alias("code_label"),
                     F.col("features").alias("w"))


def init_codebook_sampled(df: DataFrame, n: int, seed: int, id_col: str = "id", salt: str = "") -> DataFrame:
    """``n`` seeded random rows become code vectors with their labels (SP4).

    Exactly ``n`` usable rows (or all of them if fewer); no oversampling.
    """
    return _as_codebook(limit_n(usable_codes(df), n, seed, id_col, salt=salt, purpose="init"), F.col("pos"))


def init_codebook_first(df: DataFrame, n: int, id_col: str = "id", order_by: list | None = None) -> DataFrame:
    """The first ``n`` usable rows in ``order_by`` (default id) become codes (SP5).

    The chosen rows stay in the data; this only reads it.
    """
    return _as_codebook(limit_n(usable_codes(df), n, id_col=id_col, order_by=order_by or [id_col]), F.col("pos"))


def class_quota_offsets(per_class: dict[int, int]) -> dict[int, int]:
    """code_id offset of each class: classes in ascending order, ids from 1."""
    offsets, total = {}, 0
    for label in sorted(per_class):
        offsets[label] = total
        total += int(per_class[label])
    return offsets


def init_codebook_per_class(df: DataFrame, per_class: dict[int, int], seed: int, id_col: str = "id",
                            slack_sd: float = 8.0, salt: str = "") -> DataFrame:
    """``per_class[c]`` seeded rows of each class become codes (SP6).

    Class ``c`` contributes its ``per_class[c]`` usable rows with the smallest
    ``(md5(seed:init:id), id)``; ``code_id`` = offset of the class + rank inside
    the class, classes in ascending order.

    Exact without sorting the table: per-class row counts (one aggregate)
    give a key threshold per class far above the quota (``slack_sd``
    standard deviations); only rows under it are ranked.  One more aggregate
    checks that no class falls short, and a class that does gets a larger
    threshold.  A hot class costs the same as any other.
    """
    quotas = {int(k): int(v) for k, v in per_class.items() if int(v) > 0}
    if not quotas:
        return _as_codebook(df.limit(0), F.lit(0))
    offsets = class_quota_offsets(quotas)
    mine = usable_codes(df).where(F.col("label").isin(list(quotas)))
    sizes = {r["label"]: r["n"] for r in mine.groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
    fractions = {c: (1.0 if sizes.get(c, 0) == 0 else
                     min(1.0, (q + slack_sd * q ** 0.5 + 16.0) / sizes[c])) for c, q in quotas.items()}
    key = draw_key(id_col, seed, "init", salt)

    def below(classes: dict[int, float]) -> Column:
        cond = None
        for c, f in classes.items():
            term = (F.col("label") == F.lit(c)) & key_below(key, f)
            cond = term if cond is None else cond | term
        return cond

    while any(f < 1.0 for f in fractions.values()):
        got = {r["label"]: r["n"] for r in
               mine.where(below(fractions)).groupBy("label").agg(F.count(F.lit(1)).alias("n")).collect()}
        short = [c for c in quotas if got.get(c, 0) < min(quotas[c], sizes.get(c, 0))]
        if not short:
            break
        fractions.update({c: min(1.0, 4 * fractions[c]) for c in short})
    quota = offset = None
    for label in sorted(quotas):
        cond = F.col("label") == F.lit(label)
        quota = F.when(cond, F.lit(quotas[label])) if quota is None else quota.when(cond, F.lit(quotas[label]))
        offset = F.when(cond, F.lit(offsets[label])) if offset is None else offset.when(cond, F.lit(offsets[label]))
    w = Window.partitionBy("label").orderBy(key, F.col(id_col))
    ranked = (mine.where(below(fractions)).withColumn("_rn", F.row_number().over(w))
              .where(F.col("_rn") <= F.lit(max(quotas.values())))
              .where(F.col("_rn") <= quota))
    return _as_codebook(ranked, offset + F.col("_rn"))


def kth_smallest(df: DataFrame, col: str, k: int, rel_error: float = 1e-3, n: int | None = None) -> object:
    """Exact ``k``-th smallest (1-based) non-null value of a numeric column
    with unique values, reading only that column.

    ``approxQuantile`` brackets the answer (its rank error is at most
    ``rel_error * n``, and the brackets are taken at twice that distance);
    one count places the lower bracket, and only the rows between the
    brackets (about ``4 * rel_error`` of the table) are ranked exactly.
    """
    ids = df.select(F.col(col).alias("_v")).where(F.col("_v").isNotNull())
    n = ids.count() if n is None else n  # non-null count, if the caller has it
    if not 1 <= k <= n:
        raise ValueError(f"k={k} outside 1..{n}")
    if k == 1:
        return ids.agg(F.min("_v")).collect()[0][0]
    q = k / n
    lo, hi = ids.approxQuantile("_v", [max(0.0, q - 2 * rel_error), min(1.0, q + 2 * rel_error)], rel_error)
    inside = (F.col("_v") >= F.lit(lo)) & (F.col("_v") <= F.lit(hi))
    below, within = ids.agg(F.count_if(F.col("_v") < F.lit(lo)), F.count_if(inside)).collect()[0]
    band = ids.where(inside)
    if not below < k <= below + within:
        band, below = ids, 0  # brackets missed (not expected): rank everything
    hit = with_position(band, [F.col("_v")], "_r").where(F.col("_r") == F.lit(k - below)).collect()
    return hit[0]["_v"]


def split_by_position(df: DataFrame, pct: int, id_col: str = "id", order_by: list | None = None,
                      part_col: str = "part") -> DataFrame:
    """First ``rows * pct // 100`` rows (by ``order_by``, default id) are
    ``train``, the rest ``test`` (SP7).  64-bit arithmetic throughout.

    By a numeric id (the usual case) the split is one cutoff value found by
    ``kth_smallest`` from the id column alone, and the result is a plain
    filter: no shuffle of the table.  Other orders rank every row with
    ``with_position``.
    """
    numeric = dict(df.dtypes).get(id_col) in NUMERIC
    if order_by is None and numeric:
        n = df.where(F.col(id_col).isNotNull()).count()
        k = n * int(pct) // 100
        if k <= 0:
            return df.withColumn(part_col, F.lit("test"))
        cutoff = kth_smallest(df, id_col, k, n=n) if k < n else None
        train = F.lit(True) if cutoff is None else F.col(id_col) <= F.lit(cutoff)
        return df.withColumn(part_col, F.when(train, F.lit("train")).otherwise(F.lit("test")))
    order = [F.col(c) if isinstance(c, str) else c for c in (order_by or [])] + [F.col(id_col)]
    ranked = with_position(df, order, "_pos")
    cut = df.count() * int(pct) // 100
    return (ranked.withColumn(part_col, F.when(F.col("_pos") <= F.lit(cut), F.lit("train"))
                              .otherwise(F.lit("test")))
            .drop("_pos"))


def split_random(df: DataFrame, pct: float, seed: int, id_col: str = "id", part_col: str = "part",
                 replicable: bool = True, salt: str = "") -> DataFrame:
    """Seeded random split: about ``pct`` percent ``train`` (SP8).

    A keyed filter: no shuffle, same parts under any partitioning.  Splitting
    a part again needs a ``salt`` (or another seed) of its own.  With
    ``replicable=False`` Spark's ``randomSplit`` semantics are used.
    """
    if not replicable:
        tr, te = df.randomSplit([pct, 100.0 - pct], seed)
        return tr.withColumn(part_col, F.lit("train")).unionByName(te.withColumn(part_col, F.lit("test")))
    inside = key_below(draw_key(id_col, seed, "split", salt), pct / 100.0)
    return df.withColumn(part_col, F.when(inside, F.lit("train")).otherwise(F.lit("test")))


def train_test(split: DataFrame, part_col: str = "part") -> tuple[DataFrame, DataFrame]:
    return (split.where(F.col(part_col) == "train").drop(part_col),
            split.where(F.col(part_col) == "test").drop(part_col))


def split_sizes(split: DataFrame, part_col: str = "part") -> DataFrame:
    """Rows per part (E4)."""
    return split.groupBy(part_col).agg(F.count(F.lit(1)).alias("n"))


def shuffle_rows(df: DataFrame, seed: int, id_col: str = "id", pos_col: str = "pos", salt: str = "") -> DataFrame:
    """Seeded uniform permutation: every row with its new position (SP9)."""
    return with_position(df, [draw_key(id_col, seed, "shuffle", salt), F.col(id_col)], pos_col)


# Above this many rows a bag draw ranks with the distributed position
# operator instead of one top-n task (same order, same bags).
MAX_TOP_ROWS = 100_000


def draw_bags(df: DataFrame, n_bags: int, bag_size: int, seed: int, id_col: str = "id",
              first_bag: int = 1, slack_sd: float = 8.0, salt: str = "") -> DataFrame:
    """``n_bags`` bags of ``bag_size`` rows: mini-batches of one seeded
    shuffle (SP10).

    Rows are ordered by ``(md5(seed:bag:id), id)``.
    Bag ``first_bag + i`` holds positions ``i*bag_size .. (i+1)*bag_size - 1``
    of that order; past the last row the order starts again, so bags never
    repeat a row (when ``bag_size <= rows``) and consecutive bags are
    disjoint until the table is used up.

    One md5 per row, no sort of the table.  Only the first
    ``total = n_bags * bag_size`` positions matter: with ``N`` rows (one
    count), rows whose key lies above a threshold sized for ``total`` plus
    ``slack_sd`` standard deviations cannot be among them and are dropped in
    the scan.  The survivors (about ``total`` rows) are ranked by one bounded
    top-n task up to ``MAX_TOP_ROWS``, beyond that by the distributed position
    operator.
    """
    total = int(n_bags) * int(bag_size)
    key = draw_key(id_col, seed, "bag", salt)
    n = df.count()
    if n == 0 or total == 0:
        return df.select(*df.columns, F.lit(0).alias("bag"), F.lit(0).cast("long").alias("pos")).limit(0)
    cand = _smallest_keys(df, key, total, n, slack_sd).withColumn("_o", F.struct(key.alias("k"), F.col(id_col).alias("i")))
    if total <= MAX_TOP_ROWS:
        top = cand.orderBy("_o").limit(total)
        # The window sees at most ``total`` rows (bounded by the parameters).
        ranked = top.select("*", (F.row_number().over(Window.orderBy("_o")) - 1).alias("_p"))
    else:
        ranked = (with_position(cand, ["_o.k", "_o.i"], "_p1").where(F.col("_p1") <= F.lit(total))
                  .withColumn("_p", F.col("_p1") - 1).drop("_p1"))
    m = min(n, total)
    slot = F.explode(F.sequence(F.col("_p").cast("long"), F.lit(total - 1).cast("long"),
                                F.lit(m).cast("long"))).alias("_slot")
    out = ranked.select(*df.columns, slot)
    return out.select(*df.columns,
                      (F.floor(F.col("_slot") / F.lit(bag_size)) + F.lit(first_bag)).cast("int").alias("bag"),
                      (F.col("_slot") % F.lit(bag_size) + F.lit(1)).cast("long").alias("pos"))
