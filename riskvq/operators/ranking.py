"""Global positions and sorts without a single-partition window.

``Window.orderBy(...)`` with no partition moves every row into one task.
``with_position`` gives the same 1-based position with ranges of the sort key:

1. bounds of about equal ranges come from a small sample of the key columns;
   their number follows from the number of rows and is bounded, whatever the
   session's shuffle partitions;
2. the rows of each range are counted from the key columns alone, and the
   counts (one per range) are summed up to offsets;
3. the rows travel once, to their range, where a window numbers them.

Bounds and offsets are literals in the plan of step 3, so a recomputed task
finds the same ranges, and no copy of the table is kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Keys sampled per range: ranges come out even within some ten per cent.
SAMPLED_PER_RANGE = 100
# Rows of a range, and the least and most ranges; bounds are literals in the plan.
ROWS_PER_RANGE, LEAST_RANGES, MOST_RANGES = 200_000, 16, 1_024


def _c(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def _range_of(key: Column, bounds: list[Column]) -> Column:
    """Number of bounds that do not lie above the key, by nested halving."""
    def part(lo: int, hi: int) -> Column:
        if lo == hi:
            return F.lit(lo)
        mid = (lo + hi) // 2
        return F.when(key >= bounds[mid], part(mid + 1, hi)).otherwise(part(lo, mid))

    return part(0, len(bounds))


def with_position(df: DataFrame, order_cols, name: str = "pos", num_partitions: int | None = None) -> DataFrame:
    """Add ``name`` = 1-based position of the row in ``order_cols`` order.

    All orders ascend, NULLs first.  Ties must be broken by the caller (include
    a unique column last).
    """
    keys = df.select(F.struct(*[_c(c).alias(f"k{i}") for i, c in enumerate(order_cols)]).alias("_o"))
    n = keys.count()
    ranges = num_partitions or min(MOST_RANGES, max(LEAST_RANGES, -(-n // ROWS_PER_RANGE)))
    wanted = ranges * SAMPLED_PER_RANGE
    sample = keys if n <= wanted else keys.sample(False, min(1.0, 1.2 * wanted / n), 17)
    drawn = [r["_o"] for r in sample.orderBy("_o").limit(2 * wanted).collect()]  # a bounded number of keys
    types = keys.schema["_o"].dataType.fields
    cuts = [drawn[i * len(drawn) // ranges] for i in range(1, ranges)] if len(drawn) > ranges else drawn[1:]
    bounds = [F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(cut, types)]) for cut in cuts]
    placed = keys.select(_range_of(F.col("_o"), bounds).alias("_r"))
    counts = {r["_r"]: r["n"] for r in placed.groupBy("_r").agg(F.count(F.lit(1)).alias("n")).collect()}
    offsets, total = [], 0
    for i in range(len(bounds) + 1):
        offsets.append(total)
        total += counts.get(i, 0)
    order = F.struct(*[_c(c).alias(f"k{i}") for i, c in enumerate(order_cols)])
    ranged = df.withColumn("_o", order).withColumn("_r", _range_of(F.col("_o"), bounds))
    row = F.row_number().over(Window.partitionBy("_r").orderBy("_o"))
    offset = F.element_at(F.array(*[F.lit(o).cast("long") for o in offsets]), F.col("_r") + 1)
    return ranged.withColumn(name, (offset + row).cast("long")).drop("_o", "_r")


def _literal(value, data_type: T.DataType) -> Column:
    if isinstance(data_type, T.StructType):
        if value is None:
            return F.lit(None).cast(data_type)
        return F.struct(*[_literal(v, f.dataType).alias(f.name) for v, f in zip(value, data_type.fields)])
    return F.lit(value).cast(data_type)


def sort_by_first(df: DataFrame, col, id_col: str = "id", name: str = "pos") -> DataFrame:
    """Ascending sort on one column, ties by ``id_col`` (T1).

    Returns the rows with their position; empty input gives empty output.
    """
    return with_position(df, [_c(col), F.col(id_col)], name)


def sort_by_label(df: DataFrame, label_col: str = "label", id_col: str = "id", name: str = "pos") -> DataFrame:
    """Ascending sort by class, any row width, ties by ``id_col`` (T2)."""
    return with_position(df, [F.col(label_col), F.col(id_col)], name)
