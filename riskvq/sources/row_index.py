"""A row number for tables without an id (SP11).

Every seeded draw is keyed on an id.  A table that has none gets one from where
its rows lie: Parquet knows the number of a row in its file, and files, in order
of their paths, follow each other.  The number depends on the files alone, not
on how Spark cuts them into tasks, so draws keyed on it repeat.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Paths that are joined by broadcast; a table of more files is joined by shuffle.
BROADCAST_FILES = 50_000


def with_row_index(files: DataFrame, name: str = "row_index") -> DataFrame:
    """Add ``name``: the 0-based number of the row in all files of a Parquet table, files in order of path.

    ``files`` is ``spark.read.parquet(...)`` as it comes.  Rows per file are
    counted without reading a column; the counts, one number a file of those the
    driver has listed anyway, are summed up there.
    """
    if name in files.columns:
        raise ValueError(f"the table already has a column {name}")
    counts = files.groupBy(F.col("_metadata.file_path").alias("_file")).agg(F.count(F.lit(1)).alias("n"))
    starts, total = [], 0
    for r in sorted(counts.collect(), key=lambda r: r["_file"]):
        starts.append((r["_file"], total))
        total += r["n"]
    located = files.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.row_index").alias("_row"))
    if len(starts) <= 1:
        return located.select(*files.columns, F.col("_row").alias(name))
    offsets = files.sparkSession.createDataFrame(starts, "_file string, _start long")
    if len(starts) <= BROADCAST_FILES:
        offsets = F.broadcast(offsets)
    return located.join(offsets, "_file").select(*files.columns, (F.col("_start") + F.col("_row")).alias(name))
