"""Operator 8: sharding by jump consistent hashing (law ``key``).

The shard of a row depends on its doc_id and the number of shards alone: when
one shard is appended, the only rows that move are those that move into it.
Slots number the rows of a shard without gaps.

Cases: a NULL text has size 1 and checksum 0; rows without doc_id share one
fixed key; rows that repeat an id stay in its shard and get slots of their own.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.functions import pandas_udf

from riskvq.llm.common import checkpointed, mix64

NULL_KEY = -1
BUCKETS = 4096   # sub-buckets of all shards, for the slots
CHUNK = 100_000  # equal rows that one task numbers at a time


def jump_hash(keys: np.ndarray, shards: int) -> np.ndarray:
    """Jump consistent hash (Lamping and Veach) of unsigned 64-bit keys."""
    key = keys.astype(np.uint64)
    b = np.full(len(key), -1, np.int64)
    j = np.zeros(len(key), np.int64)
    live = np.ones(len(key), bool)
    while live.any():
        b[live] = j[live]
        with np.errstate(over="ignore"):
            key[live] = key[live] * np.uint64(2862933555777941757) + np.uint64(1)
        j[live] = ((b[live] + 1) * (float(1 << 31) / ((key[live] >> np.uint64(33)).astype(np.float64) + 1))).astype(np.int64)
        live = j < shards
    return b


def shard_of(doc_id: pd.Series, shards: int) -> pd.Series:
    return pd.Series(jump_hash(mix64(doc_id.to_numpy(np.int64).astype(np.uint64)), shards).astype(np.int32))


def spread(rows: DataFrame, first: Column, n: Column, name: str) -> DataFrame:
    """Each row ``n`` times, numbered from ``first``; many equal rows are dealt to many tasks, CHUNK at a time."""
    chunks = rows.select("*", first.alias("_a"), (first + n).alias("_z")).select(
        "*", F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("_z") - F.col("_a") - 1) / CHUNK))).alias("_k"))
    low = F.col("_a") + F.col("_k") * CHUNK
    # without a key: what one row holds is spread over all tasks
    return (chunks.select(*rows.columns, low.alias("_a"), F.least(low + CHUNK, F.col("_z")).alias("_z"))
            .repartition(max(1, int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
            .select(*rows.columns, F.explode(F.sequence(F.col("_a"), F.col("_z") - 1)).alias(name)))


def assign_shards(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Per row: doc_id, size, text_crc32, law, shard, slot and grown_shard (with one shard more).

    Slots follow (sub-bucket, doc_id, checksum, size).  Each shard is cut into
    sub-buckets by a hash of all that is known of the row; counts per sub-bucket
    (at most 2 x BUCKETS rows) are summed up to offsets and joined back, so no
    task holds a shard.  Rows equal in all of these travel as one row and a count,
    and are numbered in pieces by many tasks.
    """
    @pandas_udf("shard int, grown_shard int")
    def both(x: pd.Series) -> pd.DataFrame:
        return pd.DataFrame({"shard": shard_of(x, shards), "grown_shard": shard_of(x, shards + 1)})

    raw = F.coalesce(F.col("text"), F.lit("")).cast("binary")
    rows = docs.select(
        "doc_id", (F.octet_length(F.coalesce(F.col("text"), F.lit(""))) + 1).cast("bigint").alias("size"),
        F.crc32(raw).cast("bigint").alias("text_crc32"))
    key = F.coalesce(F.col("doc_id"), F.lit(NULL_KEY).cast("bigint"))
    rows = rows.select("*", both(key).alias("_both")).select("doc_id", "size", "text_crc32", "_both.*")
    same = ["shard", "doc_id", "text_crc32", "size"]
    rows = checkpointed(rows.groupBy(*same, "grown_shard").agg(F.count("*").alias("_n")))
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("doc_id", "text_crc32", "size"),
                                             F.lit(max(1, BUCKETS // shards))).cast("int"))
    offsets = (rows.groupBy("shard", "_bucket").agg(F.sum("_n").alias("_m"))
               .withColumn("_before", F.sum("_m").over(Window.partitionBy("shard").orderBy("_bucket")) - F.col("_m"))
               .select("shard", "_bucket", "_before"))
    w = Window.partitionBy("shard", "_bucket").orderBy(F.col("doc_id").asc_nulls_first(), "text_crc32", "size")
    rows = rows.withColumn("_own", F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_n"))
    # at most BUCKETS rows
    rows = rows.join(F.broadcast(offsets), ["shard", "_bucket"])
    first = F.col("_before") + F.col("_own")
    rows = rows.select("doc_id", "size", "text_crc32", "shard", "grown_shard", first.alias("_first"), "_n")
    return spread(rows, F.col("_first"), F.col("_n"), "slot").select(
        "doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")


def write_shards(docs: DataFrame, path: str, shards: int = 8) -> None:
    """Write the documents as Parquet, one folder per shard."""
    @pandas_udf("int")
    def now(x: pd.Series) -> pd.Series:
        return shard_of(x, shards)

    key = F.coalesce(F.col("doc_id"), F.lit(NULL_KEY).cast("bigint"))
    docs.withColumn("shard", now(key)).write.partitionBy("shard").parquet(path)
