"""Helpers shared by the operators of this package."""

from __future__ import annotations

import gc
import hashlib
import sys
import types
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskvq.session import ensure_checkpoint_dir

ARROW = {
    "bigint": pa.int64(), "int": pa.int32(), "double": pa.float64(), "boolean": pa.bool_(),
    "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32()),
    "array<bigint>": pa.list_(pa.int64()), "array<double>": pa.list_(pa.float64()),
    "array<string>": pa.list_(pa.string()),
}
ROWS_AT_ONCE = 250  # texts held as Python strings at a time
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


def sha_hex(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(col: Column, k: int) -> Column:
    """crc32 of the decimal id, modulo k (NULL for a NULL id)."""
    return F.pmod(F.crc32(col.cast("string").cast("binary")), F.lit(k))


def _held() -> dict:
    return sys.modules.setdefault("_riskvq_llm_cache", types.ModuleType("_riskvq_llm_cache")).__dict__.setdefault("held", {})


def per_process(key: str, version, build: Callable):
    """An object that a Python worker keeps between tasks; one of another key or version replaces it."""
    held = _held()
    if held.get("of") != (key, version):
        forget()
        held["what"] = build()
        held["of"] = (key, version)
    return held["what"]


def forget() -> None:
    """Drop what another operator left in this Python worker: workers serve one operator after the other."""
    _held().clear()
    gc.collect()


def arrow_rows(columns: list, fields: list[tuple[str, str]]) -> pa.RecordBatch:
    """A record batch of the named fields; Arrow arrays pass through, lists are converted."""
    arrays = [c if isinstance(c, (pa.Array, pa.ChunkedArray)) else pa.array(c, type=ARROW[t])
              for c, (_, t) in zip(columns, fields, strict=True)]
    return pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in fields])


def ddl(fields: list[tuple[str, str]]) -> str:
    return ", ".join(f"`{n}` {t}" for n, t in fields)


def sliced(batches):
    """The rows of record batches, at most ROWS_AT_ONCE together."""
    for batch in batches:
        for start in range(0, batch.num_rows, ROWS_AT_ONCE):
            yield batch.slice(start, ROWS_AT_ONCE)


def map_texts(df: DataFrame, make: Callable, fields: list[tuple[str, str]],
              carry: tuple[str, ...] = ("doc_id",), text: str = "text") -> DataFrame:
    """One output row per input row: carried columns, then ``make()(text)`` as a tuple.

    ``make`` runs once per task; a NULL text reads as the empty text.  Other
    input columns are dropped before Python sees them.
    """
    types_of = dict(df.dtypes)
    kept = [(c, types_of[c]) for c in carry]
    at = carry.index(text) if text in carry else len(kept)

    def run(batches):
        of_text = make()
        for b in sliced(batches):
            rows = [of_text(t or "") for t in b.column(at).to_pylist()]
            yield arrow_rows([b.column(i) for i in range(len(kept))] + [list(c) for c in zip(*rows, strict=True)],
                             kept + fields)
        pa.default_memory_pool().release_unused()  # the worker stays, with what its pool still holds

    more = [] if text in carry else [F.col(text).alias("_text")]
    return df.select(*carry, *more).mapInArrow(run, ddl(kept + fields))


def annotated(df: DataFrame, operator: Callable[[DataFrame, tuple], DataFrame]) -> tuple[DataFrame, list[Column]]:
    """The result of an operator that carries every column of df, and df's columns in it.

    The columns travel under names of their own, so those of df clash with none of the operator's.
    """
    names = [f"_c{i}" for i in range(len(df.columns))]
    plain = df.toDF(*names).withColumnRenamed(names[df.columns.index("text")], "text")
    plain = plain.withColumnRenamed(names[df.columns.index("doc_id")], "doc_id")
    out = operator(plain, tuple(plain.columns))
    return out, [F.col(c).alias(n) for c, n in zip(plain.columns, df.columns, strict=True)]


ROWS_PER_TASK = 100_000  # of narrow intermediate tables


def checkpointed(df: DataFrame) -> DataFrame:
    """The same rows, read back from the session's shared checkpoint folder."""
    ensure_checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=True)


def settled(df: DataFrame) -> DataFrame:
    """A narrow table checkpointed and read back in as many tasks as its rows need.

    What follows a filter or an aggregate is often far smaller than the number
    of shuffle partitions suggests; later shuffles then write few files.
    """
    kept = checkpointed(df)
    return kept.coalesce(max(1, -(-kept.count() // ROWS_PER_TASK)))


def sample_of_labels(labels: DataFrame, value: str, k: int, held: int, bound: int, seed: str) -> DataFrame:
    """(doc_id, y): about ``bound`` labelled ids at most, drawn by a keyed hash outside fold ``held``.

    Labels of a doc_id that contradict each other are left out.  A table with
    fewer labelled ids than the bound is used whole.
    """
    one = (labels.where(F.col("doc_id").isNotNull() & F.col(value).isNotNull() & (fold(F.col("doc_id"), k) != held))
           .groupBy("doc_id").agg(F.min(value).alias("y"), F.max(value).alias("_y"))
           .where(F.col("y") == F.col("_y")).select("doc_id", F.col("y").cast("int").alias("y")))
    n = labels.where(F.col(value).isNotNull()).count()
    if n <= bound:
        return one
    # 2^32 hash values; the draw depends on the id alone
    limit = int(bound / n * 2**32)
    return one.where(F.pmod(F.xxhash64(F.lit(seed), F.col("doc_id")), F.lit(2**32)) < limit)


def labelled_texts(docs: DataFrame, sample: DataFrame) -> DataFrame:
    """(doc_id, y, text) of the sampled ids, one text each, repartitioned for the fit; the sample is bounded by its caller.

    Of several texts of one id the one of the smallest hash counts, so the bound holds for rows too.
    """
    rows = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    one = rows.groupBy("doc_id", "y").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("t"))
    return one.select("doc_id", "y", "t.text").repartition(16, F.xxhash64("doc_id", "text"))


def mix64(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (public splitmix64 constants), wrapping."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))
