"""Corpus pipeline: documents to token ids, in stages that each call one operator.

STAGES lists (name, function); a function takes (spark, docs, sf_dir) and
returns a DataFrame, which is written as Parquet and read again as the next
one's docs.  All but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from riskvq.llm.bpe import encode_documents
from riskvq.llm.common import annotated, table
from riskvq.llm.decontam import find_contamination
from riskvq.llm.near_dup import drop_near_duplicates
from riskvq.llm.quality import fit_quality, score_quality
from riskvq.llm.queries import rank_file, split_pattern
from riskvq.llm.secrets import redact_secrets
from riskvq.session import ensure_checkpoint_dir


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier accepts."""
    model = fit_quality(docs, table(spark, sf_dir, "labels"))
    out, columns = annotated(docs, lambda d, carry: score_quality(d, model, carry))
    return out.where(F.col("predicted") == 1).select(*columns)


def keep_distinct(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates."""
    return drop_near_duplicates(docs)


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window of a benchmark item."""
    benchmark = table(spark, sf_dir, "benchmark")
    out, columns = annotated(docs, lambda d, carry: find_contamination(d, benchmark, carry))
    return out.where(~F.col("contaminated")).select(*columns)


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each secret replaced by its kind."""
    return redact_secrets(docs)


def tokenize(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, digests of ids and decoded bytes, and the ids."""
    return encode_documents(docs, rank_file(), split_pattern(), with_ids=True)


STAGES = [
    ("quality classifier", keep_quality),
    ("MinHash near-dedup", keep_distinct),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", mask_secrets),
    ("byte-level BPE encoding and decoding", tokenize),
]

# a trained classifier is not expressible in SQL; tests compare run() with a brute-force version
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages on documents; each stage's rows are kept in the shared checkpoint folder."""
    folder = f"{ensure_checkpoint_dir(spark)}/corpus-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
    return docs
