"""Registered queries of the operators, with production parameters, and their SQL where SQL can express them."""

from __future__ import annotations

from riskvq.llm import oracle
from riskvq.llm.audit import audit_filters
from riskvq.llm.bpe import encode_documents
from riskvq.llm.clusters import cluster_vectors
from riskvq.llm.common import table
from riskvq.llm.decontam import find_contamination
from riskvq.llm.language import identify_language
from riskvq.llm.lattice import link_embeddings
from riskvq.llm.near_dup import near_duplicates
from riskvq.llm.passages import remove_repeats
from riskvq.llm.quality import classify_quality
from riskvq.llm.secrets import scan_secrets
from riskvq.llm.shards import assign_shards
from riskvq.llm.toxicity import classify_toxicity
from riskvq.llm.warc import archive_pages

VOCABULARY = "byte_bpe_multi_50k.tiktoken"


def rank_file() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def split_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op1_secrets(spark, sf_dir):
    return scan_secrets(table(spark, sf_dir, "documents"))


def op2_quality(spark, sf_dir):
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op3_bpe(spark, sf_dir):
    return encode_documents(table(spark, sf_dir, "documents"), rank_file(), split_pattern())


def op4_decontamination(spark, sf_dir):
    return find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("spans")


def op5_toxicity(spark, sf_dir):
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op6_language(spark, sf_dir):
    return identify_language(table(spark, sf_dir, "documents"))


def op7_repeated_passages(spark, sf_dir):
    return remove_repeats(table(spark, sf_dir, "documents"))


def op8_shards(spark, sf_dir):
    return assign_shards(table(spark, sf_dir, "documents"))


def op9_embeddings(spark, sf_dir):
    return link_embeddings(table(spark, sf_dir, "embeddings"))


def op10_near_duplicates(spark, sf_dir):
    return near_duplicates(table(spark, sf_dir, "documents"))


def op11_clusters(spark, sf_dir):
    return cluster_vectors(table(spark, sf_dir, "embeddings"))


def op12_warc(spark, sf_dir):
    return archive_pages(table(spark, sf_dir, "pages")).drop("problem")


def op13_filter_audit(spark, sf_dir):
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {f.__name__: f for f in (op1_secrets, op2_quality, op3_bpe, op4_decontamination, op5_toxicity, op6_language,
                                   op7_repeated_passages, op8_shards, op9_embeddings, op10_near_duplicates, op11_clusters,
                                   op12_warc, op13_filter_audit)}
# The others take SQL's reach beyond use: offsets of matches, trained models, rank merges, CRC-32, 64-bit products.
ORACLE_SQL: dict[str, str] = {
    "op4_decontamination": oracle.DECONTAMINATION,
    "op7_repeated_passages": oracle.PASSAGES,
    "op9_embeddings": oracle.EMBEDDINGS,
    "op10_near_duplicates": oracle.NEAR_DUPLICATES,
    "op11_clusters": oracle.CLUSTERS,
    "op12_warc": oracle.WARC,
    "op13_filter_audit": oracle.FILTER_AUDIT,
}
