"""One query for each operator, over its whole table with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table


def op1_hilbert_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .hilbert import Dim, hilbert_shards

    dims = [Dim("lang", "depth"), Dim("source", "depth"), Dim("n_chars", "log"), Dim("doc_id", "width")]
    return hilbert_shards(table(spark, sf_dir, "documents"), dims, id_column="doc_id", payload="text")


def op3_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .warc import payload_store, reconstruct, record_headers

    pages = table(spark, sf_dir, "pages")
    return reconstruct(record_headers(pages, id_column="page_id", url_column="url", payload_column="html"), payload_store(pages, payload_column="html"))


def op7_prefix_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .chat import prefix_targets

    return prefix_targets(table(spark, sf_dir, "conversations"))


def op8_licence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .licences import recognise

    return recognise(table(spark, sf_dir, "documents"))


def op10_fm_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .fmindex import find_contamination

    found = find_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return found.select("doc_id", "item_ids", "spans", "clean_text")


def op4_bbit_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .minhash import near_duplicates

    return near_duplicates(table(spark, sf_dir, "documents")).drop("text_key", "keep_text_key")


def op9_counterfactual_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .toxicity import toxic_documents

    return toxic_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_edit_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .linededup import repeated_lines

    return repeated_lines(table(spark, sf_dir, "documents")).drop("text_key", "kept_text_key")


def op6_bm25_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .packing import pack_documents

    return pack_documents(table(spark, sf_dir, "documents"))


def op2_pca_near_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .embeddings import vector_classes

    return vector_classes(table(spark, sf_dir, "embeddings"))


QUERIES = {f.__name__: f for f in (op1_hilbert_sharding, op3_warc_archive, op7_prefix_targets, op8_licence_rules, op10_fm_decontamination, op4_bbit_minhash, op9_counterfactual_toxicity, op5_edit_line_dedup, op6_bm25_packing, op2_pca_near_vectors)}
