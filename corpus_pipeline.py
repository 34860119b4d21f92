"""The corpus pipeline: five stages, each written as Parquet and reread by the next.

1. toxicity: documents that the counterfactually regularised classifier rejects go;
2. line dedup: repeated and nearly repeated lines go, and documents left empty by that;
3. MinHash near-dedup: one document of each group of near copies stays;
4. benchmark decontamination: passages of the benchmark are cut out, and documents
   left without a word by that go;
5. packing: what remains fills windows with lexical neighbours.

Every stage handles null, empty and repeated rows as its operator says; documents
that no decision touches come through unchanged. A changed text gets its length
in ``n_chars``.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from relaylake.llm.common import free_name, shared_dir, table
from relaylake.llm.fmindex import find_contamination
from relaylake.llm.linededup import without_repeated_lines
from relaylake.llm.minhash import without_near_duplicates
from relaylake.llm.packing import pack_documents
from relaylake.llm.toxicity import THRESHOLD, train, with_scores


def _retexted(docs: DataFrame, text) -> DataFrame:
    """``docs`` with a new text, and its length where it changed."""
    changed = ~text.eqNullSafe(F.col("text"))
    cut = {"text": text, "n_chars": F.when(changed, F.length(text).cast("bigint")).otherwise(F.col("n_chars"))}
    return docs.select(*[cut[c].alias(c) if c in cut else F.col(f"`{c}`") for c in docs.columns])


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = train(docs, table(spark, sf_dir, "labels"))
    score = free_name(docs, "toxicity")
    return with_scores(docs, model, score_column=score, keep=(0.0, THRESHOLD)).drop(score)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_repeated_lines(docs, length_column="n_chars")


def minhash_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return without_near_duplicates(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    items, spans, clean = (free_name(docs, x) for x in ("item_ids", "spans", "clean_text"))
    found = find_contamination(docs, table(spark, sf_dir, "benchmark"), only_hits=False, added=(items, spans, clean))
    left = found.where(F.col(items).isNull() | F.col(clean).rlike(r"[\p{L}\p{N}]"))
    return _retexted(left, F.col(clean)).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return pack_documents(docs)


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("MinHash near-dedup", minhash_dedup), ("benchmark decontamination", decontamination), ("packing", packing)]

#: The classifier, the sketches and the greedy packing have no SQL form; the tests hold run() against all five stages done by hand.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to the documents; each result is written to the shared folder and reread."""
    docs = table(spark, sf_dir, "documents")
    base = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for k, (_, stage) in enumerate(STAGES):
        made = stage(spark, docs, sf_dir)
        made.write.parquet(f"{base}/{k}")
        docs = spark.read.schema(made.schema).parquet(f"{base}/{k}")
    return docs
