"""The corpus pipeline: from raw documents to packed sequences, each stage written as Parquet and read again.

Each function takes (spark, docs, sf_dir). All but the last return the columns of documents, others than those that they
read unchanged. In all stages: an empty table gives no rows, texts of any length are read whole, further columns may have
any names but those that begin with _gq_, _gl_, _toxicity or _scored_.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gravelsift.llm import chosen_path, line_dedup, packing, quality, registry, toxicity
from gravelsift.llm.common import broadcast_if_small, materialize, table


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the hierarchical quality classifier doesn't reject.

    Null or empty texts are judged as empty ones; null source or lang: a site of their own; null and repeated ids: row by row.
    """
    model = quality.fit_evidence(docs, table(spark, sf_dir, "labels"))
    return quality.decide(docs, model, F.col("source"), F.col("lang")).where("_gq_keep").select(*docs.columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the n-gram classifier doesn't call toxic, learnt from the rows that op2 learns from.

    Null or empty texts: the score of no features; null and repeated ids: row by row.
    """
    model = toxicity.fit(docs, table(spark, sf_dir, "labels"), ~registry.held_out())
    scored = toxicity.score(docs, model, docs.columns, name="_toxicity")
    return scored.where(F.col("_toxicity") < 0.3).select(*docs.columns)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without lines that repeat an earlier one; a document of which nothing is left goes.

    Of equal lines the one of the smallest id and line number stays. Null and empty texts, and rows with a null id, stay as
    they are. Rows of one id are one document. n_chars is counted anew.
    """
    found = line_dedup.drop_repeated_lines(docs)
    left = found.where("_gl_dropped = 0 or text rlike '\\\\S'")
    return left.select(*(F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first document of each group of near-duplicates, by id.

    Texts without words (null, empty) and rows with a null id are copies of nothing and stay. Rows of one id stay or go together.
    """
    gone, _ = materialize(chosen_path.near_duplicates(docs).where("not kept").select("doc_id"), "near-copies")
    return docs.join(broadcast_if_small(gone), "doc_id", "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the documents that are left, as sequences. Null text: the end id alone; repeated rows: each is packed."""
    cut = packing.split_documents(docs, public_tokenizers.path("byte_bpe_50k.json"), end_id=1, longest=2048)
    return packing.number_sequences(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


STAGES = [
    ("quality", keep_quality),
    ("toxicity", drop_toxic),
    ("line_dedup", drop_lines),
    ("ngram_join", drop_near_copies),
    ("packing", pack),
]

#: The stages train models and join by similarity: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs, _ = materialize(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
