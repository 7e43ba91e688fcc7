"""A corpus pipeline: quality, line and near-duplicate filters, decontamination, then packing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftframe.llm import common
from driftframe.llm.decontamination import contaminated
from driftframe.llm.line_dedup import remove_repeated_lines
from driftframe.llm.minhash_dedup import near_duplicates
from driftframe.llm.packing import pack_sequences
from driftframe.llm.quality_classifier import fit, keep_predicted, training_labels


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the compression classifier does not reject.

    It learns from all labelled documents that have the crc32 remainders of op1's training folds. Each row is judged by its own whole text,
    very long or not, so rows that tie or repeat a doc_id, or have none, are judged alike; null and empty texts have the compressed-size
    difference 0. Columns of any name stay; an empty table stays empty.
    """
    labels = common.read(spark, sf_dir, "labels")
    return keep_predicted(docs, fit(docs, training_labels(labels)))


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows; later copies of repeated line runs are cut from the texts, and n_chars is counted anew.

    Null texts stay null, with a null n_chars; empty, very long and tied texts, rows that repeat a doc_id or have none, columns of any name
    and an empty table are as ``remove_repeated_lines`` says.
    """
    return remove_repeated_lines(docs).withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest doc_id of each group of near copies.

    Texts without a word, null ones among them, and rows without a doc_id are copies of nothing and stay; very long texts are compared
    whole. Rows with one doc_id are one document: all go if one is a copy of a smaller one's, else all stay, tied or not. Columns of any
    name stay; an empty table stays empty.
    """
    copies = near_duplicates(docs).where("not kept").select("doc_id").distinct()
    return docs.join(copies, "doc_id", "left_anti").select(docs.columns)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without test items.

    Null and empty texts hold none, a very long one is searched whole; rows with one doc_id are one document and go together; rows without a
    doc_id stay. Ties don't arise, as documents are judged each by itself. Columns of any name stay; an empty table stays empty, and
    without test items all stay.
    """
    found = contaminated(docs, common.read(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(found, "doc_id", "left_anti").select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the remaining documents in training sequences; odd rows are as ``pack_sequences`` says."""
    return pack_sequences(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_classifier", keep_good),
    ("line_dedup", drop_repeated_lines),
    ("minhash_dedup", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("packing", pack),
]

#: Compression, hashing and tokenisation have no SQL form; the stages are tested one by one.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each is written as Parquet and read again by the next."""
    docs = common.read(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = common.materialize(docs, f"stage-{name}", compact=False)
    return docs
