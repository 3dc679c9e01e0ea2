"""The corpus pipeline: quality rules, line dedup, near-dedup, decontamination, tokens. Each stage works on what the one
before it kept."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stockflow.llm import bpe, decontaminate, line_dedup, minhash, rules
from stockflow.llm.common import table
from stockflow.llm.queries import TOKENIZERS
from stockflow.session import shared_folder


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no quality rule rejects."""
    return rules.cascade(docs).filter("kept").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated runs of lines and passages of lines; one of which nothing is left goes. n_chars is counted anew."""
    left = line_dedup.deduplicate(docs, words=line_dedup.PASSAGE_WORDS).filter((F.size("removed_lines") == 0) | F.col("text").rlike("[^\\x20\\x09-\\x0D]"))
    count = {"n_chars": F.coalesce(F.when(F.size("removed_lines") > 0, F.char_length("text").cast("long")), F.col("n_chars"))}
    return left.withColumns(count if "n_chars" in docs.columns else {}).select(*docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, the one with the smallest id; documents without words stay.

    Rows that repeat an id are one document, and go or stay together; rows with a null id are not compared and stay.
    """
    classes = minhash.classes(docs)
    others = classes.filter("doc_id != class_id").select("doc_id").distinct()
    return docs.join(others, "doc_id", "left_anti").select(*docs.columns)


def benchmarks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of the benchmark; rows are told apart by id and text."""
    return decontaminate.remove(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Per document: doc_id, n_tokens, and the digests of its token ids and of the text decoded from them."""
    return bpe.encode(docs, f"{TOKENIZERS}/byte_bpe_50k.json", digests=True)


STAGES = [
    ("quality_rules", quality), ("line_dedup", lines), ("near_dedup", near_copies), ("decontamination", benchmarks), ("bpe", tokens),
]
ORACLE_SQL = None  # learned order, signatures and tokens have no SQL form


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again by the next."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        folder = shared_folder(spark, f"{name}-{uuid.uuid4().hex[:6]}")
        stage(spark, docs, sf_dir).write.parquet(folder)
        docs = spark.read.parquet(folder)
    return docs
