"""Corpus pipeline: quality, boilerplate lines, near copies, benchmark leaks, tokens.

Each stage takes (spark, docs, sf_dir) and gives a DataFrame that is written as Parquet and reread as the next
one's docs. All but the last keep the columns of documents; n_chars follows a text that a stage changes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidegrid.llm import bpe
from tidegrid.llm.common import stage, table
from tidegrid.llm.decontaminate import without_leaks
from tidegrid.llm.jaccard import one_of_each
from tidegrid.llm.lines import clean_lines
from tidegrid.llm.quality import fit, keep_quality
from tidegrid.llm.queries import token_pattern, tokenizer_file


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier rejects go."""
    model = fit(docs, table(spark, sf_dir, "labels"))
    return keep_quality(docs, model)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that ten sites or more share stay in their lowest document only; documents left blank by it go.

    So a document whose copies stand on ten sites or more keeps its text once, in its lowest copy.
    """
    cleaned = clean_lines(docs, keep_in="doc_id")
    cleaned = cleaned.where((F.col("n_removed") == 0) | F.col("text").rlike(r"\S"))
    if "n_chars" in docs.columns:
        cleaned = cleaned.withColumn("n_chars", F.when(F.col("n_removed") > 0, F.length("text")).otherwise(F.col("n_chars")).cast(docs.schema["n_chars"].dataType))
    return cleaned.select(docs.columns)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies (five words, similarity 0.8) stays."""
    return one_of_each(docs, size=5, num=80, den=100)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return without_leaks(docs, table(spark, sf_dir, "benchmark"))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text that is left, and a digest of what they decode to."""
    ranks = bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    coded = bpe.encode(docs.select("doc_id", "lang", "source", "text"), ranks, token_pattern(), dictionary_words=1 << 18, digests=True)  # a smaller dictionary spares the driver
    return coded.select("doc_id", "lang", "source", "ids", "n_tokens", "decoded_sha256")


STAGES = [("quality", quality), ("line dedup", line_dedup), ("near copies", near_copies), ("decontamination", decontamination), ("tokens", tokens)]
#: The classifier and the token ids are beyond SQL; the stages are tested against brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, f in STAGES:
        docs = stage(f(spark, docs, sf_dir), f"pipeline-{name.replace(' ', '-')}")
    return docs
