"""The queries opN_<name>: each applies one operator, with production parameters, to a whole table."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import table
from . import bpe, oracle
from .decontaminate import find_leaks
from .jaccard import jaccard_components
from .licenses import scan_licences
from .lines import clean_lines
from .rans import read_token_blocks, write_token_blocks
from .quality import fit, score_quality
from .shards import shard_by_bytes
from .webp import stored_media, tail
from .urls import filter_urls

URL_RULES = [("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/")]
#: documents has no paths: source / language / two levels of id ranges, and every 16th id is its directory's licence file.
DOC_PATH = "concat_ws('/', source, lang, concat('v', doc_id div 4096), CASE WHEN doc_id % 16 = 0 THEN 'LICENSE' ELSE concat('p', doc_id div 64, '/f', doc_id, '.txt') END)"


def tokenizer_file(name: str) -> str:
    """Place of a public tokenizer's file: $TIDEGRID_TOKENIZERS, else the public_tokenizers package."""
    folder = os.environ.get("TIDEGRID_TOKENIZERS")
    if folder:
        return os.path.join(folder, name)
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    blocks, frequencies = write_token_blocks(table(spark, sf_dir, "documents"), tokenizer_file("byte_bpe_50k.json"), end_id=0)
    return read_token_blocks(blocks, frequencies).select("doc_id", "start", "n_tokens", F.crc32("ids").alias("ids_crc32"))


def op2_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents").withColumn("path", F.expr(DOC_PATH)))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return clean_lines(table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines", "n_removed")


def op4_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    leaks = find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return leaks.select("doc_id", "item_id", "start_word", "n_words", "similarity")


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups = jaccard_components(table(spark, sf_dir, "documents"), size=4, num=85, den=100, count_links=False)  # its SQL twin has no n_links
    return groups.select("doc_id", "n_shingles", "component_id")


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcomes: a label of the same number; a page is bad where its quality is 0 or it is toxic."""
    labels = table(spark, sf_dir, "labels").select(F.col("doc_id").alias("page_id"), ((F.col("quality") == 0) | (F.col("toxic") == 1)).alias("bad"))
    return filter_urls(table(spark, sf_dir, "pages"), labels, URL_RULES)


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs, table(spark, sf_dir, "labels"))
    out = score_quality(docs.select("doc_id", "text"), model, keep_text=False)
    return out.select("doc_id", (F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0).alias("held_out"), "score", "predicted")


def op8_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard_by_bytes(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def token_pattern() -> str:
    import public_tokenizers

    return public_tokenizers.PATTERN


def op9_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranks = bpe.read_ranks(tokenizer_file("byte_bpe_50k.tiktoken"))
    return bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), ranks, token_pattern(), digests=True).drop("ids")


def op10_webp_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    media = stored_media(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return media.select(
        "doc_id", "n_bytes", F.octet_length("samples").cast("long").alias("payload_bytes"), F.sha2("samples", 256).alias("payload_sha256"),
        F.crc32(tail(F.col("samples"))).alias("tail_crc32"), F.octet_length("media").cast("long").alias("media_bytes"), F.sha2("media", 256).alias("media_sha256"), "feature",
    )


QUERIES = {f.__name__: f for f in (op1_token_blocks, op2_licence_scan, op3_line_dedup, op4_decontamination, op5_jaccard_join, op6_url_filter, op7_quality, op8_sharding, op9_byte_bpe, op10_webp_media)}
#: The others are beyond SQL (a tokenizer, a trained model, crc32, an image format): tests/llm holds them against brute force.
ORACLE = {
    "op2_licence_scan": oracle.licence_scan(DOC_PATH), "op3_line_dedup": oracle.LINES, "op4_decontamination": oracle.LEAKS,
    "op5_jaccard_join": oracle.COMPONENTS, "op6_url_filter": oracle.url_filter(URL_RULES),
}
