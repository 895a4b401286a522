"""One query per corpus operator, each over its whole table with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession

from veilgrid.llm.ann import every_nth, nearest
from veilgrid.llm.bpe import digest_documents
from veilgrid.llm.chat_format import conversation_digest
from veilgrid.llm.common import Scratch, table
from veilgrid.llm.html_extract import extract_pages
from veilgrid.llm.line_dedup import dedup_lines
from veilgrid.llm.ngram_join import components
from veilgrid.llm.packing import pack_documents
from veilgrid.llm.quality_classifier import fit_quality, pack_features, score_packed
from veilgrid.llm.quality_rules import fit_line_field, judge_documents
from veilgrid.llm.sharding import shard_digest

BYTE_RANKS, WORD_VOCABULARY = "byte_bpe_multi_50k.tiktoken", "word_bpe_49k.json"


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest_documents(table(spark, sf_dir, "documents"), public_tokenizers.path(BYTE_RANKS), public_tokenizers.PATTERN)


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack_documents(spark, table(spark, sf_dir, "documents"), public_tokenizers.path(WORD_VOCABULARY))


def op2_line_field_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    field = fit_line_field(spark, docs, table(spark, sf_dir, "labels"))
    return judge_documents(docs, field)


def op8_histogram_sort(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_digest(spark, table(spark, sf_dir, "documents"))


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversation_digest(spark, table(spark, sf_dir, "conversations"))


def op1_text_density(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


def op6_co_training(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    packed = Scratch(spark, "op6").keep(pack_features(docs))  # once for fitting and scoring
    return score_packed(packed, fit_quality(spark, docs, table(spark, sf_dir, "labels"), packed=packed))


def op4_winnowing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup_lines(spark, table(spark, sf_dir, "documents")).select("doc_id", "text", "n_lines_removed")


def op3_fragment_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, table(spark, sf_dir, "documents"))


def op7_pruned_graph(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings")
    return nearest(spark, rows, every_nth(rows))
