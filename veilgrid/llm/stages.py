"""The stages of the corpus pipeline: each calls one operator on all that the stage before it kept."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from veilgrid.llm import line_dedup, ngram_join, packing, quality_classifier, quality_rules
from veilgrid.llm.common import WORD, table

NEAR_WORDS, NEAR_PERCENT = 5, 80
#: Chunks that a packing worker remembers, fewer than alone: Python workers have four stages behind them.
PACKING_MEMO = 80_000


def rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    field = quality_rules.fit_line_field(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_rules.retain_documents(docs, field)


def classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = quality_classifier.fit_quality(spark, table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return quality_classifier.retain_documents(docs, model)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where lines went, n_chars follows the text, if there is such a column.

    A document that lost more words than it keeps is a copy in the main, whose scraps the
    next stage could not tell from a text of their own: it goes.
    """
    out = line_dedup.dedup_lines(spark, docs).filter((F.col("n_lines_removed") == 0) | (F.regexp_count("text", F.lit(WORD)) >= F.col("n_words_removed")))
    if "n_chars" not in docs.columns:
        return out.select(*docs.columns)
    changed = F.when(F.col("n_lines_removed") > 0, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return out.select(*(changed.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return ngram_join.distinct_documents(spark, docs, NEAR_WORDS, NEAR_PERCENT)


def sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return packing.pack_documents(spark, docs, public_tokenizers.path("word_bpe_49k.json"), memo=PACKING_MEMO)
