"""Training-corpus pipeline over ``documents``.

Five stages, each one operator of ``veilgrid.llm`` applied to all rows that the stage
before it kept: quality rules and quality classifier drop documents, line dedup
deletes repeated passages, the n-gram join keeps one document of each group of near
duplicates (five words, similarity 0.8), and packing lays out token sequences. The
first four return the columns of ``documents``; the last returns a row per piece.

Both quality models are fitted on labelled rows of the whole ``documents`` table, so
the classifier sees examples that the rules have already dropped.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from veilgrid.llm.common import Scratch, table
from veilgrid.llm.stages import classifier, lines, near_duplicates, rules, sequences

STAGES = [("quality_rules", rules), ("quality_classifier", classifier), ("line_dedup", lines), ("ngram_jaccard_join", near_duplicates), ("best_fit_packing", sequences)]

#: Trained models, similarity components and packings have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each result written and read again."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = scratch.keep(stage(spark, docs, sf_dir))
    return docs
