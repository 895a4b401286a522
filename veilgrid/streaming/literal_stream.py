"""Literal detection on streams of texts.

Detection looks at one text at a time, so it runs unchanged on a stream and keeps no
state. Counts per event-time window close by a watermark.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming.query import StreamingQuery

from veilgrid.operators import literals


def read_texts(spark: SparkSession, folder: str, schema: str, files_per_trigger: int = 64) -> DataFrame:
    """A stream of the parquet files that arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def card_stream(texts: DataFrame, text_col: str = "text") -> DataFrame:
    """Card findings of a stream, row by row."""
    return literals.card_findings(texts, text_col)


def windowed_counts(findings: DataFrame, time_col: str, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Findings per window and data type; rows later than the watermark are dropped by design."""
    return findings.withWatermark(time_col, late).groupBy(F.window(time_col, width), "data_type").agg(F.count("*").alias("n"))


def write_parquet(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Exactly-once files; ends when what has arrived is processed."""
    return stream.writeStream.format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
