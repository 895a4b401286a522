"""Explanations of findings: selection by fingerprint or place, and the story of a flow as rows of text."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def select(findings: DataFrame, wanted: str, file: str = "file", line: str = "line") -> DataFrame:
    """Findings whose fingerprint begins with ``wanted``, or at ``file:line``."""
    name, _, number = wanted.rpartition(":")
    if name and number.isdigit():
        return findings.filter((F.col(file) == name) & (F.col(line) == int(number)))
    return findings.filter(F.startswith("fingerprint", F.lit(wanted)))


def story(decided: DataFrame, steps: DataFrame) -> DataFrame:
    """(flow, place, part, text): why it is a source, each step, why it is a sink, what the policy says, what would change it.

    ``decided`` comes from ``policy.changes``; ``steps``: flow, step, function.
    """
    source = decided.select("flow", F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit("source").alias("part"), F.format_string("%s holds %s", F.when(F.col("source_desc") != "", F.col("source_desc")).otherwise("a value"), "data_type").alias("text"))
    way = steps.join(decided.select("flow"), "flow", "left_semi").select("flow", F.lit(1).alias("a"), F.col("step").alias("b"), F.lit("step").alias("part"), F.concat(F.lit("through "), "function").alias("text"))
    where = F.when(F.col("dest_host") != "", F.concat("dest_kind", F.lit(" "), "dest_host")).otherwise(F.col("dest_kind"))
    sink = decided.select("flow", F.lit(2).alias("a"), F.lit(0).alias("b"), F.lit("sink").alias("part"), F.format_string("%s:%d matches %s, which sends to %s", "sink_file", "sink_line", "sink_rule", where).alias("text"))
    said = decided.select("flow", F.lit(3).alias("a"), F.lit(0).alias("b"), F.lit("policy").alias("part"), F.concat("status", F.lit(": "), "reason").alias("text"))
    more = decided.select("flow", F.posexplode("changes").alias("b", "c")).select(
        "flow", F.lit(4).alias("a"), "b", F.lit("change").alias("part"), F.format_string("%s: %s %s, then %s", "c.setting", "c.action", "c.value", "c.status").alias("text"))
    every = source.unionByName(way).unionByName(sink).unionByName(said).unionByName(more)
    return every.withColumn("place", F.row_number().over(Window.partitionBy("flow").orderBy("a", "b"))).select("flow", "place", "part", "text")
