"""Baselines: stable fingerprints of findings, marks on accepted ones, and what is no longer seen."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.functions.detect import digest

ENTRY = ["fingerprint", "kind", "data_type", "sink_rule", "dest", "function", "file"]


def flow_fingerprint() -> Column:
    """Type, rule, destination and function: no line, so code may move."""
    return digest(F.lit("flow"), F.col("data_type"), F.col("sink_rule"), F.concat_ws("|", "dest_host", "dest_kind"), F.col("function"))


def literal_fingerprint(file: str = "file") -> Column:
    return digest(F.lit("literal"), F.col("data_type"), F.col(file).cast("string"), F.col("value_hash"))


def mark(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Adds ``baselined`` and ``is_new`` to findings with a fingerprint and a violation flag."""
    known = baseline.select("fingerprint").distinct().withColumn("baselined", F.lit(True))
    out = findings.join(known, "fingerprint", "left").withColumn("baselined", F.coalesce("baselined", F.lit(False)))
    return out.withColumn("is_new", F.col("violation") & ~F.col("baselined"))


def unseen(baseline: DataFrame, *findings: DataFrame) -> DataFrame:
    """Baseline entries that no finding has any more."""
    out = baseline
    for f in findings:
        out = out.join(f.select("fingerprint").distinct(), "fingerprint", "left_anti")
    return out


def create(flows: DataFrame | None, literals: DataFrame | None, file: str = "file") -> DataFrame:
    """A baseline of the current violations, one entry a fingerprint."""
    none = F.lit(None).cast("string")
    parts = []
    if flows is not None:
        host = F.when(F.col("dest_host") != "", F.col("dest_host")).otherwise(F.col("dest_kind"))
        parts.append(flows.filter("violation").select("fingerprint", F.lit("flow").alias("kind"), "data_type", "sink_rule", host.alias("dest"), "function", none.alias("file")))
    if literals is not None:
        parts.append(literals.filter("violation").select("fingerprint", F.lit("literal").alias("kind"), "data_type", none.alias("sink_rule"), none.alias("dest"), none.alias("function"), F.col(file).cast("string").alias("file")))
    every = parts[0] if len(parts) == 1 else parts[0].unionByName(parts[1])
    order = Window.partitionBy("fingerprint").orderBy(*ENTRY[1:])
    return every.withColumn("place_", F.row_number().over(order)).filter("place_ = 1").select(*ENTRY)
