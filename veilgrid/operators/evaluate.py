"""Evaluation: findings against labels, thresholds, gates, timing and rule-test annotations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

EPSILON = 1e-9
THRESHOLDS = [0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95]


def name_suffix(name: Column, suffix: Column) -> Column:
    """Whether a name ends with another at one of its borders."""
    before = F.substr(name, F.length(name) - F.length(suffix), F.lit(1))
    return F.endswith(name, suffix) & ((F.length(name) == F.length(suffix)) | before.isin(".", ":", "/"))


def outcomes(findings: DataFrame, labels: DataFrame) -> DataFrame:
    """Rows (case, data_type, sink, threshold, tp, fp, fn, ambiguous) to be summed.

    ``findings``: case, data_type, sink_rule, function, confidence, threshold, only
    violations; ``labels``: the same without confidence, plus ``ambiguous``. A label that
    any finding matches is one true positive; a finding that matches only an ambiguous
    label counts as ambiguous.
    """
    f = findings.withColumn("fid_", F.monotonically_increasing_id())
    found = labels.withColumn("lid_", F.monotonically_increasing_id())
    category = F.split_part(F.col("sink_rule"), F.lit("."), F.lit(1)).alias("sink")
    met = f.select("case", "data_type", "sink_rule", "threshold", F.col("function").alias("said_"), "fid_").join(found, ["case", "data_type", "sink_rule"])
    met = met.filter(name_suffix(F.col("said_"), F.col("function")))
    by_finding = met.groupBy("fid_").agg(F.bool_or(~F.col("ambiguous")).alias("hit_"))
    zero = F.lit(0)
    reported = f.join(by_finding, "fid_", "left").filter("hit_ IS NULL OR NOT hit_").select(
        "case", "data_type", category, "threshold", zero.alias("tp"), F.col("hit_").isNull().cast("int").alias("fp"), zero.alias("fn"), F.col("hit_").isNotNull().cast("int").alias("ambiguous")
    )
    thresholds = findings.select("threshold").distinct()
    real = found.filter("NOT ambiguous").crossJoin(F.broadcast(thresholds))
    matched = met.filter("NOT ambiguous").select("lid_", "threshold").distinct().withColumn("yes_", F.lit(1))
    expected = real.join(matched, ["lid_", "threshold"], "left").select(
        "case", "data_type", category, "threshold", F.coalesce("yes_", zero).alias("tp"), zero.alias("fp"), (1 - F.coalesce("yes_", zero)).alias("fn"), zero.alias("ambiguous")
    )
    return reported.unionByName(expected)


def at_thresholds(findings: DataFrame, thresholds: list[float] = THRESHOLDS) -> DataFrame:
    """Findings once for every threshold that their confidence meets."""
    return findings.withColumn("threshold", F.explode(F.array(*map(F.lit, thresholds)))).filter("confidence >= threshold")


def with_rates(df: DataFrame) -> DataFrame:
    """Adds precision, recall and F1; nothing reported or nothing expected counts as 1."""
    p = F.when(F.col("tp") + F.col("fp") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fp")))
    r = F.when(F.col("tp") + F.col("fn") == 0, 1.0).otherwise(F.col("tp") / (F.col("tp") + F.col("fn")))
    out = df.withColumns({"precision": p, "recall": r})
    f1 = F.when(F.col("precision") + F.col("recall") == 0, 0.0).otherwise(2 * F.col("precision") * F.col("recall") / (F.col("precision") + F.col("recall")))
    return out.withColumn("f1", f1)


def score(rows: DataFrame, *by: str) -> DataFrame:
    """Sums of outcome rows with their rates."""
    return with_rates(rows.groupBy(*by).agg(*(F.sum(c).alias(c) for c in ("tp", "fp", "fn", "ambiguous"))))


def score_by_parts(rows: DataFrame) -> DataFrame:
    """By data type, by sink category and in total, in one pass."""
    sums = [F.sum(c).alias(c) for c in ("tp", "fp", "fn", "ambiguous")]
    return with_rates(rows.groupingSets([["data_type"], ["sink"], []], "data_type", "sink").agg(*sums))


def failing(scores: DataFrame, gates: DataFrame) -> DataFrame:
    """Cases below their min_precision or min_recall."""
    return scores.join(F.broadcast(gates), "case").filter((F.col("precision") < F.col("min_precision") - EPSILON) | (F.col("recall") < F.col("min_recall") - EPSILON))


def timing(runs: DataFrame) -> DataFrame:
    """Runs, median, least and largest wall time of each case."""
    return runs.groupBy("case").agg(F.count("*").alias("runs"), F.expr("percentile(wall_ms, 0.5)").alias("median_ms"), F.min("wall_ms").alias("min_ms"), F.max("wall_ms").alias("max_ms"))


#: Fixed value: the form of a whole-line annotation.
ANNOTATION = r"^\s*(?://|#|--|/\*)\s*(ruleid|ok|todoruleid|todook):\s*([A-Za-z0-9_.,\- ]+?)\s*(?:\*/)?\s*$"


def annotations(lines: DataFrame) -> DataFrame:
    """(file, mark, rule_id, line): annotations with the next line that is none; null where a file ends before."""
    mark, ids = F.regexp_extract("content", ANNOTATION, 1), F.regexp_extract("content", ANNOTATION, 2)
    rows = lines.withColumn("mark", mark).withColumn("ids", ids)
    after = Window.partitionBy("file").orderBy("line").rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("target", F.min(F.when(F.col("mark") == "", F.col("line"))).over(after)).filter("mark != ''")
    out = rows.select("file", "mark", F.explode(F.split("ids", ",")).alias("rule_id"), F.col("target").alias("line"))
    return out.withColumn("rule_id", F.trim("rule_id")).filter("rule_id != ''")


def check_annotations(notes: DataFrame, flows: DataFrame) -> DataFrame:
    """(file, line, rule_id, problem) of annotations that do not hold and violations nobody announced."""
    at = flows.select(F.col("sink_file").alias("file"), F.col("sink_line").alias("line"), F.col("sink_rule").alias("rule_id"), "violation")
    seen = at.groupBy("file", "line", "rule_id").agg(F.bool_or("violation").alias("leak"))
    told = notes.join(seen, ["file", "line", "rule_id"], "left").withColumn("found", F.col("leak").isNotNull()).withColumn("leak", F.coalesce("leak", F.lit(False)))
    problem = (
        F.when((F.col("mark") == "ruleid") & ~F.col("found"), "no finding")
        .when((F.col("mark") == "ok") & F.col("leak"), "unexpected violation")
        .when((F.col("mark") == "todoruleid") & F.col("found"), "now reported")
        .when((F.col("mark") == "todook") & ~F.col("leak"), "no longer reported")
    )
    failed = told.withColumn("problem", problem).filter("problem IS NOT NULL").select("file", "line", "rule_id", "problem")
    silent = seen.filter("leak").join(notes, ["file", "line", "rule_id"], "left_anti").select("file", "line", "rule_id", F.lit("unannotated violation").alias("problem"))
    return failed.unionByName(silent)
