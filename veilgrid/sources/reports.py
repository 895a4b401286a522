"""Report documents of findings as rows of text: JSON, SARIF, Markdown, GitLab, plain text, CSV inventories.

Renderers are a table of functions by name; ``register`` adds others. Findings have kind,
rule, data_type, severity, file, line, col, message, fingerprint, is_new, violation. A
document is a table of text lines with their places, so that no task and no string holds
all findings; ``write_document`` writes it in parallel, to files that make the document in
the order of their names.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from veilgrid.functions.ranking import with_place
from veilgrid.sources.scratch import kept

TOOL, VERSION = "veilgrid", "1"
SARIF_VERSION, GITLAB_VERSION = "2.1.0", "15.0.7"

_RENDERERS: dict[str, Callable[[DataFrame], DataFrame]] = {}


def register(name: str):
    def add(f: Callable[[DataFrame], DataFrame]):
        _RENDERERS[name] = f
        return f

    return add


def formats() -> list[str]:
    return sorted(_RENDERERS)


def render(findings: DataFrame, name: str) -> DataFrame:
    """(place, text): the lines of a document in order."""
    if name not in _RENDERERS:
        raise ValueError(f"no renderer {name!r}; there are {', '.join(formats())}")
    return _RENDERERS[name](findings)


def level() -> Column:
    """New violations are errors or warnings by severity, all else notes."""
    return F.when(~F.col("is_new"), "note").when(F.col("severity") == "high", "error").when(F.col("severity") == "medium", "warning").otherwise("note")


def sarif_results(findings: DataFrame) -> DataFrame:
    """A SARIF result per finding, as JSON in ``result``, with its ``level``."""
    place = F.struct(
        F.struct(F.struct(F.col("file").alias("uri")).alias("artifactLocation"), F.struct(F.col("line").alias("startLine"), F.col("col").alias("startColumn")).alias("region")).alias("physicalLocation")
    )
    result = F.struct(
        F.col("rule").alias("ruleId"), level().alias("level"), F.struct(F.col("message").alias("text")).alias("message"), F.array(place).alias("locations"),
        F.struct(F.col("fingerprint").alias(f"{TOOL}/v1")).alias("partialFingerprints"),
        F.when(F.col("is_new"), "new").otherwise("unchanged").alias("baselineState"),
    )
    return findings.select("fingerprint", "file", "line", "col", level().alias("level"), F.to_json(result).alias("result"))


def _lines(items: DataFrame, order: list, head: str | Column, tail: str = "", separator: str = "") -> DataFrame:
    """Lines of ``item`` in their order between a head and a tail; the head may count ``n`` new findings."""
    spark = items.sparkSession
    placed = kept(with_place(items.select("item", *(F.col(c).alias(f"o{k}") for k, c in enumerate(order))), [F.col(f"o{k}") for k in range(len(order))] + [F.col("item")]))
    body = placed.select(F.col("place").cast("long").alias("place"), F.concat(F.when(F.col("place") > 1, separator).otherwise(""), "item").alias("text"))
    top = spark.range(1).select(F.lit(0).cast("long").alias("place"), F.lit(head).alias("text")) if isinstance(head, str) else items.agg(F.count_if("is_new").alias("n")).select(F.lit(0).cast("long").alias("place"), head.alias("text"))
    out = body if isinstance(head, str) and not head else body.unionByName(kept(top))
    return out.unionByName(spark.createDataFrame([(2**62, tail)], "place long, text string")) if tail else out


_ORDER = ["file", "line", "col", "fingerprint"]


@register("sarif")
def sarif(findings: DataFrame) -> DataFrame:
    head = f'{{"version":"{SARIF_VERSION}","$schema":"https://json.schemastore.org/sarif-{SARIF_VERSION}.json","runs":[{{"tool":{{"driver":{{"name":"{TOOL}"}}}},"results":'
    return _lines(sarif_results(findings).withColumnRenamed("result", "item"), _ORDER, head + "[", "]}]}", ",")


@register("json")
def json_report(findings: DataFrame) -> DataFrame:
    rows = findings.withColumn("item", F.to_json(F.struct(*findings.columns)))
    return _lines(rows, _ORDER, f'{{"version":{VERSION},"findings":[', "]}", ",")


@register("gitlab")
def gitlab(findings: DataFrame) -> DataFrame:
    severity = F.initcap("severity")
    item = F.struct(
        F.col("fingerprint").alias("id"), F.lit("sast").alias("category"), F.col("message").alias("name"), severity.alias("severity"),
        F.struct("file", F.col("line").alias("start_line")).alias("location"),
        F.array(F.struct(F.lit(f"{TOOL}_rule").alias("type"), F.col("rule").alias("name"), F.col("rule").alias("value"))).alias("identifiers"),
    )
    rows = findings.filter("is_new").withColumn("item", F.to_json(item))
    scan = f'"scan":{{"type":"sast","analyzer":{{"id":"{TOOL}","name":"{TOOL}"}},"status":"success"}}'
    return _lines(rows, _ORDER, f'{{"version":"{GITLAB_VERSION}",{scan},"vulnerabilities":[', "]}", ",")


def markdown_rows(findings: DataFrame) -> DataFrame:
    """A table row per finding."""
    safe = lambda c: F.replace(F.replace(c, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))
    mark = F.when(F.col("is_new"), "new").when(F.col("violation"), "baselined").otherwise("accepted")
    return findings.withColumn("item", F.concat(F.lit("| "), mark, F.lit(" | "), "severity", F.lit(" | "), "data_type", F.lit(" | `"), "file", F.lit(":"), F.col("line").cast("string"), F.lit("` | "), safe(F.col("message")), F.lit(" |")))


@register("markdown")
def markdown(findings: DataFrame) -> DataFrame:
    head = F.concat(F.lit("## Sensitive data: "), F.col("n").cast("string"), F.lit(" new\n\n| status | severity | data | place | finding |\n|---|---|---|---|---|"))
    return _lines(markdown_rows(findings).withColumn("old", ~F.col("is_new")), ["old", *_ORDER], head)


@register("text")
def text(findings: DataFrame) -> DataFrame:
    line = F.format_string("%s:%d:%d: %s: %s [%s]", "file", F.col("line").cast("long"), F.col("col").cast("long"), "severity", "message", "rule")
    return _lines(findings.withColumn("item", line), _ORDER, "")


def write_document(lines: DataFrame, path: str) -> None:
    """A document's lines as text files, whose concatenation in the order of their names is the document."""
    lines.repartitionByRange("place").sortWithinPartitions("place").select("text").write.mode("overwrite").text(path)


def flow_findings(flows: DataFrame) -> DataFrame:
    """Decided flows in the shape of findings."""
    where = F.when(F.col("dest_host") != "", F.concat("dest_kind", F.lit(" "), "dest_host")).otherwise(F.col("dest_kind"))
    return flows.select(
        F.lit("flow").alias("kind"), F.col("sink_rule").alias("rule"), "data_type", "severity", F.col("sink_file").alias("file"), F.col("sink_line").alias("line"), F.lit(1).alias("col"),
        F.concat("data_type", F.lit(" reaches "), where).alias("message"), "fingerprint", "is_new", "violation",
    )


def literal_findings(literals: DataFrame, file: str = "file") -> DataFrame:
    """Marked literals in the shape of findings."""
    return literals.select(
        F.lit("literal").alias("kind"), F.concat(F.lit("literal."), "detector").alias("rule"), "data_type", "severity", F.col(file).cast("string").alias("file"), "line", "col",
        F.concat("data_type", F.lit(" value "), "masked").alias("message"), "fingerprint", "is_new", "violation",
    )


#: Columns of the flow inventory.
CSV_COLUMNS = ["data_type", "class", "severity", "source", "sink_rule", "dest_kind", "dest_host", "dest_vendor", "region", "first_party", "transforms", "guards", "confidence", "violation", "file", "line"]


def flow_inventory(flows: DataFrame) -> DataFrame:
    """Flows as rows of the 16-column inventory, lists joined by semicolons."""
    held = {"source": "source_desc", "file": "sink_file", "line": "sink_line"}
    one = lambda c: F.lit("") if c == "region" and "region" not in flows.columns else F.array_join(c, ";") if c in ("transforms", "guards") else F.col(held.get(c, c))
    return flows.select(*(one(c).alias(c) for c in CSV_COLUMNS))


def write_csv(rows: DataFrame, path: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(path)


def write_rows(findings: DataFrame, path: str) -> None:
    """Findings of any number as JSON lines, in parallel."""
    findings.write.mode("overwrite").json(path)


def impact_report(recipients: DataFrame, data_types: DataFrame) -> DataFrame:
    """An impact assessment as rows (section, place, text) of Markdown."""
    to = recipients.select(F.lit("recipients").alias("section"), "place", F.format_string("| %s | %s | %d | %d | %s |", "name", "dest_kind", "flows", "violations", F.array_join("data_types", ", ")).alias("text"))
    kinds = with_place(data_types, [F.col("data_type")])
    of = kinds.select(F.lit("data types").alias("section"), "place", F.format_string("| %s | %s | %s | %d |", "data_type", F.array_join("recipients", ", "), F.array_join("stored_in", ", "), "committed").alias("text"))
    return kept(of).unionByName(kept(to))
