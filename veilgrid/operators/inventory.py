"""Inventories of findings: recipients, data types, stores; the finding graph; report counts and order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.functions.ranking import with_place
from veilgrid.sources.scratch import kept

EXAMPLES, SOURCES = 5, 6
#: The order of destination kinds, and kinds of declarations that persist.
KIND_ORDER = ["third_party", "network", "ipc", "log", "storage", "first_party"]
PERSISTENT = ["entity", "table", "proto"]
SEVERITY_ORDER = ["high", "medium", "low"]


def _place(order: list[str], column: str) -> Column:
    return F.array_position(F.array(*map(F.lit, order)), F.col(column))


def recipient_name() -> Column:
    return F.when(F.col("dest_vendor") != "", F.col("dest_vendor")).when(F.col("dest_host") != "", F.col("dest_host")).otherwise(F.concat("dest_kind", F.lit(" (unknown host)")))


def _set(column: str) -> Column:
    return F.array_sort(F.filter(F.collect_set(column), lambda x: x != ""))


def _first_few(df: DataFrame, by: list[str], value: str, n: int, name: str) -> DataFrame:
    """The n distinct values that come first by the rows' ``ord``."""
    seen = df.filter(F.col(value) != "").groupBy(*by, value).agg(F.min("ord").alias("ord_"))
    seen = seen.withColumn("r_", F.row_number().over(Window.partitionBy(*by).orderBy("ord_", value))).filter(F.col("r_") <= n)
    return seen.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct("ord_", value))), lambda s: s[value]).alias(name))


def recipients(flows: DataFrame) -> DataFrame:
    """A row per (kind, host, vendor) in report order: ``place``, ``name``, counts and what reaches it. Flows have an ``ord``."""
    by = ["dest_kind", "dest_host", "dest_vendor"]
    flows = flows.withColumn("example", F.concat_ws(":", "sink_file", F.col("sink_line").cast("string")))
    out = flows.groupBy(*by).agg(
        F.count("*").alias("flows"), F.count_if("violation").alias("violations"), _set("data_type").alias("data_types"), _set("sink_rule").alias("sinks"), F.array_sort(F.array_distinct(F.flatten(F.collect_set("transforms")))).alias("transforms"),
    )
    out = out.join(_first_few(flows, by, "example", EXAMPLES, "examples"), by, "left").withColumn("name", recipient_name())
    order = Window.orderBy(_place(KIND_ORDER, "dest_kind"), "name", *by)
    return out.withColumn("place", F.row_number().over(order))


def data_types(flows: DataFrame, literals: DataFrame, hints: DataFrame) -> DataFrame:
    """A row per data type that is sent, stored or committed; ``hints``: (store, kind, field, data_type)."""
    named = flows.withColumn("recipient", recipient_name())
    sent = named.groupBy("data_type").agg(_set("recipient").alias("recipients")).join(_first_few(named, ["data_type"], "source_desc", SOURCES, "sources"), "data_type", "left")
    held = hints.groupBy("data_type").agg(F.array_sort(F.collect_set(F.when(F.col("kind").isin(PERSISTENT), F.regexp_replace("store", "^table:", "")))).alias("stored_in"))
    kept = literals.groupBy("data_type").agg(F.count("*").alias("committed"))
    out = sent.join(held, "data_type", "full").join(kept, "data_type", "full")
    empty = F.array().cast("array<string>")
    return out.select("data_type", *(F.coalesce(c, empty).alias(c) for c in ("recipients", "sources", "stored_in")), F.coalesce("committed", F.lit(0)).alias("committed"))


def stores(hints: DataFrame) -> DataFrame:
    """A row per declared store with its fields as sorted ``field=data_type``."""
    return hints.groupBy("store", "kind").agg(F.array_sort(F.collect_set(F.concat_ws("=", "field", "data_type"))).alias("fields"))


def graph(flows: DataFrame, steps: DataFrame, callers: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes (id, kind, severity) and edges (from_id, to_id, data_types, calls).

    ``steps``: (flow, step, function) with at least one row a flow; ``callers``: (flow, function).
    """
    rank = 4 - _place(SEVERITY_ORDER, "severity")
    what = F.when(F.col("source_desc") != "", F.col("source_desc")).otherwise(F.concat_ws(":", "sink_file", F.col("sink_line").cast("string")))
    f = flows.select("flow", "data_type", rank.alias("rank"), F.concat_ws(":", F.lit("src"), "data_type", what).alias("src"), F.concat_ws(":", F.lit("sink"), "sink_rule", "sink_file", F.col("sink_line").cast("string")).alias("sink"))
    fn = steps.select("flow", "step", F.concat(F.lit("fn:"), "function").alias("id"))
    entry = fn.groupBy("flow").agg(F.min_by("id", "step").alias("entry"))
    chain = (
        fn.select("flow", F.col("step").cast("int").alias("at"), "id")
        .unionByName(f.select("flow", F.lit(-1).alias("at"), F.col("src").alias("id")))
        .unionByName(f.select("flow", F.lit(2**31 - 1).alias("at"), F.col("sink").alias("id")))
    )
    hops = chain.withColumn("to_id", F.lead("id").over(Window.partitionBy("flow").orderBy("at"))).filter("to_id IS NOT NULL AND id != to_id")
    data = hops.join(f.select("flow", "data_type"), "flow").select(F.col("id").alias("from_id"), "to_id", "data_type", F.lit(False).alias("calls"))
    called = callers.join(entry, "flow").select(F.concat(F.lit("fn:"), "function").alias("from_id"), F.col("entry").alias("to_id"), F.lit(None).cast("string").alias("data_type"), F.lit(True).alias("calls")).filter("from_id != to_id")
    edges = kept(data).unionByName(called).groupBy("from_id", "to_id").agg(F.array_sort(F.collect_set("data_type")).alias("data_types"), F.bool_and("calls").alias("calls"))
    kinds = F.array(*map(F.lit, ["caller", "function", "source", "sink"]))
    nodes = (
        chain.join(f.select("flow", "rank"), "flow").select("id", F.when(F.col("at") == -1, 3).when(F.col("at") == 2**31 - 1, 4).otherwise(2).alias("k"), "rank")
        .unionByName(callers.select(F.concat(F.lit("fn:"), "function").alias("id"), F.lit(1).alias("k"), F.lit(0).alias("rank")))
        .groupBy("id").agg(F.max("k").alias("k"), F.max("rank").alias("rank"))
    )
    names = F.array(F.lit("low"), F.lit("medium"), F.lit("high"))
    return nodes.select("id", F.element_at(kinds, F.col("k")).alias("kind"), F.when(F.col("rank") > 0, F.element_at(names, F.col("rank").cast("int"))).alias("severity")), edges


def graph_flows(flows: DataFrame, steps: DataFrame, callers: DataFrame, function: str | None = None, data_types: list[str] | None = None, violations_only: bool = True) -> DataFrame:
    """The flows that a graph shows: violations or all, of some data types, with a function on their way whose name has a match of ``function``."""
    out = flows.filter("violation") if violations_only else flows
    if data_types:
        out = out.filter(F.col("data_type").isin(*data_types))
    if function:
        there = steps.select("flow", "function").unionByName(callers.select("flow", "function")).unionByName(flows.select("flow", "function"))
        out = out.join(there.filter(F.col("function").rlike(function)).select("flow").distinct(), "flow", "left_semi")
    return out


def dot(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """The graph as rows of DOT text, in order of ``line``."""
    quoted = lambda c: F.concat(F.lit('"'), F.replace(c, F.lit('"'), F.lit('\\"')), F.lit('"'))
    n = nodes.select(F.lit(1).alias("part"), F.format_string("  %s [class=%s];", quoted(F.col("id")), "kind").alias("text"))
    style = F.when(F.col("calls"), " [style=dashed]").otherwise(F.format_string(' [label="%s"]', F.array_join("data_types", ", ")))
    e = edges.select(F.lit(2).alias("part"), F.format_string("  %s -> %s%s;", quoted(F.col("from_id")), quoted(F.col("to_id")), style).alias("text"))
    ends = nodes.sparkSession.createDataFrame([(0, "digraph flows {"), (3, "}")], "part int, text string")
    return with_place(ends.unionByName(kept(n)).unionByName(kept(e)), [F.col("part"), F.col("text")]).select(F.col("place").alias("line"), "text")


def mermaid(edges: DataFrame) -> DataFrame:
    """The edges as rows of Mermaid text."""
    key = lambda c: F.concat(F.lit("n"), F.substring(F.sha2(c, 256), 1, 8))
    node = lambda c: F.concat(key(F.col(c)), F.lit('["'), F.replace(F.col(c), F.lit('"'), F.lit("'")), F.lit('"]'))
    arrow = F.when(F.col("calls"), " -.-> ").otherwise(F.format_string(" -->|%s| ", F.array_join("data_types", ", ")))
    return edges.select(F.concat(F.lit("  "), node("from_id"), arrow, node("to_id")).alias("text"))


def counts(findings: DataFrame) -> DataFrame:
    """New, baselined and accepted findings of each ``finding`` kind."""
    return findings.groupBy("finding").agg(
        F.count_if("is_new").alias("n_new"), F.count_if(F.col("violation") & ~F.col("is_new")).alias("n_baselined"), F.count_if(~F.col("violation")).alias("n_accepted")
    )


def report_order(findings: DataFrame, *, file: str = "file") -> DataFrame:
    """Adds ``place``: new first, violations, severity, position."""
    return with_place(findings, [~F.col("is_new"), ~F.col("violation"), _place(SEVERITY_ORDER, "severity"), F.col(file), F.col("line"), F.col("col"), F.col("data_type")])
