"""Whole programs: IR tables, rules and names to edges, seeds, sinks and flows.

Tables of a program (a ``frontends`` function or an extractor of one's own makes them):

* ``funcs``: func, lang, file, params array<int>, captures array<int>, returns array<int>
* ``variables``: func, var, name, type, const, annotations array<string>, file, line
* ``instrs``: func, idx, op, dst, args array<int>, field, owner, operator, closure, file, line
* ``calls``: call_id, func, lang, callee, name, recv_type, recv_text, recv, dst, target, file, line
* ``args``: call_id, idx, var, name (of a keyword), const

``dst``, ``recv`` and ``var`` are variables of the function, -1 where there is none.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.operators import names, rules
from veilgrid.operators.taint import EDGE_COLUMNS, flows, node, propagate

#: Factors of operations, and the sources' share of confidence.
ALIAS, UNKNOWN_CALL, MUTATED, DECODED, WHOLE_OBJECT, TYPE_CARRIES, SOURCE_RULE, TEXT_LABEL = 1.0, 0.95, 0.9, 0.95, 0.8, 0.7, 0.9, 0.85
#: Operators whose result says little about their operands, and types that hold no data.
LOGICAL = ("==", "!=", "<", ">", "<=", ">=", "&&", "||", "!", "in", "is", "not", "and", "or")
DATA_FREE_TYPES = ("bool", "boolean", "error", "func", "function")
REQUEST_DATA = "request_data"


@dataclass
class Program:
    funcs: DataFrame
    variables: DataFrame
    instrs: DataFrame
    calls: DataFrame
    args: DataFrame


def _edge(src: Column, dst: Column, factor: float = ALIAS, transform: Column | None = None, via: str = "copy", field: Column | None = None, whole: Column | None = None) -> list[Column]:
    none = lambda x, kind: F.lit(None).cast(kind) if x is None else x.cast(kind)
    return [
        src.alias("src"), dst.alias("dst"), F.lit(factor).alias("factor"), none(transform, "string").alias("transform"), F.col("file"), F.col("line"),
        F.lit(via).alias("via"), none(field, "string").alias("field"), none(whole, "double").alias("whole"),
    ]


def instr_edges(instrs: DataFrame) -> DataFrame:
    """Assignments, phis, catches and computations copy, loads and stores go through a field; comparisons carry nothing."""
    each = instrs.filter("dst >= 0").withColumn("arg", F.explode("args")).filter("arg >= 0")
    logical = (F.col("op") == "compute") & F.coalesce(F.col("operator").isin(*LOGICAL), F.lit(False))
    copies = each.filter(F.col("op").isin("assign", "phi", "compute", "catch") & ~logical).select(*_edge(node("func", "arg"), node("func", "dst"), ALIAS))
    typed = F.coalesce(F.col("owner"), F.lit("")) != ""
    loads = each.filter("op = 'load'").select(*_edge(node("func", "arg"), node("func", "dst"), ALIAS, None, "load", F.col("field"), F.when(~typed, WHOLE_OBJECT)))
    # a store has the object as dst and the value as its argument
    stores = each.filter("op = 'store'").select(*_edge(node("func", "arg"), node("func", "dst"), ALIAS, None, "store", F.col("field")))
    return copies.unionByName(loads).unionByName(stores)


def call_edges(program: Program) -> DataFrame:
    """Arguments to parameters, by place or by keyword, and returned variables to results of calls with a target."""
    calls = program.calls.filter("coalesce(target, '') != ''").select("call_id", "func", "target", "dst", "file", "line")
    params = program.funcs.select(F.col("func").alias("target"), F.posexplode("params").alias("place", "param"))
    named = program.variables.select(F.col("func").alias("target"), F.col("var").alias("param"), F.col("name").alias("param_name"))
    params = params.join(named, ["target", "param"], "left")
    given = program.args.filter("idx >= 0 AND var >= 0").select("call_id", "idx", "var", F.col("name").alias("keyword"))
    met = calls.join(given, "call_id").join(params, "target").filter("CASE WHEN coalesce(keyword, '') = '' THEN idx = place ELSE keyword = param_name END")
    into = met.select(*_edge(node("func", "var"), node("target", "param")))
    returned = program.funcs.select(F.col("func").alias("target"), F.explode("returns").alias("returned"))
    back = calls.filter("dst >= 0").join(returned, "target").select(*_edge(node("target", "returned"), node("func", "dst")))
    return into.unionByName(back)


def closure_edges(program: Program) -> DataFrame:
    """Captured variables into closures, and arguments of a call into the parameters of a closure passed beside them."""
    made = program.instrs.filter("op = 'closure'")
    captured = program.funcs.select(F.col("func").alias("closure"), F.posexplode("captures").alias("place", "inner"))
    into = made.select("func", "closure", "file", "line", F.posexplode("args").alias("place", "arg")).filter("arg >= 0").join(captured, ["closure", "place"])
    held = made.select("func", F.col("dst").alias("callback"), "closure")
    given = program.calls.select("call_id", "func", "recv", "file", "line").join(program.args.select("call_id", F.col("var").alias("callback")), "call_id").join(held, ["func", "callback"])
    data = program.args.select("call_id", "var").unionByName(program.calls.select("call_id", F.col("recv").alias("var"))).filter("var >= 0")
    params = program.funcs.select(F.col("func").alias("closure"), F.explode("params").alias("param"))
    called = given.join(data, "call_id").filter("var != callback").join(params, "closure")
    return into.select(*_edge(node("func", "arg"), node("closure", "inner"))).unionByName(called.select(*_edge(node("func", "var"), node("closure", "param"), UNKNOWN_CALL)))


def unknown_call_edges(program: Program, known: DataFrame, heuristics: DataFrame) -> DataFrame:
    """What calls without a target or a rule do with data, by the words of ``heuristics`` (table, word).

    Words of ``data_free`` names return nothing of their arguments, those of ``network``
    return nothing either, ``mutators`` put arguments into the receiver, ``decoders`` fill
    their last argument from the others; any other result carries all arguments.
    """
    word = F.lower(F.substring_index("name", ".", -1))
    lists = heuristics.groupBy("word").agg(F.collect_set("table").alias("tables"))
    calls = program.calls.filter("coalesce(target, '') = ''").join(known.select("call_id"), "call_id", "left_anti").withColumn("word", word).join(lists, "word", "left")
    has = lambda t: F.coalesce(F.array_contains("tables", t), F.lit(False))
    calls = calls.select("call_id", "func", "recv", "dst", "file", "line", *(has(t).alias(t) for t in ("data_free", "network", "mutators", "decoders"))).filter("NOT data_free")
    args = program.args.filter("idx >= 0").withColumn("last", F.col("idx") == F.max("idx").over(Window.partitionBy("call_id"))).select("call_id", "var", "last").filter("var >= 0")
    each = calls.join(args, "call_id")
    result = each.filter("dst >= 0 AND NOT network").select(*_edge(node("func", "var"), node("func", "dst"), UNKNOWN_CALL))
    receiver = calls.filter("dst >= 0 AND recv >= 0 AND NOT network").select(*_edge(node("func", "recv"), node("func", "dst"), UNKNOWN_CALL))
    mutated = each.filter("mutators AND recv >= 0").select(*_edge(node("func", "var"), node("func", "recv"), MUTATED))
    filled = each.filter("decoders AND last").select("call_id", F.col("var").alias("out"))
    decoded = each.filter("decoders AND NOT last").join(filled, "call_id").select(*_edge(node("func", "var"), node("func", "out"), DECODED))
    return reduce(DataFrame.unionByName, [result, receiver, mutated, decoded])


def transform_edges(program: Program, matched: DataFrame, rule_table: DataFrame) -> DataFrame:
    """Results of calls that transform rules match carry their arguments' and receiver's facts with the transform added."""
    done = matched.filter("rule_kind = 'transform' AND dst >= 0").join(F.broadcast(rule_table.select(F.col("id").alias("rule"), "transform")), "rule")
    given = program.args.select("call_id", "var").unionByName(program.calls.select("call_id", F.col("recv").alias("var"))).filter("var >= 0")
    return done.join(given, "call_id").select(*_edge(node("func", "var"), node("func", "dst"), ALIAS, F.col("transform")))


def seeds(program: Program, types: DataFrame, carried: DataFrame | None = None) -> DataFrame:
    """Facts of variables: by name, and by a declared type that carries data (``carried``: type, data_types)."""
    fine = program.variables.filter(F.col("const").isNull() & ~F.lower(F.coalesce("type", F.lit(""))).isin(*DATA_FREE_TYPES))
    named = names.classify(fine, "name", types).filter("named IS NOT NULL")
    own = F.filter(F.array(F.col("named.transform")), lambda t: t.isNotNull())
    out = named.select(node("func", "var").alias("var"), F.col("named.data_type").alias("data_type"), own.alias("transforms"), F.col("named.confidence").alias("confidence"), F.concat(F.lit("variable "), "name").alias("source_desc"), "file", "line")
    if carried is None:
        return out
    by_type = fine.withColumn("type_", names.last_segment(F.col("type"))).join(carried.select(names.last_segment(F.col("type")).alias("type_"), F.explode("data_types").alias("data_type")).distinct(), "type_")
    return out.unionByName(by_type.select(node("func", "var").alias("var"), "data_type", F.array().cast("array<string>").alias("transforms"), F.lit(TYPE_CARRIES).alias("confidence"), F.concat(F.lit("type "), "type").alias("source_desc"), "file", "line"))


def sources(program: Program, matched: DataFrame, rule_table: DataFrame, types: DataFrame) -> DataFrame:
    """Facts of source rules: results of matched calls, and annotated parameters.

    Request data read under a constant key is what the key names, or nothing else than
    what later names tell; without such a key it is request data as a whole.
    """
    spec = F.broadcast(rule_table.filter("kind = 'source'").select(F.col("id").alias("rule"), F.col("data_type").alias("said"), F.col("confidence").alias("rule_confidence")))
    keys = program.args.filter("idx = 0").select("call_id", F.col("const").alias("key"))
    hit = names.classify_keys(matched.filter("rule_kind = 'source' AND dst >= 0").join(spec, "rule").join(keys, "call_id", "left"), "key", types)
    request = F.col("said") == REQUEST_DATA
    data_type = F.when(request & F.col("key").isNotNull(), F.col("named.data_type")).otherwise(F.col("said"))
    hit = hit.withColumn("data_type", data_type).filter("data_type IS NOT NULL")
    none = F.array().cast("array<string>").alias("transforms")
    confidence = (F.col("match_confidence") * F.col("rule_confidence") * SOURCE_RULE).alias("confidence")
    results = hit.select(node("func", "dst").alias("var"), "data_type", none, confidence, F.concat(F.lit("source "), "rule").alias("source_desc"), "file", "line")
    lang = program.funcs.select("func", "lang", F.explode("params").alias("var"))
    noted = program.variables.filter("size(annotations) > 0").join(lang, ["func", "var"]).select("func", "var", "lang", "annotations", "file", "line")
    params = rules.match_parameters(noted, rule_table).join(spec, "rule")
    return results.unionByName(params.select(node("func", "var").alias("var"), F.col("said").alias("data_type"), none, confidence, F.col("how").alias("source_desc"), "file", "line"))


def labelled_arguments(program: Program, types: DataFrame) -> DataFrame:
    """Facts of call context: a value behind a key (``put("email", v)``), or behind a text that ends in ``email:`` or ``email=``."""
    said = program.args.filter("const IS NOT NULL").select("call_id", (F.col("idx") + 1).alias("idx"), "const")
    met = said.join(program.args.filter("var >= 0 AND const IS NULL").select("call_id", "idx", "var"), ["call_id", "idx"]).join(program.calls.select("call_id", "func", "file", "line"), "call_id")
    label = F.regexp_extract("const", "([\\p{L}_][\\p{L}0-9_.\\- ]{0,47}?)\\s*[:=]\\s*$", 1)
    met = met.withColumn("text_label", label != "").withColumn("label", F.when(label != "", F.element_at(F.split(label, "\\s+"), -1)).otherwise(F.col("const")))
    found = names.classify_keys(met, "label", types).filter("named IS NOT NULL")
    confidence = F.when(F.col("text_label"), F.col("named.confidence") * TEXT_LABEL).otherwise(F.col("named.confidence"))
    return found.select(node("func", "var").alias("var"), F.col("named.data_type").alias("data_type"), F.array().cast("array<string>").alias("transforms"), confidence.alias("confidence"), F.concat(F.lit("label "), "label").alias("source_desc"), "file", "line")


def sinks(program: Program, matched: DataFrame, rule_table: DataFrame, first_party: list[str] | None = None) -> DataFrame:
    """Arguments that reach matched sinks, with the destination, its host from a constant URL argument where a rule names one."""
    hits = matched.filter("rule_kind = 'sink'")
    receivers = program.calls.filter("recv >= 0").select("call_id", F.lit(-1).alias("idx"), F.col("recv").alias("var"), F.col("recv_text").alias("name"))
    texts = program.args.select("call_id", "idx", "var", F.coalesce("const", "name").alias("name")).unionByName(receivers)
    chosen = rules.selected_arguments(texts, hits.select("call_id", "rule", "match_confidence"), rule_table).filter("var >= 0").select("call_id", "rule", "match_confidence", "var")
    spec = F.broadcast(rule_table.select(F.col("id").alias("rule"), "dest_kind", "dest_host", "host_arg", F.col("confidence").alias("rule_confidence")))
    hosts = program.args.select("call_id", F.col("idx").alias("host_arg"), F.col("const").alias("constant"))
    out = chosen.join(spec, "rule").join(hosts, ["call_id", "host_arg"], "left").join(program.calls.select("call_id", "func", "file", "line"), "call_id")
    out = rules.destination(out.withColumn("dest_host", F.coalesce("dest_host", F.lit(""))), "constant", first_party)
    return out.select("func", "var", F.col("rule").alias("sink_rule"), "dest_kind", "dest_host", (F.col("match_confidence") * F.col("rule_confidence")).alias("match_confidence"), "file", "line")


def match(program: Program, rule_table: DataFrame) -> DataFrame:
    return rules.match_calls(program.calls, rule_table)


def edges(program: Program, matched: DataFrame, rule_table: DataFrame, heuristics: DataFrame) -> DataFrame:
    known = matched.filter("rule_kind IN ('transform', 'source')").select("call_id").distinct()
    every = [instr_edges(program.instrs), call_edges(program), closure_edges(program), unknown_call_edges(program, known, heuristics), transform_edges(program, matched, rule_table)]
    return reduce(DataFrame.unionByName, every).select(*EDGE_COLUMNS)


def analyze(program: Program, rule_table: DataFrame, types: DataFrame, heuristics: DataFrame, carried: DataFrame | None = None, first_party: list[str] | None = None) -> DataFrame:
    """All flows of a program, one a key (see ``taint.flows``)."""
    matched = match(program, rule_table)
    start = [seeds(program, types, carried), sources(program, matched, rule_table, types), labelled_arguments(program, types)]
    facts = propagate(reduce(DataFrame.unionByName, start), edges(program, matched, rule_table, heuristics))
    return flows(facts, sinks(program, matched, rule_table, first_party))
