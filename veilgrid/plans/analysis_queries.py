"""Queries on whole programs: edges, seeds, sources, labels, facts and flows of a small program in IR tables."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilgrid.functions import taxonomy
from veilgrid.operators import analysis, rules, taint
from veilgrid.plans.fixtures import Fixture, sql_list, with_
from veilgrid.plans.program_queries import _patterns_cte, _toks_ctes
from veilgrid.sources import frontends

FUNCS = Fixture("p_funcs", "func string, lang string, file string, params array<int>, captures array<int>, returns array<int>", [("f", "python", "a.py", [0], [], []), ("g", "python", "a.py", [0, 1], [], [2]), ("h", "python", "b.py", [1], [0], [])])
VARIABLES = Fixture(
    "p_variables", "func string, var int, name string, type string, const string, annotations array<string>, file string, line int",
    [("f", 0, "req", "Request", None, [], "a.py", 1), ("f", 1, "email", "str", None, [], "a.py", 2), ("f", 2, "user", "app.User", None, [], "a.py", 3), ("f", 3, "isEmail", "bool", None, [], "a.py", 4), ("f", 4, "", "", "dob: ", [], "a.py", 5)]
    + [("f", k, "", "", None, [], "a.py", k) for k in range(5, 20)]
    + [("g", 0, "body", "", None, ["RequestBody"], "a.py", 30), ("g", 1, "phone", "", None, [], "a.py", 30), ("g", 2, "", "", None, [], "a.py", 31), ("h", 0, "email", "", None, [], "b.py", 1), ("h", 1, "item", "", None, [], "b.py", 1), ("h", 2, "passwordHash", "bool", None, [], "b.py", 2)],
)
INSTRS = Fixture(
    "p_instrs", "func string, idx int, op string, dst int, args array<int>, field string, owner string, operator string, closure string, file string, line int",
    [("f", 0, "assign", 5, [1], None, None, None, None, "a.py", 3), ("f", 1, "store", 2, [5], "mail", "app.User", None, None, "a.py", 4), ("f", 2, "load", 6, [2], "mail", "app.User", None, None, "a.py", 5), ("f", 3, "load", 7, [2], "other", "app.User", None, None, "a.py", 6),
     ("f", 4, "load", 8, [1], "raw", "", None, None, "a.py", 7), ("f", 5, "compute", 9, [6, 7], None, None, "+", None, "a.py", 8), ("f", 6, "compute", 10, [1, 9], None, None, "==", None, "a.py", 9), ("f", 7, "phi", 11, [9, 10], None, None, None, None, "a.py", 10),
     ("f", 8, "closure", 12, [11], None, None, None, "h", "a.py", 11), ("f", 9, "store", 13, [2], "inner", "", None, None, "a.py", 12), ("f", 10, "load", 14, [13], "inner", "Box", None, None, "a.py", 13), ("f", 11, "load", 15, [14], "mail", "User", None, None, "a.py", 14), ("g", 0, "assign", 2, [1], None, None, None, None, "a.py", 31)],
)
CALLS = Fixture(
    "p_calls", "call_id string, func string, lang string, callee string, name string, recv_type string, recv_text string, recv int, dst int, target string, file string, line int",
    [("c1", "f", "python", "req.get", "get", None, None, -1, 16, None, "a.py", 20), ("c2", "f", "python", "req.get", "get", None, None, -1, 17, None, "a.py", 21), ("c3", "f", "python", None, "g", None, None, -1, 18, "g", "a.py", 22), ("c4", "f", "python", "mask", "mask", None, None, -1, 19, None, "a.py", 23),
     ("c5", "f", "python", "log.info", "info", None, None, -1, -1, None, "a.py", 24), ("c6", "f", "python", None, "append", None, "items", 13, -1, None, "a.py", 25), ("c7", "f", "python", None, "len", None, None, -1, 10, None, "a.py", 26), ("c8", "f", "python", None, "each", None, None, -1, -1, None, "a.py", 27),
     ("c9", "f", "python", "log.info", "info", None, None, -1, -1, None, "a.py", 28), ("c10", "f", "python", None, "decode", None, None, -1, -1, None, "a.py", 29), ("c11", "h", "python", "log.info", "info", None, None, -1, -1, None, "b.py", 3), ("c12", "f", "python", None, "put", None, "m", -1, -1, None, "a.py", 30)],
)
ARGS = Fixture(
    "p_args", "call_id string, idx int, var int, name string, const string",
    [("c1", 0, 4, None, "email"), ("c2", 0, 4, None, "thing"), ("c3", 0, 18, "phone", None), ("c3", 1, 6, None, None), ("c4", 0, 15, None, None), ("c5", 0, 19, None, None), ("c6", 0, 6, None, None), ("c7", 0, 1, None, None), ("c8", 0, 11, None, None), ("c8", 1, 12, None, None), ("c9", 0, 18, None, None),
     ("c10", 0, 1, None, None), ("c10", 1, 8, None, None), ("c11", 0, 1, None, None), ("c12", 0, 4, None, "phone_number"), ("c12", 1, 16, None, None), ("c12", 2, 4, None, "the dob = "), ("c12", 3, 17, None, None)],
)
RULES = json.dumps([
    {"id": "log", "lang": "python", "call": "log.info", "dest": {"kind": "log"}}, {"id": "mask", "kind": "transform", "lang": "python", "call": "mask", "transform": "masked"},
    {"id": "request", "kind": "source", "lang": "python", "call": "req.get", "param_annotation": ["RequestBody"], "data_type": "request_data", "confidence": 0.9},
])
WORDS = Fixture("words", "list string, word string", [("data_free", "len"), ("mutators", "append"), ("decoders", "decode"), ("network", "fetch")])


def _program(spark):
    return analysis.Program(*(x.df(spark) for x in (FUNCS, VARIABLES, INSTRS, CALLS, ARGS)))


def _parts(spark):
    program, held = _program(spark), rules.load(spark, RULES)
    return program, held, analysis.match(program, held), WORDS.df(spark).withColumnRenamed("list", "table"), taxonomy.data_types(spark)


def seeds(spark, _):
    carried = spark.createDataFrame([("User", ["email", "phone"])], "type string, data_types array<string>")
    return analysis.seeds(_program(spark), taxonomy.data_types(spark), carried).select("var", "data_type", F.array_join("transforms", ",").alias("transforms"), F.round("confidence", 4).alias("confidence"), "source_desc")


def all_edges(spark, _):
    program, held, matched, words, _types = _parts(spark)
    return analysis.edges(program, matched, held, words).select("src", "dst", "factor", "transform", "via", "field", "whole", "line")


def sources(spark, _):
    program, held, matched, _words, types = _parts(spark)
    return analysis.sources(program, matched, held, types).select("var", "data_type", F.round("confidence", 4).alias("confidence"), "source_desc", "line")


def labels(spark, _):
    return analysis.labelled_arguments(_program(spark), taxonomy.data_types(spark)).select("var", "data_type", F.round("confidence", 4).alias("confidence"), "line")


def sinks(spark, _):
    program, held, matched, *_rest = _parts(spark)
    return analysis.sinks(program, matched, held).select("func", "var", "sink_rule", "dest_kind", "match_confidence", "line")


START = Fixture("start", "var string, data_type string, transforms array<string>, confidence double, source_desc string, file string, line int", [("f#1", "email", [], 0.9, "variable email", "a.py", 2), ("g#1", "phone", [], 0.9, "variable phone", "a.py", 30), ("f#17", "request_data", [], 0.81, "source request", "a.py", 21)])


def _facts(spark):
    program, held, matched, words, _types = _parts(spark)
    return taint.propagate(START.df(spark), analysis.edges(program, matched, held, words))


def facts(spark, _):
    return _facts(spark).select("var", "field_path", "data_type", F.array_join("transforms", ",").alias("transforms"), F.round("confidence", 6).alias("confidence"))


def flows(spark, _):
    program, held, matched, *_rest = _parts(spark)
    made = taint.flows(_facts(spark), analysis.sinks(program, matched, held))
    return made.select("data_type", "sink_rule", "function", "sink_line", F.array_join("transforms", ",").alias("transforms"), "confidence", "source_desc")


CODE = 'import log\nfrom req import get\n\ndef save(mail):\n    log.info(mail)\n\ndef main():\n    email = get("email")\n    save(email)\n'


def lowered(spark, _):
    files = spark.createDataFrame([("m.py", "python", CODE)], "path string, lang string, text string")
    return frontends.lower(files)["calls"].select("func", "callee", "name", "target", "line")


def python_flows(spark, _):
    files = spark.createDataFrame([("m.py", "python", CODE)], "path string, lang string, text string")
    none = spark.createDataFrame([], "table string, word string")
    made = analysis.analyze(frontends.program(frontends.lower(files)), rules.load(spark, RULES), taxonomy.data_types(spark), none)
    return made.select("data_type", "sink_rule", "function", "sink_file", "sink_line", F.array_join("transforms", ",").alias("transforms"))


# ---------------------------------------------------------------- SQL

_line = "file, line"
_edges_sql = f"""each AS (SELECT *, unnest(args) AS arg FROM p_instrs WHERE dst >= 0),
params AS (SELECT p.func AS target, p.place, p.param, v.name FROM (SELECT func, unnest(params) AS param, generate_subscripts(params, 1) - 1 AS place FROM p_funcs) p LEFT JOIN p_variables v ON v.func = p.func AND v.var = p.param),
known(call_id) AS (SELECT call_id FROM p_calls WHERE callee IN ('mask', 'req.get')),
open AS (SELECT c.*, coalesce(list_contains(w.l, 'data_free'), FALSE) AS free, coalesce(list_contains(w.l, 'network'), FALSE) AS network, coalesce(list_contains(w.l, 'mutators'), FALSE) AS mutates, coalesce(list_contains(w.l, 'decoders'), FALSE) AS decodes
  FROM p_calls c LEFT JOIN (SELECT word, list(list) AS l FROM words GROUP BY word) w ON w.word = lower(c.name) WHERE target IS NULL AND call_id NOT IN (SELECT call_id FROM known)),
given AS (SELECT *, idx = max(idx) OVER (PARTITION BY call_id) AS last FROM p_args WHERE idx >= 0),
made AS (SELECT *, unnest(args) AS arg, generate_subscripts(args, 1) - 1 AS place FROM p_instrs WHERE op = 'closure'),
edges AS (
  SELECT func || '#' || arg AS src, func || '#' || dst AS dst, CAST(1 AS DOUBLE) AS factor, CAST(NULL AS VARCHAR) AS transform, 'copy' AS via, CAST(NULL AS VARCHAR) AS field, CAST(NULL AS DOUBLE) AS whole, {_line} FROM each WHERE arg >= 0 AND op IN ('assign', 'phi', 'compute', 'catch') AND NOT (op = 'compute' AND operator IN ({sql_list(analysis.LOGICAL)}))
  UNION ALL SELECT func || '#' || arg, func || '#' || dst, 1.0, NULL, op, field, CASE WHEN op = 'load' AND coalesce(owner, '') = '' THEN 0.8 END, {_line} FROM each WHERE arg >= 0 AND op IN ('load', 'store')
  UNION ALL SELECT c.func || '#' || a.var, c.target || '#' || p.param, 1.0, NULL, 'copy', NULL, NULL, {_line} FROM p_calls c JOIN p_args a USING (call_id) JOIN params p ON p.target = c.target AND CASE WHEN a.name IS NULL THEN a.idx = p.place ELSE a.name = p.name END
  UNION ALL SELECT c.target || '#' || r.v, c.func || '#' || c.dst, 1.0, NULL, 'copy', NULL, NULL, {_line.replace("file", "c.file")} FROM p_calls c JOIN (SELECT func, unnest(returns) AS v FROM p_funcs) r ON r.func = c.target
  UNION ALL SELECT m.func || '#' || m.arg, m.closure || '#' || f.v, 1.0, NULL, 'copy', NULL, NULL, {_line} FROM made m JOIN (SELECT func, unnest(captures) AS v, generate_subscripts(captures, 1) - 1 AS place FROM p_funcs) f ON f.func = m.closure AND f.place = m.place
  UNION ALL SELECT c.func || '#' || a.var, m.closure || '#' || p.v, 0.95, NULL, 'copy', NULL, NULL, c.file, c.line FROM p_calls c JOIN p_args b USING (call_id) JOIN (SELECT DISTINCT func, dst, closure FROM p_instrs WHERE op = 'closure') m ON m.func = c.func AND m.dst = b.var
    JOIN p_args a ON a.call_id = c.call_id AND a.var != b.var JOIN (SELECT func, unnest(params) AS v FROM p_funcs) p ON p.func = m.closure
  UNION ALL SELECT o.func || '#' || a.var, o.func || '#' || o.dst, 0.95, NULL, 'copy', NULL, NULL, {_line} FROM open o JOIN given a USING (call_id) WHERE NOT free AND NOT network AND dst >= 0
  UNION ALL SELECT o.func || '#' || o.recv, o.func || '#' || o.dst, 0.95, NULL, 'copy', NULL, NULL, {_line} FROM open o WHERE NOT free AND NOT network AND dst >= 0 AND recv >= 0
  UNION ALL SELECT o.func || '#' || a.var, o.func || '#' || o.recv, 0.9, NULL, 'copy', NULL, NULL, {_line} FROM open o JOIN given a USING (call_id) WHERE mutates AND recv >= 0
  UNION ALL SELECT o.func || '#' || a.var, o.func || '#' || b.var, 0.95, NULL, 'copy', NULL, NULL, {_line} FROM open o JOIN given a USING (call_id) JOIN given b USING (call_id) WHERE decodes AND b.last AND NOT a.last
  UNION ALL SELECT c.func || '#' || a.var, c.func || '#' || c.dst, 1.0, 'masked', 'copy', NULL, NULL, {_line} FROM p_calls c JOIN p_args a USING (call_id) WHERE callee = 'mask')"""
_named = lambda names: f"names AS ({names}),\n{_patterns_cte()},\n{_toks_ctes}"
_key_fits = "regexp_full_match(b.name, '[A-Za-z_\\p{L}][\\p{L}A-Za-z0-9_.\\-]{0,47}')"
_tables = (FUNCS, VARIABLES, INSTRS, CALLS, ARGS, WORDS)
_facts_sql = """facts AS (SELECT var, '' AS field_path, data_type, transforms, confidence, source_desc, 0 AS hops FROM start
  UNION SELECT * FROM (SELECT e.dst, CASE via WHEN 'load' THEN CASE WHEN f.field_path = e.field THEN '' WHEN prefix(f.field_path, e.field || '.') THEN substr(f.field_path, length(e.field) + 2) WHEN f.field_path = '' AND e.whole IS NOT NULL THEN '' END
      WHEN 'store' THEN array_to_string(string_split(e.field || CASE WHEN f.field_path = '' THEN '' ELSE '.' || f.field_path END, '.')[1:3], '.') ELSE f.field_path END AS p,
    f.data_type, CASE WHEN e.transform IS NULL THEN f.transforms ELSE list_sort(list_distinct(list_append(f.transforms, e.transform))) END, f.confidence * e.factor * CASE WHEN via = 'load' AND f.field_path = '' THEN coalesce(e.whole, 1) ELSE 1 END AS c, f.source_desc, f.hops + 1
    FROM facts f JOIN edges e ON e.src = f.var WHERE f.hops < 14) WHERE p IS NOT NULL AND c >= 0.2)"""

QUERIES = {
    "T05_seeds": seeds, "T06_edges": all_edges, "T07_facts": facts, "T12_labels": labels, "T13_sinks": sinks, "T14_sources": sources, "T20_flows": flows, "F03_python_calls": lowered, "F03_python_flows": python_flows,
}

ORACLE_SQL = {
    "T05_seeds": with_(*_tables, _named("SELECT DISTINCT name FROM p_variables WHERE const IS NULL")) + f""", fine AS (SELECT * FROM p_variables WHERE const IS NULL AND lower(type) NOT IN ({sql_list(analysis.DATA_FREE_TYPES)}))
SELECT func || '#' || var AS var, b.data_type, coalesce(b.transform, '') AS transforms, round(CAST(b.c AS DOUBLE), 4) AS confidence, 'variable ' || f.name AS source_desc FROM fine f JOIN best b ON b.name = f.name AND b.r = 1
UNION ALL SELECT func || '#' || var, unnest(['email', 'phone']), '', 0.7, 'type ' || type FROM fine WHERE regexp_extract(type, '[^.]*$') = 'User'""",
    "T06_edges": with_(*_tables, _edges_sql) + "SELECT src, dst, CAST(factor AS DOUBLE) AS factor, transform, via, field, CAST(whole AS DOUBLE) AS whole, line FROM edges",
    "T07_facts": with_(*_tables, START, _edges_sql, _facts_sql).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT var, field_path, data_type, array_to_string(transforms, ',') AS transforms, round(CAST(max(confidence) AS DOUBLE), 6) AS confidence FROM facts GROUP BY ALL",
    "T12_labels": with_(*_tables) + f""", behind AS (SELECT b.call_id, b.var, CASE WHEN regexp_matches(a.const, '[:=]\\s*$') THEN regexp_extract(a.const, '([\\p{{L}}0-9_.\\-]+)\\s*[:=]\\s*$', 1) ELSE a.const END AS label, regexp_matches(a.const, '[:=]\\s*$') AS text
  FROM p_args a JOIN p_args b ON a.call_id = b.call_id AND b.idx = a.idx + 1 WHERE a.const IS NOT NULL AND b.const IS NULL AND b.var >= 0),
{_named("SELECT DISTINCT label AS name FROM behind")}
SELECT c.func || '#' || h.var AS var, b.data_type, round(CAST((b.c - 0.1) * CASE WHEN text THEN 0.85 ELSE 1 END AS DOUBLE), 4) AS confidence, c.line FROM behind h JOIN p_calls c USING (call_id) JOIN best b ON b.name = h.label AND b.r = 1 WHERE {_key_fits}""",
    "T13_sinks": with_(*_tables) + "SELECT func, var, 'log' AS sink_rule, 'log' AS dest_kind, CAST(1.0 AS DOUBLE) AS match_confidence, line FROM p_calls JOIN p_args USING (call_id) WHERE callee = 'log.info'",
    "T14_sources": with_(*_tables, _named("SELECT DISTINCT const AS name FROM p_args WHERE const IS NOT NULL")) + f"""SELECT c.func || '#' || c.dst AS var, CASE WHEN a.const IS NULL THEN 'request_data' ELSE b.data_type END AS data_type, round(CAST(0.9 * 0.9 AS DOUBLE), 4) AS confidence, 'source request' AS source_desc, c.line
FROM p_calls c LEFT JOIN p_args a ON a.call_id = c.call_id AND a.idx = 0 LEFT JOIN best b ON b.name = a.const AND b.r = 1 AND {_key_fits} WHERE callee = 'req.get' AND (a.const IS NULL OR b.data_type IS NOT NULL)
UNION ALL SELECT func || '#' || var, 'request_data', round(CAST(0.9 * 0.9 AS DOUBLE), 4), '@RequestBody', line FROM p_variables WHERE list_contains(annotations, 'RequestBody')""",
    "T20_flows": with_(*_tables, START, _edges_sql, _facts_sql).replace("WITH ", "WITH RECURSIVE ", 1) + """SELECT data_type, 'log' AS sink_rule, func AS function, line AS sink_line, array_to_string(transforms, ',') AS transforms, floor(max(confidence) * 100 + 0.5) / 100 AS confidence, arg_max(source_desc, confidence) AS source_desc
FROM facts f JOIN (SELECT func, line, func || '#' || var AS v FROM p_calls JOIN p_args USING (call_id) WHERE callee = 'log.info') s ON s.v = f.var GROUP BY data_type, func, line, transforms""",
}
