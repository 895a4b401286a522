"""Queries on names, files, declared fields, rules and program facts."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from veilgrid.functions import taxonomy
from veilgrid.operators import names, program, rules, schema_hints, taint
from veilgrid.plans.fixtures import Fixture, sql_list, sql_value, with_
from veilgrid.sources import files
from veilgrid.sources.tables import table

# ---------------------------------------------------------------- names

NAMES = Fixture(
    "names", "name string",
    [(n,) for n in ("email", "userEmail", "USER_EMAIL_ADDR", "phoneNumber", "SSNNumber", "maskedPhone", "emailValidator", "isEmail", "customer_first_name", "workemails", "microphone", "ip", "user.email2", "sha256Email", "getPhone", "card_pan", "cvv2", "XMLHttpRequest", "name", "addresses", "card last4", "hashedPassword", "x")],
)
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def tokenized(spark, _):
    return NAMES.df(spark).select("name", names.tokens(F.col("name")).alias("tokens"))


def identified(spark, _):
    made = names.classify(NAMES.df(spark), "name", taxonomy.data_types(spark))
    return made.select("name", F.col("named.data_type").alias("data_type"), F.round("named.confidence", 4).alias("confidence"), F.col("named.transform").alias("transform"), F.col("named.pattern").alias("pattern"))


def table_columns(spark, sf_dir):
    fields = schema_hints.catalog_fields(spark, {t: table(spark, sf_dir, t) for t in TABLES})
    made = names.classify(fields, "field", taxonomy.data_types(spark))
    return made.groupBy(F.col("named.data_type").alias("data_type")).agg(F.count("*").alias("n_columns"))


LABEL_LINES = Fixture("label_lines", "id int, content string", [(1, "card number and cvv"), (2, "the pan of gold"), (3, "nothing here"), (4, "email: phone:"), (5, "SSN 123"), (6, "date of birth / passports")])


def contexts(spark, _):
    return names.with_context(LABEL_LINES.df(spark), "content", taxonomy.data_types(spark)).select("id", "context")


def sanitizers(spark, _):
    rows = spark.createDataFrame([(n,) for n in ("maskPhone", "hashMap", "sha256Hex", "verifyHash", "encryptCard", "tokenize", "redactAll", "plain")], "name string")
    return rows.select("name", names.sanitizer(F.col("name")).alias("transform"))


SPLIT_SQL = r"""list_filter(string_split(lower(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(
  name, '(\p{Ll})(\p{Lu})', '\1 \2', 'g'), '(\p{Lu})(\p{Lu}\p{Ll})', '\1 \2', 'g'), '(\p{Nd})(\p{L})', '\1 \2', 'g'), '(\p{L})(\p{Nd})', '\1 \2', 'g'), '(\p{L})(\p{Nd})', '\1 \2', 'g'), '[^\p{L}\p{Nd}]+', ' ', 'g')), ' '), lambda t: t != '')"""


def _vocabulary():
    return sorted({w for t in taxonomy.DATA_TYPES for p in [*t[6], *t[7]] for w in p.split(" ")})


def _patterns_cte() -> str:
    rows = []
    for t in taxonomy.DATA_TYPES:
        for weak, held in ((False, t[6]), (True, t[7])):
            rows += [f"({t[0]}, {sql_value(t[1])}, {sql_value(p.split(' '))}, {str(weak).upper()}, {sql_value(t[8]) if t[8] else '[]::VARCHAR[]'})" for p in held]
    return "patterns AS (SELECT *, len(toks) AS n, array_to_string(toks, '') AS joined FROM (VALUES\n  " + ",\n  ".join(rows) + ") AS p(ord, data_type, toks, weak, exclude))"


_singular = f"list_transform(raw, lambda t: CASE WHEN length(t) > 4 AND suffix(t, 'es') AND list_contains(vocabulary, t[:-3]) THEN t[:-3] WHEN length(t) > 3 AND suffix(t, 's') AND list_contains(vocabulary, t[:-2]) THEN t[:-2] ELSE t END)"
_digits = "regexp_full_match({0}, '[0-9]+')"
_xf = {w: t for t, held in names.TRANSFORM_WORDS.items() for w in held.split()}
_xf_list = sql_list(sorted(_xf))
_xf_case = "CASE t " + " ".join(f"WHEN {sql_value(w)} THEN {sql_value(t)}" for w, t in _xf.items()) + " END"
_joins = f"list_concat(toks, list_filter(list_transform(range(1, len(toks)), lambda i: CASE WHEN {_digits.format('toks[i + 1]')} AND NOT {_digits.format('toks[i]')} THEN toks[i] || toks[i + 1] END), lambda x: x IS NOT NULL))"
_toks_ctes = f"""said AS (SELECT name, {_singular} AS toks FROM (SELECT name, {SPLIT_SQL} AS raw, [{sql_list(_vocabulary())}] AS vocabulary FROM names) WHERE len(raw) BETWEEN 1 AND 8),
toks AS (SELECT *, list_filter(list_transform({_joins}, lambda t: {_xf_case}), lambda x: x IS NOT NULL)[-1] AS transform FROM said WHERE NOT list_has_any(toks, [{sql_list(names.NEGATIVE_ANYWHERE)}])),
met AS (SELECT t.name, t.toks, t.transform, p.* EXCLUDE (toks), p.toks AS ptoks, list_filter(range(1, len(t.toks) - p.n + 2), lambda i: t.toks[i:i + p.n - 1] = p.toks)[1] AS place FROM toks t JOIN patterns p ON len(t.toks) >= p.n),
seq AS (SELECT *, list_concat(toks[1:place - 1], toks[place + n:]) AS outside FROM met WHERE place IS NOT NULL),
exact AS (SELECT name, transform, ord, data_type, n, ptoks, CASE WHEN len(outside) = 0 THEN 0.9 WHEN len(list_filter(outside, lambda t: NOT (t IN ({sql_list(names.NEUTRAL)}) OR t IN ({_xf_list}) OR {_digits.format('t')}))) = 0 THEN 0.85 ELSE 0.72 END - CASE WHEN weak THEN 0.25 ELSE 0 END AS c
  FROM seq WHERE NOT list_has_any(outside, exclude)
    AND NOT (len(toks) >= place + n AND toks[-1] IN ({sql_list(names.NEGATIVE_HEADS)}) AND NOT (transform IS NOT NULL AND toks[-1] IN ({_xf_list})))
    AND NOT (place > 1 AND toks[1] IN ({sql_list(names.NEGATIVE_PREFIXES)}))),
compact AS (SELECT t.name, t.transform, p.ord, p.data_type, p.n, p.toks AS ptoks, 0.55 AS c FROM toks t JOIN patterns p ON NOT p.weak AND length(p.joined) >= 5
  WHERE len(list_filter(t.toks, lambda x: length(x) > length(p.joined) AND contains(x, p.joined) AND NOT ({" OR ".join(f"contains(x, '{s}')" for s in names.COMPACT_STOP)}))) > 0 AND NOT list_has_any(t.toks, p.exclude)
    AND NOT EXISTS (SELECT 1 FROM seq s WHERE s.name = t.name AND s.ptoks = p.toks)),
best AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY c DESC, n DESC, ord, array_to_string(ptoks, ' ')) AS r FROM (SELECT * FROM exact UNION ALL BY NAME SELECT * FROM compact))"""

# ---------------------------------------------------------------- files

PATHS = Fixture(
    "paths", "path string, size long",
    [(p, s) for p, s in (("src/main.go", 10), ("src/main_test.go", 10), ("vendor/x/y.go", 5), ("web/app.d.ts", 9), ("web/app.TSX", 9), ("web/app.spec.ts", 9), ("a/testdata/b.go", 7), ("a/_skip/c.go", 7), ("docs/readme.md", 0), ("img/logo.png", 50), ("keep/logo.png", 50), ("lib/test_x.py", 3), ("lib/conftest.py", 3), ("api/v1/user.proto", 8), ("db/x.SQL", 3), ("deep/a/b/tmp1.log", 3), ("deep/a/b/tmpX.log", 3), ("big.bin", 5 << 20), ("src/test/J.java", 2), ("src/UserTest.java", 2), ("build", 1), ("sub/only/me.txt", 1))],
)
IGNORE_LINES = ["# comment", "!keep/*.png", "tmp[0-9].log", "docs/**", "/sub/*/me.txt", "!lib/"]


def ignored(spark, _):
    return files.not_ignored(PATHS.df(spark), IGNORE_LINES).select("path")


def languages(spark, _):
    return PATHS.df(spark).select("path", files.language().alias("lang"), files.is_test().alias("test"), F.coalesce(files.toolchain_ignored(), F.lit(False)).alias("skipped"))


def chosen_paths(spark, _):
    return files.selected(PATHS.df(spark), ["src", "lib/test_x.py", "./web/"]).select("path")


def document_files(spark, sf_dir):
    held = files.scannable(files.files_of(table(spark, sf_dir, "documents"), "doc_id", "text"))
    return held.select("path", "size", files.content_hash().alias("file_hash"))


_lang_sql = "CASE " + " ".join(f"WHEN lower(regexp_extract(path, '[.][^.]*$')) IN ({sql_list(e)})" + "".join(f" AND NOT suffix(lower(path), '{n}')" for n in no) + f" THEN '{lang}'" for lang, _, e, no, *_ in files.LANGUAGES) + " END"
_base = "regexp_extract(path, '[^/]*$')"
_test_sql = " OR ".join(
    [f"({_lang_sql} = '{lang}' AND ({' OR '.join([*(f'suffix({_base}, {sql_value(x)})' for x in ends), *(f'prefix({_base}, {sql_value(x)})' for x in starts), *(f'{_base} = {sql_value(x)}' for x in nm)])}))" for lang, _, _, _, ends, starts, nm in files.LANGUAGES if ends or starts or nm]
    + [f"contains({_base}, '.test.')", f"contains({_base}, '.spec.')"] + [f"contains('/' || path, '{d}')" for d in files.TEST_FOLDERS]
)
_rules_cte = "ignore_rules AS (SELECT * FROM (VALUES " + ", ".join(f"({k}, {sql_value(r)}, {str(n).upper()}, {str(f).upper()})" for k, r, n, f in files.parse_ignore([*files.DEFAULT_IGNORE, *IGNORE_LINES])) + ") AS t(ord, regex, negate, folders))"

# ---------------------------------------------------------------- declared fields

DECLARED = [
    ("model.Customer", "struct", False, "Email", "string", {"json": "mail_box,omitempty"}), ("model.Customer", "struct", False, "Name", "string", {}), ("model.Customer", "struct", False, "Phone", "string", {"pii": "-"}),
    ("model.Customer", "struct", False, "Home", "*Address", {}), ("model.Customer", "struct", False, "Orders", "[]Order", {}), ("model.Address", "struct", False, "Street", "string", {"gorm": "column:street_address;size:20"}),
    ("model.Order", "struct", False, "Card", "string", {"pci": "credit_card"}), ("model.Order", "struct", False, "Total", "int", {}), ("View", "class", False, "email", "string", {}), ("lib.Ext", "struct", True, "phone", "string", {}),
    ("table:people", "table", False, "dob", "date", {"pii": "true"}), ("table:people", "table", False, "x1", "text", {"phi": "true"}), ("Card", "entity", False, "holderName", "string", {"@SerializedName": "holder_name"}), ("Proto", "proto", False, "b", "string", {"protobuf": "bytes,1,opt,name=passport_no,proto3"}),
]


def _declared(spark):
    return spark.createDataFrame(DECLARED, schema_hints.FIELDS_SCHEMA)


def declared(spark, _):
    return schema_hints.declared(_declared(spark), taxonomy.data_types(spark)).select("type", "field", "data_type", F.round("confidence", 4).alias("confidence"), "suppressed", "contextual", "via")


HINTED = Fixture(
    "hinted", "type string, kind string, external boolean, field string, field_type string, data_type string, confidence double, suppressed boolean, contextual boolean",
    [("model.Customer", "struct", False, "email", "string", "email", 0.9, False, False), ("model.Customer", "struct", False, "phone", "string", None, 0.0, True, False), ("model.Customer", "struct", False, "home", "*Address", None, 0.0, False, False), ("model.Customer", "struct", False, "orders", "[]Order", None, 0.0, False, False), ("model.Address", "struct", False, "street", "string", "address", 0.9, False, False), ("Order", "struct", False, "card", "string", "credit_card", 1.0, False, False), ("View", "class", False, "email", "string", "email", 0.9, False, False), ("lib.Ext", "struct", True, "phone", "string", "phone", 0.5, False, False), ("Note", "struct", False, "author", "model.Customer", None, 0.0, False, False)],
)


def carried(spark, _):
    rows = HINTED.df(spark)
    return schema_hints.carried(rows, rows.filter("data_type IS NOT NULL OR suppressed"))


def looked_up(spark, _):
    rows = HINTED.df(spark)
    hints = rows.filter("data_type IS NOT NULL OR suppressed")
    reads = spark.createDataFrame([(1, "model.Customer", "Email"), (2, "*Customer", "phone"), (3, "Customer", "home"), (4, "Unknown", "card"), (5, "Unknown", "email"), (6, "", "street"), (7, "Unknown", "nothing")], "id int, owner string, field string")
    return schema_hints.field_lookup(reads, rows, hints).select("id", "state", "data_type", F.round("confidence", 4).alias("confidence"))


def parsed_schemas(spark, _):
    proto = 'message User {\n  string email = 1;\n  repeated string phones = 2 [(pii) = "phone"];\n  message Inner { string zip = 1; // pii: address\n }\n  oneof x { string a = 3; }\n}\n'
    ddl = "CREATE TABLE IF NOT EXISTS app.users (\n id bigint PRIMARY KEY,\n e_mail varchar(20), -- pii: email\n balance decimal(10,2) COMMENT 'pii: bank_account',\n CONSTRAINT c UNIQUE (id)\n);\nALTER TABLE app.users ADD COLUMN dob date;"
    docs = spark.createDataFrame([("a.proto", proto), ("b.sql", ddl), ("c.txt", ddl)], "path string, text string")
    return schema_hints.parse_files(docs).select("type", "kind", "field", "field_type", F.try_element_at("tags", F.lit("pii")).alias("pii"))


# ---------------------------------------------------------------- rules

RULES = json.dumps(
    [
        {"id": "log.python", "lang": "python", "call": ["logging.info", "logging.Logger.*"], "receiver": "(?i)^(log|logger)$", "dest": {"kind": "log"}, "arg": "*"},
        {"id": "sdk.track", "lang": ["python", "kotlin"], "call": "com.track/sdk.Tracker.send", "dest": {"kind": "third_party", "host": "api.track.io", "vendor": "Track"}, "arg": [0, 1]},
        {"id": "net.post", "lang": "*", "call": ["requests.post", "net.Client.post"], "match_bare": True, "dest": {"kind": "network"}, "host_arg": 0, "arg": 1, "arg_not": {"0": "(?i)localhost"}},
        {"id": "xf.mask", "kind": "transform", "lang": "python", "call": "util.Masker.mask", "transform": "masked"},
        {"id": "src.body", "kind": "source", "lang": "python", "field": ["web.Request.body", "*.Request.json"], "receiver": "^req", "data_type": "request_data"},
        {"id": "src.param", "kind": "source", "lang": "java", "param_annotation": ["RequestBody"], "data_type": "request_data"},
        {"id": "api.build", "kind": "api", "lang": "kotlin", "call": ["okhttp3.Request.Builder.*"], "effect": "builder", "receiver": "builder$"},
        {"id": "old.rule", "lang": "python", "call": "x.y", "dest": {"kind": "log"}, "disabled": True},
    ]
)
CALLS = Fixture(
    "calls", "call_id int, lang string, callee string, name string, recv_type string, recv_text string",
    [(1, "python", "logging.info", "info", None, "logging"), (2, "python", None, "debug", None, "logger"), (3, "python", None, "info", "logging.Logger", None), (4, "python", None, "send", "sdk.Tracker", None), (5, "kotlin", None, "send", None, "Tracker"), (6, "java", None, "send", "Tracker", None), (7, "go", None, "post", None, ""), (8, "go", None, "post", None, "client"), (9, "python", "util.Masker.mask", "mask", None, None), (10, "kotlin", None, "header", None, "builder"), (11, "kotlin", "okhttp3.Request.Builder.url", "url", None, None), (12, "python", "requests.get", "get", None, None), (13, "python", "com.track/sdk.Tracker.send", "send", None, None), (14, "python", None, "post", "*net.Client", None)],
)


def matched_calls(spark, _):
    return rules.match_calls(CALLS.df(spark), rules.load(spark, RULES)).select("call_id", "rule", "rule_kind", "match_confidence", "how")


_seg = lambda c: f"regexp_extract(regexp_replace(regexp_replace(coalesce({c}, ''), '^[*&]+', ''), '[<\\[].*$', ''), '[^./]*$')"
_sql_rules = """patterns AS (SELECT * FROM (VALUES
  ('log.python', 'sink', ['python'], '(?i)^(log|logger)$', FALSE, 'logging\\.info', 'info', '', FALSE), ('log.python', 'sink', ['python'], '(?i)^(log|logger)$', FALSE, 'logging\\.Logger\\..*', '.*', '', TRUE),
  ('sdk.track', 'sink', ['python', 'kotlin'], NULL, FALSE, 'com\\.track/sdk\\.Tracker\\.send', 'send', 'Tracker', FALSE),
  ('net.post', 'sink', ['*'], NULL, TRUE, 'requests\\.post', 'post', '', FALSE), ('net.post', 'sink', ['*'], NULL, TRUE, 'net\\.Client\\.post', 'post', 'Client', FALSE),
  ('xf.mask', 'transform', ['python'], NULL, FALSE, 'util\\.Masker\\.mask', 'mask', 'Masker', FALSE), ('api.build', 'api', ['kotlin'], 'builder$', FALSE, 'okhttp3\\.Request\\.Builder\\..*', '.*', '', TRUE)
) AS p(rule, rule_kind, langs, receiver, bare, regex, method, segment, wild))"""

READS = Fixture("reads", "id int, lang string, owner string, field string, recv string", [(1, "python", "web.Request", "body", "r"), (2, "python", "", "body", "req"), (3, "python", "flask.Request", "json", "x"), (4, "python", "Other", "body", "x"), (5, "java", "web.Request", "body", "req"), (6, "python", "*web.Request", "body", None)])


def matched_fields(spark, _):
    return rules.match_fields(READS.df(spark), rules.load(spark, RULES)).select("id", "rule", "match_confidence")


def matched_parameters(spark, _):
    params = spark.createDataFrame([(1, "java", ["RequestBody"]), (2, "java", ["RequestBody:email"]), (3, "kotlin", ["RequestBody"]), (4, "java", ["Valid", "RequestBody"])], "id int, lang string, annotations array<string>")
    return rules.match_parameters(params, rules.load(spark, RULES)).select("id", "rule", "how")


ARGS = Fixture("args", "call_id int, idx int, name string, var int", [(7, 0, "http://localhost:1", 1), (7, 1, "body", 2), (8, 0, "url", 3), (8, 1, "data", 4), (14, -1, "client", 5), (14, 0, "url", 6), (14, 1, "payload", 7), (4, 0, "a", 8), (4, 1, "b", 9), (4, 2, "c", 10), (1, 0, "m", 11), (1, 1, None, 12)])


def sink_arguments(spark, _):
    held = rules.load(spark, RULES)
    return rules.selected_arguments(ARGS.df(spark), rules.match_calls(CALLS.df(spark), held, ("sink",)), held).select("call_id", "idx", "rule", "var")


HOSTS = Fixture("hosts", "id int, constant string, dest_kind string, dest_host string", [(1, "https://api.corp.io/v1?x=1", "network", ""), (2, "api.other.com/x", "network", ""), (3, "/relative", "network", "d.io"), (4, None, "network", "x.corp.io"), (5, "https://API.corp.io", "third_party", ""), (6, "http://corp.io:8080/", "network", ""), (7, "ftp://notcorp.io", "network", "")])


def destinations(spark, _):
    return rules.destination(HOSTS.df(spark), first_party=["corp.io"]).select("id", "dest_host", "dest_kind", "first_party")


def overridden_rules(spark, _):
    extra = json.dumps([{"id": "net.post", "lang": "go", "call": "net.post", "dest": {"kind": "ipc"}}, {"id": "xf.mask", "kind": "transform", "lang": "python", "call": "a.b", "transform": "masked", "disabled": False}, {"id": "new.rule", "lang": "go", "call": "z", "dest": {"kind": "log"}}])
    return rules.override(rules.load(spark, RULES), rules.load(spark, extra)).select("ord", "id", "kind", "dest_kind")


# ---------------------------------------------------------------- program facts

CFG = Fixture("cfg", "func string, from_block int, to_block int", [("f", a, b) for a, b in ((0, 1), (0, 2), (1, 3), (2, 3), (3, 4), (4, 3), (4, 5), (9, 5))] + [("g", 0, 1), ("g", 1, 2)])
CLASS_EDGES = Fixture("class_edges", "sub string, super string, lang string", [("app.Dog", "Animal", "java"), ("app.Puppy", "app.Dog", "java"), ("app.Cat", "*app.Animal", "java"), ("py.Bird", "app.Animal", "python"), ("app.Loop", "app.Loop2", "java"), ("app.Loop2", "app.Loop", "java")])
CLASS_METHODS = Fixture("class_methods", "class string, method string, func string, lang string", [("app.Animal", "say", "Animal.say", "java"), ("app.Dog", "say", "Dog.say", "java"), ("app.Puppy", "say", "Puppy.say", "java"), ("app.Cat", "purr", "Cat.purr", "java"), ("py.Bird", "say", "Bird.say", "python"), ("app.Loop", "go", "Loop.go", "java")])
SITES = Fixture("sites", "call_id int, lang string, target string, recv_type string, name string", [(1, "java", "Animal.say", "app.Animal", "say"), (2, "java", "", "*Dog?", "say"), (3, "python", None, "app.Animal", "say"), (4, "java", "", "app.Loop2", "go"), (5, "java", "X.f", None, "f"), (6, "java", "", "Missing", "say")])
FUNCS = Fixture("funcs", "func string, file string, start_line int, end_line int", [("main", "m.py", 1, 50), ("inner", "m.py", 10, 20), ("save", "s.py", 1, 30), ("send", "n.py", 5, 9), ("other", "o.py", 1, 9), ("far", "z.py", 1, 2)])
EDGES = Fixture("call_edges", "caller string, callee string", [("main", "inner"), ("inner", "save"), ("save", "send"), ("other", "save"), ("far", "other"), ("send", "far"), ("main", "save")])
TRACE = Fixture("trace", "flow int, pos int, file string, line int", [(1, 0, "m.py", 12), (1, 1, "m.py", 15), (1, 2, "s.py", 3), (1, 3, "n.py", 6), (1, 4, "s.py", 9), (2, 0, "x.py", 1), (2, 1, "m.py", 40), (3, 0, "n.py", 7), (3, 1, "s.py", 8)])


def predecessors(spark, _):
    return program.predecessors(CFG.df(spark))


def dominators(spark, _):
    return program.dominators(CFG.df(spark))


def strong_components(spark, _):
    edges = EDGES.df(spark).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return program.components(edges, FUNCS.df(spark).select(F.col("func").alias("node")))


def work_levels(spark, _):
    edges = EDGES.df(spark).select(F.col("caller").alias("src"), F.col("callee").alias("dst"))
    return program.levels(edges, FUNCS.df(spark).select(F.col("func").alias("node")))


IMPORTS = Fixture("imports", "src string, dst string", [("m.py", "s.py"), ("s.py", "n.py"), ("n.py", "m.py"), ("o.py", "s.py"), ("x.py", "y.py")])


def reachable(spark, _):
    entries = spark.createDataFrame([("o.py",), ("z.py",)], "file string")
    return program.reachable_files(entries, IMPORTS.df(spark))


def scan_modes(spark, _):
    files = FUNCS.df(spark).select(F.col("file").alias("path")).distinct()
    changed = spark.createDataFrame([("n.py",)], "file string")
    made = [program.scanned_files(files, m, changed, FUNCS.df(spark), EDGES.df(spark), ["m.py", "o.py"]).select("path", F.lit(m).alias("mode")) for m in ("full", "diff", "paths")]
    return made[0].unionByName(made[1]).unionByName(made[2])


def dispatched(spark, _):
    return program.dispatch(SITES.df(spark), CLASS_EDGES.df(spark), CLASS_METHODS.df(spark)).select("call_id", "target")


def chains(spark, _):
    return program.call_chains(TRACE.df(spark), FUNCS.df(spark), EDGES.df(spark))


def chain_callers(spark, _):
    made = program.call_chains(TRACE.df(spark), FUNCS.df(spark), EDGES.df(spark))
    return program.callers(made, EDGES.df(spark))


def rescans(spark, _):
    changed = spark.createDataFrame([("n.py",)], "file string")
    return program.files_to_rescan(changed, FUNCS.df(spark), EDGES.df(spark))


def order_reach(spark, sf_dir):
    """Nations joined by a supplier's and a customer's part: reachability over a bounded graph of a data folder."""
    pairs = table(spark, sf_dir, "nation").select(F.col("n_regionkey").cast("long").alias("src"), ((F.col("n_nationkey") * 7 + 3) % 25 + 100).cast("long").alias("dst"))
    more = table(spark, sf_dir, "nation").select((F.col("n_nationkey") + 100).cast("long").alias("src"), (F.col("n_nationkey") % 3 + 200).cast("long").alias("dst"))
    return program.closure(pairs.unionByName(more))


CHAIN = 10


def chain_flows(spark, _):
    """A source handed through a chain of functions to a sink, and one that is masked on its way."""
    n = spark.range(CHAIN)
    edges = n.select(F.concat_ws("#", F.lit("f"), F.col("id").cast("string")).alias("src"), F.concat_ws("#", F.lit("f"), (F.col("id") + 1).cast("string")).alias("dst"), F.when(F.col("id") % 5 == 4, 0.95).otherwise(1.0).alias("factor"), F.lit(None).cast("string").alias("transform"), F.lit("c.py").alias("file"), F.col("id").cast("int").alias("line"))
    masked = spark.createDataFrame([("f#3", "g#0", 1.0, "masked", "g.py", 1), ("g#0", "g#1", 1.0, None, "g.py", 2)], "src string, dst string, factor double, transform string, file string, line int")
    seeded = spark.createDataFrame([("f#0", "email", [], 0.9, "variable email", "c.py", 0), ("f#5", "phone", [], 0.85, "variable phone", "c.py", 5)], "var string, data_type string, transforms array<string>, confidence double, source_desc string, file string, line int")
    sinks = spark.createDataFrame([(f"f#{CHAIN}", "f", "10", "log.print", "log", "", 0.8, "c.py", 99), ("g#1", "g", "1", "sdk.track", "third_party", "t.io", 1.0, "g.py", 3)], "node string, func string, var string, sink_rule string, dest_kind string, dest_host string, match_confidence double, file string, line int")
    made = taint.flows(taint.propagate(seeded, edges.unionByName(masked), rounds=CHAIN + 2), sinks)
    return made.select("data_type", "sink_rule", "function", "sink_line", "transforms", "confidence", "source_desc", F.size("path").cast("long").alias("steps"))


def guarded(spark, _):
    cfg = CFG.df(spark)
    branches = spark.createDataFrame([("f", 0, 1, "hasConsent()"), ("g", 0, 1, "optIn"), ("f", 4, 5, "late")], "func string, block int, passing int, check string")
    blocks = cfg.select("func", F.col("to_block").alias("block")).unionByName(cfg.select("func", F.col("from_block").alias("block"))).distinct()
    return taint.guards(branches, program.dominators(cfg), program.predecessors(cfg), blocks)


def inherited(spark, _):
    sites = spark.createDataFrame([("main", "send", ["consent"]), ("other", "send", ["consent", "age"]), ("send", "low", []), ("main", "free", []), ("other", "free", ["consent"])], "caller string, callee string, guards array<string>")
    return taint.inherited_guards(sites)


_reach = lambda src, edges, depth: f"""hop AS (SELECT src, dst, 1 AS hops FROM {edges} UNION SELECT h.src, e.dst, h.hops + 1 FROM hop h JOIN {edges} e ON h.dst = e.src WHERE h.hops < {depth})"""

IR_FUNCS = Fixture("ir_funcs", "func string, file string, start_line int, params array<int>", [("f", "a.py", 1, [0]), ("g", "b.py", 1, []), ("f", "c.py", 1, [])])
IR = Fixture("ir", "func string, idx int, op string, dst int, args array<int>, block int", [("f", 0, "assign", 1, [0], 0), ("f", 1, "assign", 1, [0], 1), ("g", 0, "compute", 2, [7], 0), ("h", 0, "assign", 0, [], 0)])


def ir_problems(spark, _):
    return program.verify(IR_FUNCS.df(spark).limit(2), IR.df(spark), CFG.df(spark).filter("func = 'f' AND to_block <= 2"))


def merged_modules(spark, _):
    return program.merge_modules(IR_FUNCS.df(spark)).select("func", "file")


CACHE = Fixture("cache", "func string, file string, file_hash string, engine string", [("f", "a.py", "1", "e1"), ("g", "b.py", "2", "e1"), ("h", "c.py", "3", "e0"), ("k", "a.py", "9", "e1")])


def cache_valid(spark, _):
    now = spark.createDataFrame([("a.py", "1"), ("b.py", "5"), ("c.py", "3")], "file string, file_hash string")
    return program.valid_summaries(CACHE.df(spark), now, "e1").select("func", "file")


def cache_updated(spark, _):
    new = spark.createDataFrame([("f2", "a.py", "7", "e1")], "func string, file string, file_hash string, engine string")
    return program.updated_summaries(CACHE.df(spark), new, spark.createDataFrame([("a.py",)], "file string"))


def keys(spark, _):
    rows = spark.createDataFrame([(k,) for k in ("email", "phone_number", "user.phone", "free text email", "9email", "x")], "key string")
    return names.classify_keys(rows, "key", taxonomy.data_types(spark)).select("key", F.col("named.data_type").alias("data_type"), F.round("named.confidence", 4).alias("confidence"))


def getters(spark, _):
    rows = spark.createDataFrame([(k,) for k in ("getEmail", "GetPhoneNumber", "Email", "get", "getter", "getX")], "name string")
    return names.classify_getters(rows, "name", taxonomy.data_types(spark)).select("name", F.col("named.data_type").alias("data_type"), F.round("named.confidence", 4).alias("confidence"))


def owned_fields(spark, _):
    rows = spark.createDataFrame([("model.Customer", "name"), ("Card", "holderName"), ("File", "name"), ("Cardholder", "name"), ("*app.User", "Name"), ("", "name"), (None, "email")], "owner string, field string")
    return names.classify_fields(rows, "owner", "field", taxonomy.data_types(spark)).select("owner", "field", F.col("named.data_type").alias("data_type"), F.round("named.confidence", 4).alias("confidence"))


def api_models(spark, _):
    return rules.best_api(rules.match_calls(CALLS.df(spark), rules.load(spark, RULES))).select("call_id", "rule", "match_confidence")


def heuristics(spark, _):
    base = spark.createDataFrame([("sinks", "log", None), ("returns", "size", "int"), ("returns", "get", "any")], "table string, word string, value string")
    extra = spark.createDataFrame([("sinks", "trace", None), ("sinks", "log", None), ("returns", "size", "long")], "table string, word string, value string")
    return rules.merge_heuristics(base, extra)


def call_graph(spark, _):
    sites = SITES.df(spark).select("call_id", F.concat(F.lit("caller"), (F.col("call_id") % 3).cast("string")).alias("func"))
    made = program.dispatch(SITES.df(spark), CLASS_EDGES.df(spark), CLASS_METHODS.df(spark))
    created = spark.createDataFrame([("caller0", "closure$1"), ("caller0", "")], "func string, target string")
    return program.call_graph(sites, made, created)


_classes_sql = """classes AS (SELECT DISTINCT class FROM (SELECT sub AS class FROM class_edges UNION SELECT class FROM class_methods)),
shorts AS (SELECT regexp_extract(class, '[^./:]*$') AS short, min(class) AS class FROM classes GROUP BY 1 HAVING count(*) = 1),
up AS (SELECT sub, regexp_replace(super, '^[*&]+', '') AS written FROM class_edges),
sub AS (SELECT coalesce(c.class, s.class, written) AS src, sub AS dst FROM up LEFT JOIN classes c ON c.class = written LEFT JOIN shorts s ON s.short = regexp_extract(written, '[^./:]*$')),
below AS (SELECT src, dst FROM sub WHERE src != dst UNION SELECT b.src, s.dst FROM below b JOIN sub s ON s.src = b.dst WHERE s.src != s.dst),
recv AS (SELECT *, regexp_replace(regexp_replace(recv_type, '^[*&]+', ''), '[?]$', '') AS r FROM sites WHERE coalesce(recv_type, '') != '' AND name != ''),
roots AS (SELECT r.call_id, r.lang, r.name, coalesce(c.class, s.class, r.r) AS src FROM recv r LEFT JOIN classes c ON c.class = r.r LEFT JOIN shorts s ON s.short = regexp_extract(r.r, '[^./:]*$')),
dispatched AS (SELECT call_id, target FROM sites WHERE coalesce(target, '') != ''
  UNION SELECT r.call_id, m.func FROM roots r JOIN below b ON b.src = r.src JOIN class_methods m ON m.class = b.dst AND m.method = r.name AND (m.lang = '' OR r.lang = '' OR m.lang = r.lang))"""

QUERIES = {
    "C09_keys": keys, "C10_getters": getters, "C11_fields": owned_fields, "R06_api": api_models, "R10_heuristics": heuristics, "T01_call_graph": call_graph,
    "F09_verify": ir_problems, "F13_merge": merged_modules, "I02_cache_valid": cache_valid, "I03_cache_update": cache_updated,
    "C01_tokenize": tokenized, "C07_context": contexts, "C08_ident": identified, "C08_table_columns": table_columns, "C12_sanitizers": sanitizers, "IO02_ignore": ignored, "IO04_paths": chosen_paths,
    "IO05_languages": languages, "IO08_files": document_files, "H01_parsed_schemas": parsed_schemas, "H03_declared_fields": declared, "H04_field_lookup": looked_up, "H05_type_carries": carried,
    "R01_override": overridden_rules, "R03_match_calls": matched_calls, "R04_match_fields": matched_fields, "R05_match_parameters": matched_parameters, "R07_arguments": sink_arguments, "R09_destination": destinations,
    "F11_predecessors": predecessors, "F12_dominators": dominators, "T02_dispatch": dispatched, "T03_components": strong_components, "T06_chain_flows": chain_flows, "T19_guards": guarded, "T19_inherited": inherited,
    "T21_call_chain": chains, "T21_callers": chain_callers, "T22_reach": order_reach, "T22_files": reachable, "T04_levels": work_levels, "I04_modes": scan_modes, "I01_rescan": rescans,
}

_named_sql = lambda key, rows: f"SELECT {key}, data_type, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES {rows}) AS t({key}, data_type, confidence)"

ORACLE_SQL = {
    "C09_keys": _named_sql("key", "('email', 'email', 0.8), ('phone_number', 'phone', 0.8), ('user.phone', 'phone', 0.75), ('free text email', NULL, NULL), ('9email', NULL, NULL), ('x', NULL, NULL)"),
    "C10_getters": _named_sql("name", "('getEmail', 'email', 0.85), ('GetPhoneNumber', 'phone', 0.85), ('Email', 'email', 0.85), ('get', NULL, NULL), ('getter', NULL, NULL), ('getX', NULL, NULL)"),
    "C11_fields": _named_sql("owner, field", "('model.Customer', 'name', 'person_name', 0.6), ('Card', 'holderName', 'cardholder_name', 0.9), ('File', 'name', NULL, NULL), ('Cardholder', 'name', 'cardholder_name', 0.6), ('*app.User', 'Name', 'person_name', 0.6), ('', 'name', NULL, NULL), (NULL, 'email', 'email', 0.9)"),
    "R06_api": "SELECT call_id, rule, CAST(c AS DOUBLE) AS match_confidence FROM (VALUES (10, 'api.build', 0.75), (11, 'api.build', 1.0)) AS t(call_id, rule, c)",
    "R10_heuristics": """SELECT * FROM (VALUES ('sinks', 'log', NULL), ('sinks', 'trace', NULL), ('returns', 'size', 'long'), ('returns', 'get', 'any')) AS t("table", word, value)""",
    "T01_call_graph": f"WITH RECURSIVE {SITES.cte}, {CLASS_EDGES.cte}, {CLASS_METHODS.cte}, {_classes_sql}\nSELECT DISTINCT 'caller' || call_id % 3 AS caller, target AS callee FROM dispatched UNION SELECT 'caller0', 'closure$1'",
    "F09_verify": with_(IR_FUNCS, IR, CFG) + """, known AS (SELECT DISTINCT func FROM ir_funcs WHERE file IN ('a.py', 'b.py')), defined AS (SELECT func, dst AS v FROM ir WHERE dst >= 0 UNION SELECT func, unnest(params) FROM ir_funcs WHERE file IN ('a.py', 'b.py'))
SELECT DISTINCT func, 'unknown function' AS problem, CAST(idx AS VARCHAR) AS detail FROM ir WHERE func NOT IN (SELECT func FROM known)
UNION SELECT func, 'defined twice', CAST(dst AS VARCHAR) FROM ir WHERE dst >= 0 GROUP BY func, dst HAVING count(*) > 1
UNION SELECT func, 'never defined', CAST(a AS VARCHAR) FROM (SELECT func, unnest(args) AS a FROM ir) u WHERE a >= 0 AND NOT EXISTS (SELECT 1 FROM defined d WHERE d.func = u.func AND d.v = u.a)
UNION SELECT func, 'edge to no block', CAST(to_block AS VARCHAR) FROM cfg c WHERE func = 'f' AND to_block <= 2 AND NOT EXISTS (SELECT 1 FROM ir i WHERE i.func = c.func AND i.block = c.to_block)""",
    "F13_merge": with_(IR_FUNCS) + "SELECT CASE WHEN n > 1 THEN func || '~' || n ELSE func END AS func, file FROM (SELECT *, row_number() OVER (PARTITION BY func ORDER BY file, start_line) AS n FROM ir_funcs)",
    "I02_cache_valid": with_(CACHE) + "SELECT func, file FROM cache WHERE engine = 'e1' AND (file, file_hash) IN (('a.py', '1'), ('b.py', '5'), ('c.py', '3'))",
    "I03_cache_update": with_(CACHE) + "SELECT * FROM cache WHERE file != 'a.py' UNION ALL SELECT 'f2', 'a.py', '7', 'e1'",
    "C01_tokenize": with_(NAMES) + f"SELECT name, {SPLIT_SQL} AS tokens FROM names",
    "C08_ident": with_(NAMES, _patterns_cte(), _toks_ctes) + "SELECT n.name, b.data_type, CAST(round(b.c, 4) AS DOUBLE) AS confidence, b.transform, array_to_string(b.ptoks, ' ') AS pattern FROM names n LEFT JOIN best b ON b.name = n.name AND b.r = 1",
    "C08_table_columns": f"WITH names AS (SELECT DISTINCT column_name AS name FROM information_schema.columns WHERE table_name IN ({sql_list(TABLES)})),\n{_patterns_cte()},\n{_toks_ctes}\n"
    + f"SELECT b.data_type, count(*) AS n_columns FROM (SELECT table_name, column_name FROM information_schema.columns WHERE table_name IN ({sql_list(TABLES)})) c LEFT JOIN best b ON b.name = c.column_name AND b.r = 1 GROUP BY b.data_type",
    "C07_context": with_(LABEL_LINES, "names AS (SELECT id, content AS name FROM label_lines)", _patterns_cte()) + f""", said AS (SELECT id, {_singular} AS toks FROM (SELECT id, {SPLIT_SQL} AS raw, [{sql_list(_vocabulary())}] AS vocabulary FROM names))
SELECT s.id, coalesce((SELECT list_sort(list(DISTINCT p.data_type)) FROM patterns p WHERE NOT (p.weak AND p.n = 1 AND length(p.joined) < 3) AND len(list_filter(range(1, len(s.toks) - p.n + 2), lambda i: s.toks[i:i + p.n - 1] = p.toks)) > 0), []) AS context FROM said s""",
    "C12_sanitizers": "SELECT * FROM (VALUES ('maskPhone', 'masked'), ('hashMap', NULL), ('sha256Hex', 'sha256'), ('verifyHash', NULL), ('encryptCard', 'encrypted'), ('tokenize', 'tokenized'), ('redactAll', 'redacted'), ('plain', NULL)) AS t(name, transform)",
    "IO02_ignore": with_(PATHS, _rules_cte) + """, parts AS (SELECT path, string_split(path, '/') AS p FROM paths),
at AS (SELECT path, array_to_string(p[1:k], '/') AS prefix, k < len(p) AS is_folder FROM (SELECT path, p, unnest(range(1, len(p) + 1)) AS k FROM parts)),
met AS (SELECT path, prefix, arg_max(negate, ord) AS kept FROM "at" JOIN ignore_rules ON regexp_matches(prefix, regex) AND (is_folder OR NOT folders) GROUP BY path, prefix)
SELECT path FROM paths WHERE path NOT IN (SELECT path FROM met WHERE NOT kept)""".replace("\nat AS", '\n"at" AS'),
    "IO04_paths": with_(PATHS) + "SELECT path FROM paths WHERE prefix(path, 'src/') OR path = 'lib/test_x.py' OR prefix(path, 'web/')",
    "IO05_languages": with_(PATHS) + f"SELECT path, {_lang_sql} AS lang, coalesce({_test_sql}, FALSE) AS test, coalesce({_lang_sql} = 'go' AND len(list_filter(string_split(path, '/')[:-2], lambda d: d[1] = '.' OR d[1] = '_' OR d = 'testdata')) > 0, FALSE) AS skipped FROM paths",
    "IO08_files": "SELECT CAST(doc_id AS VARCHAR) AS path, strlen(text) AS size, substr(sha256(text), 1, 32) AS file_hash FROM documents WHERE strlen(text) BETWEEN 1 AND 2097152 AND NOT contains(substr(text, 1, 8000), chr(0))",
    "H04_field_lookup": "SELECT id, state, data_type, CAST(confidence AS DOUBLE) AS confidence FROM (VALUES (1, 'sensitive', 'email', 0.9), (2, 'suppressed', NULL, NULL), (3, 'unknown', NULL, NULL), (4, 'sensitive', 'credit_card', 0.95), (5, 'sensitive', 'email', 0.85), (6, 'sensitive', 'address', 0.85), (7, 'unknown', NULL, NULL)) AS t(id, state, data_type, confidence)",
    "H05_type_carries": with_(HINTED) + r""", direct AS (SELECT DISTINCT type, data_type FROM hinted WHERE data_type IS NOT NULL AND NOT suppressed AND confidence >= 0.6),
keyed AS (SELECT type AS of, data_type, unnest(list_distinct([type, regexp_extract(type, '[^./]*$')])) AS key FROM direct),
fields AS (SELECT type, unnest(list_distinct([regexp_replace(field_type, '^[*&]+', ''), regexp_extract(field_type, '[^./*]*$')])) AS key FROM hinted WHERE NOT prefix(field_type, '[]')),
every AS (SELECT * FROM direct UNION SELECT f.type, k.data_type FROM fields f JOIN keyed k USING (key) WHERE f.type != k.of)
SELECT type, list_sort(list(DISTINCT data_type)) AS data_types FROM every WHERE type IN (SELECT type FROM hinted WHERE NOT external AND kind NOT IN ('class', 'object')) GROUP BY type""",
    "R03_match_calls": with_(CALLS, _sql_rules) + f""", hits AS (
  SELECT call_id, rule, rule_kind, 1.0 AS c, 'resolved' AS how FROM calls JOIN patterns ON (name = method OR wild) AND (list_contains(langs, lang) OR list_contains(langs, '*')) AND regexp_full_match(callee, regex) WHERE coalesce(callee, '') != ''
  UNION ALL
  SELECT call_id, rule, rule_kind, s.c, s.how FROM (SELECT *, CASE WHEN wild AND receiver IS NULL THEN NULL
    WHEN segment != '' AND {_seg("recv_type")} = segment THEN {{'c': 0.8, 'how': 'receiver type ' || recv_type}}
    WHEN segment != '' AND coalesce(recv_text, '') != '' AND {_seg("recv_text")} = segment THEN {{'c': 0.8, 'how': 'receiver ' || recv_text}}
    WHEN receiver IS NOT NULL AND coalesce(recv_text, '') != '' AND regexp_matches(recv_text, receiver) THEN {{'c': 0.75, 'how': 'receiver name ' || recv_text}}
    WHEN bare AND NOT wild AND coalesce(recv_text, '') IN ('', 'this') THEN {{'c': 0.6, 'how': 'bare call ' || name}} END AS s
    FROM calls JOIN patterns ON (name = method OR (wild AND regexp_full_match(name, method))) AND (list_contains(langs, lang) OR list_contains(langs, '*')) WHERE coalesce(callee, '') = '') WHERE s IS NOT NULL)
SELECT call_id, rule, rule_kind, CAST(max(c) AS DOUBLE) AS match_confidence, max({{'c': c, 'how': how}}).how AS how FROM hits GROUP BY call_id, rule, rule_kind""",
    "R04_match_fields": with_(READS) + "SELECT id, 'src.body' AS rule, CAST(CASE WHEN (field = 'body' AND regexp_full_match(regexp_replace(owner, '^[*&]+', ''), 'web[.]Request')) OR (field = 'json' AND regexp_full_match(owner, '.*[.]Request')) THEN 1.0 ELSE 0.8 END AS DOUBLE) AS match_confidence FROM reads WHERE lang = 'python' AND ((field = 'body' AND regexp_full_match(regexp_replace(owner, '^[*&]+', ''), 'web[.]Request')) OR (field = 'json' AND regexp_full_match(owner, '.*[.]Request')) OR regexp_matches(recv, '^req'))",
    "R05_match_parameters": "SELECT * FROM (VALUES (1, 'src.param', '@RequestBody'), (4, 'src.param', '@RequestBody')) AS t(id, rule, how)",
    "R07_arguments": with_(ARGS) + "SELECT call_id, idx, CASE call_id WHEN 4 THEN 'sdk.track' WHEN 1 THEN 'log.python' ELSE 'net.post' END AS rule, var FROM args WHERE (call_id = 14 AND idx = 1) OR (call_id = 4 AND idx IN (0, 1)) OR call_id = 1",
    "R09_destination": with_(HOSTS) + r""", at AS (SELECT id, dest_kind, coalesce(nullif(CASE WHEN contains(constant, '://') THEN regexp_extract(constant, '://([^/:?#]*)', 1) WHEN NOT prefix(constant, '/') THEN regexp_extract(constant, '^([^/:?#]*)', 1) END, ''), dest_host) AS dest_host FROM hosts)
SELECT id, dest_host, CASE WHEN own THEN 'first_party' ELSE dest_kind END AS dest_kind, own AS first_party FROM (SELECT *, dest_kind = 'network' AND (lower(dest_host) = 'corp.io' OR suffix(lower(dest_host), '.corp.io')) AS own FROM "at")""".replace(", at AS", ', "at" AS'),
    "F11_predecessors": with_(CFG) + "SELECT DISTINCT func, to_block AS block, from_block AS predecessor FROM cfg",
    "F12_dominators": f"WITH RECURSIVE {CFG.cte}" + """, blocks AS (SELECT DISTINCT func, b FROM (SELECT func, from_block AS b FROM cfg UNION SELECT func, to_block FROM cfg)),
reach AS (SELECT func, CAST(-1 AS INTEGER) AS gone, 0 AS b FROM blocks UNION SELECT func, b, 0 FROM blocks WHERE b != 0 UNION SELECT r.func, r.gone, c.to_block FROM reach r JOIN cfg c ON c.func = r.func AND c.from_block = r.b WHERE c.to_block != r.gone)
SELECT a.func, a.b AS block, d.b AS dominator FROM (SELECT DISTINCT func, b FROM reach WHERE gone = -1) a JOIN (SELECT DISTINCT func, b FROM reach WHERE gone = -1) d ON a.func = d.func
WHERE d.b = 0 OR NOT EXISTS (SELECT 1 FROM reach r WHERE r.func = a.func AND r.gone = d.b AND r.b = a.b)""",
    "T02_dispatch": f"WITH RECURSIVE {SITES.cte}, {CLASS_EDGES.cte}, {CLASS_METHODS.cte}, {_classes_sql}\nSELECT call_id, target FROM dispatched",
    "T03_components": f"WITH RECURSIVE {EDGES.cte}, {FUNCS.cte}, e AS (SELECT caller AS src, callee AS dst FROM call_edges), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src)\nSELECT func AS node, least(func, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.dst = b.src AND b.dst = a.src WHERE a.src = func), func)) AS component FROM funcs",
    "T04_levels": f"""WITH RECURSIVE {EDGES.cte}, {FUNCS.cte}, e AS (SELECT caller AS src, callee AS dst FROM call_edges), r AS (SELECT src, dst FROM e UNION SELECT r.src, e.dst FROM r JOIN e ON r.dst = e.src),
c AS (SELECT func AS node, least(func, coalesce((SELECT min(a.dst) FROM r a JOIN r b ON a.dst = b.src AND b.dst = a.src WHERE a.src = func), func)) AS component FROM funcs),
l AS (SELECT DISTINCT a.component AS a, b.component AS b FROM e JOIN c a ON a.node = e.src JOIN c b ON b.node = e.dst WHERE a.component != b.component),
p AS (SELECT a, b, 1 AS n FROM l UNION SELECT p.a, l.b, p.n + 1 FROM p JOIN l ON l.a = p.b)
SELECT DISTINCT component, coalesce((SELECT max(n) FROM p WHERE p.a = component), 0) AS level FROM c""",
    "T22_files": f"WITH RECURSIVE {IMPORTS.cte}, r AS (SELECT unnest(['o.py', 'z.py']) AS file UNION SELECT i.dst FROM r JOIN imports i ON i.src = r.file)\nSELECT file FROM r",
    "I04_modes": f"""WITH RECURSIVE {FUNCS.cte}, {EDGES.cte}, near AS (SELECT func, 0 AS hops FROM funcs WHERE file = 'n.py' UNION SELECT e.caller, n.hops + 1 FROM near n JOIN call_edges e ON e.callee = n.func WHERE n.hops < 2)
SELECT DISTINCT file AS path, 'full' AS mode FROM funcs UNION ALL SELECT DISTINCT f.file, 'diff' FROM funcs f JOIN near n USING (func) UNION ALL SELECT DISTINCT file, 'paths' FROM funcs WHERE file IN ('m.py', 'o.py')""",
    "T06_chain_flows": """WITH f AS (SELECT list_reduce(list_transform(range(10), lambda i: CAST(CASE WHEN i % 5 = 4 THEN 0.95 ELSE 1.0 END AS DOUBLE)), lambda a, b: a * b) AS whole)
SELECT 'email' AS data_type, 'log.print' AS sink_rule, 'f' AS function, 99 AS sink_line, []::VARCHAR[] AS transforms, floor(0.9::DOUBLE * whole * 0.8::DOUBLE * 100 + 0.5) / 100 AS confidence, 'variable email' AS source_desc, CAST(10 AS BIGINT) AS steps FROM f
UNION ALL SELECT 'phone', 'log.print', 'f', 99, [], floor(0.85::DOUBLE * 0.95::DOUBLE * 0.8::DOUBLE * 100 + 0.5) / 100, 'variable phone', 5
UNION ALL SELECT 'email', 'sdk.track', 'g', 3, ['masked'], 0.9, 'variable email', 5""",
    "T19_guards": with_(CFG) + "SELECT func, b AS block, CASE WHEN func = 'f' AND b = 1 THEN ['hasConsent()'] WHEN func = 'g' AND b IN (1, 2) THEN ['optIn'] ELSE [] END AS guards FROM (SELECT func, from_block AS b FROM cfg UNION SELECT func, to_block FROM cfg)",
    "T19_inherited": "SELECT * FROM (VALUES ('send', ['consent']), ('low', ['consent']), ('free', []::VARCHAR[])) AS t(func, guards)",
    "T21_call_chain": with_(TRACE, FUNCS, EDGES) + """, inner_ AS (SELECT t.flow, t.pos, t.line, coalesce(arg_min(f.func, {'n': f.end_line - f.start_line, 'f': f.func}) FILTER (f.func IS NOT NULL), '?') AS function FROM trace t LEFT JOIN funcs f ON f.file = t.file AND t.line BETWEEN f.start_line AND f.end_line GROUP BY t.flow, t.pos, t.line),
kept AS (SELECT * FROM (SELECT *, lag(function) OVER (PARTITION BY flow ORDER BY pos) AS b FROM inner_) WHERE b IS NULL OR b != function),
moved AS (SELECT *, CASE WHEN EXISTS (SELECT 1 FROM call_edges e WHERE e.caller = p AND e.callee = function) THEN 1 WHEN EXISTS (SELECT 1 FROM call_edges e WHERE e.caller = function AND e.callee = p) THEN -1 ELSE 0 END AS d FROM (SELECT *, lag(function) OVER (PARTITION BY flow ORDER BY pos) AS p FROM kept)),
deep AS (SELECT *, sum(d) OVER (PARTITION BY flow ORDER BY pos) AS s FROM moved)
SELECT flow, CAST(row_number() OVER (PARTITION BY flow ORDER BY pos) - 1 AS INTEGER) AS step, function, line, CAST(s - min(s) OVER (PARTITION BY flow) AS INTEGER) AS depth FROM deep""",
    "T21_callers": with_(TRACE, FUNCS, EDGES) + """, first_ AS (SELECT t.flow, arg_min(f.func, {'n': f.end_line - f.start_line, 'f': f.func}) AS function FROM (SELECT * FROM trace WHERE pos = 0) t JOIN funcs f ON f.file = t.file AND t.line BETWEEN f.start_line AND f.end_line GROUP BY t.flow)
SELECT flow, caller AS function FROM (SELECT DISTINCT x.flow, e.caller, dense_rank() OVER (PARTITION BY x.flow ORDER BY e.caller) AS r FROM first_ x JOIN call_edges e ON e.callee = x.function AND e.caller != x.function) WHERE r <= 5""",
    "T22_reach": "WITH RECURSIVE e AS (SELECT CAST(n_regionkey AS BIGINT) AS src, CAST((n_nationkey * 7 + 3) % 25 + 100 AS BIGINT) AS dst FROM nation UNION SELECT CAST(n_nationkey + 100 AS BIGINT), CAST(n_nationkey % 3 + 200 AS BIGINT) FROM nation),\n" + _reach("", "e", 64) + "\nSELECT src, dst, min(hops) AS hops FROM hop GROUP BY src, dst",
    "H01_parsed_schemas": """SELECT * FROM (VALUES ('User', 'proto', 'email', 'string', NULL), ('User', 'proto', 'phones', '[]string', 'phone'), ('User.Inner', 'proto', 'zip', 'string', 'address'), ('User', 'proto', 'a', 'string', NULL),
  ('table:app.users', 'table', 'id', 'bigint', NULL), ('table:app.users', 'table', 'e_mail', 'varchar(20)', 'email'), ('table:app.users', 'table', 'balance', 'decimal(10,2)', 'bank_account'), ('table:app.users', 'table', 'dob', 'date', NULL)) AS t(type, kind, field, field_type, pii)""",
    "H03_declared_fields": """SELECT type, field, data_type, CAST(confidence AS DOUBLE) AS confidence, suppressed, contextual, via FROM (VALUES
  ('model.Customer', 'Email', 'email', 0.9, FALSE, FALSE, 'field name Email'), ('model.Customer', 'Name', 'person_name', 0.6, FALSE, TRUE, 'field name Name'), ('model.Customer', 'Phone', NULL, 0.0, TRUE, FALSE, 'pii:"-"'),
  ('model.Address', 'Street', 'address', 0.95, FALSE, FALSE, 'gorm:"street_address"'), ('View', 'email', 'email', 0.9, FALSE, FALSE, 'field name email'), ('model.Order', 'Card', 'credit_card', 1.0, FALSE, FALSE, 'pci:"credit_card"'),
  ('lib.Ext', 'phone', 'phone', 0.9, FALSE, FALSE, 'field name phone'), ('Card', 'holderName', 'cardholder_name', 0.95, FALSE, FALSE, '@SerializedName("holder_name")'), ('Proto', 'b', 'passport', 0.95, FALSE, FALSE, 'protobuf:"passport_no"'),
  ('table:people', 'x1', 'phi', 1.0, FALSE, FALSE, 'phi:"phi"'), ('table:people', 'dob', 'dob', 1.0, FALSE, FALSE, 'pii:"dob"')) AS t(type, field, data_type, confidence, suppressed, contextual, via)""",
    "R01_override": "SELECT * FROM (VALUES (0, 'log.python', 'sink', 'log'), (1, 'sdk.track', 'sink', 'third_party'), (2, 'net.post', 'sink', 'ipc'), (3, 'xf.mask', 'transform', NULL), (4, 'src.body', 'source', NULL), (5, 'src.param', 'source', NULL), (6, 'api.build', 'api', NULL), (7, 'new.rule', 'sink', 'log')) AS t(ord, id, kind, dest_kind)",
    "I01_rescan": f"""WITH RECURSIVE {FUNCS.cte}, {EDGES.cte}, near AS (SELECT func, 0 AS hops FROM funcs WHERE file = 'n.py' UNION SELECT e.caller, n.hops + 1 FROM near n JOIN call_edges e ON e.callee = n.func WHERE n.hops < 2)
SELECT DISTINCT f.file, CASE WHEN f.file = 'n.py' THEN 'changed' ELSE 'calls a changed file' END AS why FROM funcs f JOIN near n USING (func)""",
}
