"""Queries on findings: policy, baseline, inventories, graph, report order, evaluation."""

from __future__ import annotations

from pyspark.sql import functions as F

from veilgrid.functions import detect as D
from veilgrid.functions import taxonomy
from veilgrid.operators import baseline, evaluate, explain, inventory, literals, policy
from veilgrid.plans.fixtures import Fixture, sql_list, sql_value, with_
from veilgrid.plans.literal_queries import _cards_sql, digest_sql
from veilgrid.sources import reports
from veilgrid.sources.tables import table

FLOWS = Fixture(
    "flows",
    "flow int, ord int, data_type string, sink_rule string, sink_file string, sink_line int, function string, source_desc string, dest_kind string, dest_host string, "
    "dest_vendor string, first_party boolean, transforms array<string>, guards array<string>, confidence double",
    [
        (1, 1, "email", "log.print", "app/user.py", 10, "app.user.save", "field User.email", "log", "", "", False, [], [], 0.9),
        (2, 2, "email", "sdk.track", "app/user.py", 12, "app.user.save", "field User.email", "third_party", "api.track.io", "Track", False, [], ["hasConsent()"], 0.81),
        (3, 3, "phone", "sdk.track", "app/pay.py", 44, "app.pay.send", "field User.phone", "third_party", "api.track.io", "Track", False, ["hashed"], [], 0.7),
        (4, 4, "password", "net.post", "app/auth.py", 5, "app.auth.login", "parameter password", "network", "auth.corp.io", "", False, [], [], 0.95),
        (5, 5, "password", "log.print", "app/auth.py", 9, "app.auth.login", "parameter password", "log", "", "", False, ["sha256"], [], 0.9),
        (6, 6, "password", "log.print", "app/auth.py", 11, "app.auth.debug", "parameter password", "log", "", "", False, [], [], 0.6),
        (7, 7, "credit_card", "storage.write", "app/pay.py", 50, "app.pay.store", "field Card.number", "storage", "", "", False, ["masked"], [], 0.85),
        (8, 8, "credit_card", "net.post", "app/pay.py", 61, "app.pay.charge", "", "network", "pay.corp.io", "", False, [], [], 0.58),
        (9, 9, "address", "net.post", "app/ship.py", 7, "app.ship.quote", "field Order.address", "first_party", "api.corp.io", "", True, [], [], 0.9),
        (10, 10, "gender", "log.print", "app/x.py", 3, "app.x.f", "variable gender", "log", "", "", False, [], [], 0.3),
        (11, 11, "gender", "ui.show", "app/x.py", 4, "app.x.f", "variable gender", "ui", "", "", False, [], [], 0.9),
        (12, 12, "badge_id", "log.print", "tools/seed.py", 2, "tools.seed.run", "variable badge", "log", "", "", False, [], [], 0.9),
        (13, 13, "health", "ipc.send", "app/h.py", 8, "app.h.send", "field Visit.diagnosis", "ipc", "", "", False, [], ["consentGiven"], 0.77),
        (14, 14, "email", "log.print", "app/user.py", 10, "app.user.save", "field User.email", "log", "", "", False, [], [], 0.5),
    ],
)
STEPS = Fixture("steps", "flow int, step int, function string", [(k, 0, f) for k, f in [(1, "app.user.save"), (4, "app.auth.login"), (5, "app.auth.login"), (6, "app.auth.debug"), (8, "app.pay.charge"), (9, "app.ship.quote"), (13, "app.h.send")]] + [(2, 0, "app.user.load"), (2, 1, "app.user.save"), (3, 0, "app.user.load"), (3, 1, "app.pay.send"), (7, 0, "app.pay.store")])
CALLERS = Fixture("callers", "flow int, function string", [(1, "app.main"), (2, "app.main"), (2, "app.user.save"), (4, "app.main"), (7, "app.pay.charge")])
HINTS = Fixture("hints", "store string, kind string, field string, data_type string", [("table:users", "table", "email", "email"), ("table:users", "table", "phone_no", "phone"), ("Card", "entity", "number", "credit_card"), ("UserView", "struct", "email", "email"), ("Card", "entity", "holder", "cardholder_name")])

POLICY = policy.Policy(
    consent_guarded=("third_party",), ignore_classes=("phi",),
    allow=(policy.Allow(), policy.Allow(sink="log.*", path="tools/**", reason="seed data"), policy.Allow(data_types=("credit_card",), dest_host="pay.*", dest_kinds=("network",))),
)

CLASSES_SQL = "types AS (SELECT * FROM (VALUES " + ", ".join(f"({sql_value(t[1])}, {sql_value(t[3])}, {sql_value(t[4] or t[5] == 'high' or dict(taxonomy.CLASSES).get(t[3]) == 'high')})" for t in taxonomy.DATA_TYPES) + ") AS t(data_type, class, raised))"
KNOWN_SQL = "known AS (SELECT f.*, coalesce(t.class, 'pii') AS class, coalesce(t.raised, FALSE) AS raised FROM flows f LEFT JOIN types t USING (data_type))"


def _flows(spark):
    return taxonomy.lookup(FLOWS.df(spark), taxonomy.data_types(spark)).drop("category", "sensitive")


def _lists(name: str) -> str:
    own = getattr(policy.CREDENTIAL, name)
    default = f"list_value({sql_list(getattr(POLICY, name))})"
    return default if own is None else f"CASE WHEN class = 'credential' THEN list_value({sql_list(own)}) ELSE {default} END"


SEVERITY_SQL = "CASE WHEN dest_kind = 'third_party' THEN 'high' WHEN dest_kind = 'first_party' THEN 'low' WHEN raised THEN 'high' ELSE 'medium' END"
ALLOW_SQL = "CASE WHEN regexp_full_match(sink_rule, 'log\\..*') AND regexp_full_match(sink_file, 'tools/.*') THEN 1 WHEN data_type = 'credit_card' AND regexp_full_match(dest_host, 'pay\\..*') AND dest_kind = 'network' THEN 2 END"
DECIDED_SQL = f"""decided AS (
  SELECT *, {SEVERITY_SQL} AS severity, {ALLOW_SQL} AS entry,
    CASE WHEN class IN ('phi') THEN 'ignored class' WHEN confidence < 0.35 THEN 'confidence' WHEN first_party THEN 'first party'
      WHEN NOT list_contains({_lists("fail_on")}, dest_kind) THEN 'destination' WHEN confidence < 0.55 THEN 'policy confidence'
      WHEN list_has_any(transforms, {_lists("safe_transforms")}) THEN 'transform'
      WHEN len(guards) > 0 AND list_contains({_lists("consent_guarded")}, dest_kind) THEN 'consent'
      WHEN {ALLOW_SQL} IS NOT NULL THEN 'allow' ELSE 'nothing accepts it' END AS decided_by
  FROM known),
stated AS (SELECT *, CASE WHEN decided_by IN ('ignored class', 'confidence') THEN 'dropped' WHEN decided_by IN ('first party', 'destination', 'policy confidence') THEN 'info'
  WHEN decided_by = 'nothing accepts it' THEN 'violation' ELSE 'allowed' END AS status FROM decided)"""


def decide(spark, _):
    return policy.decide(_flows(spark), POLICY).select("flow", "status", "decided_by", "severity", "allowed")


def allow(spark, _):
    return _flows(spark).select("flow", policy.allow_entry(POLICY).alias("entry"))


def severity(spark, _):
    return _flows(spark).select("flow", policy.severity().alias("severity"))


def _cards(spark, sf_dir):
    found = literals.card_findings(table(spark, sf_dir, "documents").select("doc_id", "text"))
    found = policy.apply_literals(taxonomy.lookup(found, taxonomy.data_types(spark)))
    return found.withColumn("fingerprint", baseline.literal_fingerprint("doc_id"))


def literal_policy(spark, sf_dir):
    return _cards(spark, sf_dir).select("doc_id", "line", "col", "data_type", "confidence", "class", "severity", "violation")


def fingerprints(spark, sf_dir):
    return _cards(spark, sf_dir).select("doc_id", "line", "col", "fingerprint")


def flow_fingerprints(spark, _):
    return FLOWS.df(spark).select("flow", baseline.flow_fingerprint().alias("fingerprint"))


def _accepted(spark, sf_dir):
    cards = _cards(spark, sf_dir)
    gone = spark.createDataFrame([("0" * 24, "literal", "email", None, None, None, "gone")], cards.sparkSession.createDataFrame([], "fingerprint string, kind string, data_type string, sink_rule string, dest string, function string, file string").schema)
    return cards, baseline.create(None, cards.filter("confidence < 0.9"), "doc_id").unionByName(gone)


def marked(spark, sf_dir):
    cards, accepted = _accepted(spark, sf_dir)
    return baseline.mark(cards, accepted).select("doc_id", "line", "col", "baselined", "is_new")


def unseen(spark, sf_dir):
    cards, accepted = _accepted(spark, sf_dir)
    return baseline.unseen(accepted, cards).select("fingerprint", "file")


def created(spark, sf_dir):
    return baseline.create(None, _cards(spark, sf_dir), "doc_id").select("fingerprint", "kind", "data_type", "file")


def _applied(spark):
    return policy.apply_flows(_flows(spark), POLICY)


def recipients(spark, _):
    return inventory.recipients(_applied(spark)).select("place", "name", "dest_kind", "flows", "violations", "data_types", "sinks", "transforms", "examples")


def type_inventory(spark, sf_dir):
    return inventory.data_types(_applied(spark), _cards(spark, sf_dir), HINTS.df(spark))


def stores(spark, _):
    return inventory.stores(HINTS.df(spark))


def _graph(spark):
    kept = _applied(spark)
    steps = STEPS.df(spark).join(kept.select("flow"), "flow", "left_semi").unionByName(
        kept.join(STEPS.df(spark), "flow", "left_anti").select("flow", F.lit(0).alias("step"), "function"))
    return inventory.graph(kept, steps, CALLERS.df(spark).join(kept.select("flow"), "flow", "left_semi"))


def graph_nodes(spark, _):
    return _graph(spark)[0]


def graph_edges(spark, _):
    return _graph(spark)[1]


def report_counts(spark, sf_dir):
    cards, accepted = _accepted(spark, sf_dir)
    found = baseline.mark(cards, accepted).select(F.lit("literal").alias("finding"), "is_new", "violation")
    flows = _applied(spark).select(F.lit("flow").alias("finding"), F.col("violation").alias("is_new"), "violation")
    return inventory.counts(found.unionByName(flows))


def report_places(spark, sf_dir):
    cards, accepted = _accepted(spark, sf_dir)
    return inventory.report_order(baseline.mark(cards, accepted), file="doc_id").select("doc_id", "line", "col", "place")


LABELS = Fixture(
    "labels_",
    "case string, data_type string, sink_rule string, function string, ambiguous boolean",
    [("a", "email", "log.print", "user.save", False), ("a", "email", "sdk.track", "save", False), ("a", "phone", "sdk.track", "pay.other", False), ("b", "password", "log.print", "auth.debug", False), ("b", "password", "log.print", "auth.login", True), ("b", "gender", "log.print", "x.f", False)],
)


def _evaluated(spark):
    violations = FLOWS.df(spark).withColumn("case", F.when(F.col("flow") <= 3, "a").when(F.col("flow") == 14, "a").otherwise("b")).select("case", "data_type", "sink_rule", "function", "confidence")
    return evaluate.outcomes(evaluate.at_thresholds(violations), LABELS.df(spark))


def score(spark, _):
    return evaluate.score(_evaluated(spark).filter("threshold = 0.35"), "case")


def sweep(spark, _):
    return evaluate.score(_evaluated(spark), "threshold")


def by_parts(spark, _):
    return evaluate.score_by_parts(_evaluated(spark).filter("threshold = 0.35"))


def gates(spark, _):
    limits = spark.createDataFrame([("a", 0.9, 0.5), ("b", 0.1, 0.5)], "case string, min_precision double, min_recall double")
    return evaluate.failing(evaluate.score(_evaluated(spark).filter("threshold = 0.35"), "case"), limits).select("case", "precision", "recall")


def label_rates(spark, sf_dir):
    """Documents with a card found, scored against the quality labels as a stand-in for truth."""
    found = _cards(spark, sf_dir).select("doc_id").distinct().withColumn("hit", F.lit(1))
    labelled = table(spark, sf_dir, "labels").join(found, "doc_id", "left").withColumn("hit", F.coalesce("hit", F.lit(0)))
    sums = labelled.agg(F.sum(F.col("hit") * F.col("quality")).alias("tp"), F.sum(F.col("hit") * (1 - F.col("quality"))).alias("fp"), F.sum((1 - F.col("hit")) * F.col("quality")).alias("fn"))
    return evaluate.with_rates(sums)


def event_timing(spark, sf_dir):
    runs = table(spark, sf_dir, "events").select(F.col("event_type").alias("case"), F.col("value").alias("wall_ms"))
    return evaluate.timing(runs)


NOTES = Fixture(
    "note_lines", "file string, line int, content string",
    [("a.py", 1, "# ruleid: log.print, net.post"), ("a.py", 2, "# ok: sdk.track"), ("a.py", 3, "log(email)"), ("a.py", 4, "x = 1"), ("a.py", 5, "  // todook: log.print"), ("a.py", 6, "log(x)"), ("a.py", 7, "y = 1 # ruleid: not.whole"), ("b.go", 1, "/* todoruleid: net.post */"), ("b.go", 2, "send(phone)"), ("b.go", 3, "# ruleid: at.end")],
)
REPORTED = Fixture("reported", "sink_file string, sink_line int, sink_rule string, violation boolean", [("a.py", 3, "log.print", True), ("a.py", 3, "sdk.track", True), ("a.py", 4, "log.print", True), ("b.go", 2, "net.post", False)])


def annotations(spark, _):
    return evaluate.annotations(NOTES.df(spark))


def annotation_check(spark, _):
    return evaluate.check_annotations(evaluate.annotations(NOTES.df(spark)).filter("line IS NOT NULL"), REPORTED.df(spark))


def sarif_levels(spark, sf_dir):
    """How many results of each SARIF level the marked cards and the decided flows give."""
    cards, accepted = _accepted(spark, sf_dir)
    found = reports.literal_findings(baseline.mark(cards, accepted), "doc_id").unionByName(
        reports.flow_findings(_applied(spark).withColumn("fingerprint", baseline.flow_fingerprint()).withColumn("is_new", F.col("violation"))))
    return reports.sarif_results(found).groupBy("level").agg(F.count("*").alias("n"))


def csv_inventory(spark, _):
    return reports.flow_inventory(_applied(spark)).select("data_type", "sink_rule", "dest_kind", "transforms", "guards", "file", "line", "violation")


def _changed(spark):
    return policy.changes(policy.decide(_flows(spark), POLICY), POLICY)


def policy_changes(spark, _):
    said = F.transform("changes", lambda c: F.concat_ws(" ", c["setting"], c["action"], c["value"], F.lit("->"), c["status"]))
    return _changed(spark).select("flow", "reason", F.array_join(said, "; ").alias("changes"))


def explained(spark, _):
    return explain.story(_changed(spark), STEPS.df(spark))


def picked(spark, _):
    flows = FLOWS.df(spark).withColumn("fingerprint", baseline.flow_fingerprint())
    return explain.select(flows, "app/user.py:10", "sink_file", "sink_line").select("flow").unionByName(explain.select(flows, "").filter("flow = 7").select("flow"))


def mermaid(spark, _):
    return inventory.mermaid(_graph(spark)[1])


def graph_filters(spark, _):
    made = inventory.graph_flows(_applied(spark), STEPS.df(spark), CALLERS.df(spark), "^app[.](main|pay[.])", ["email", "credit_card", "phone"])
    every = inventory.graph_flows(_applied(spark), STEPS.df(spark), CALLERS.df(spark), violations_only=False)
    return made.select("flow", F.lit("filtered").alias("shown")).unionByName(every.select("flow", F.lit("all").alias("shown")))


def dot_rows(spark, _):
    return inventory.dot(*_graph(spark)).select(F.col("line").cast("long").alias("line"), "text")


FOUND = Fixture(
    "found", "file string, test boolean, data_type string, class string, confidence double",
    [("src/a.py", False, "email", "pii", 0.8), ("src/a_test.py", True, "email", "pii", 0.8), ("src/b_test.py", True, "credit_card", "pci", 0.95), ("x/CONTRIBUTING.md", False, "email", "pii", 0.9), ("i18n/en.json", False, "email", "pii", 0.9), ("t/key_test.py", True, "api_key", "credential", 0.95), ("docs/authors.txt", False, "us_ssn", "pii", 0.92), ("src/w.py", False, "us_ssn", "pii", 0.59)],
)


def file_rules(spark, _):
    return literals.file_rules(FOUND.df(spark))


# ---------------------------------------------------------------- SQL

_cards_cte = "cards AS (" + _cards_sql("documents", "doc_id", "text") + "),\nprinted AS (SELECT *, " + digest_sql("'literal'", "data_type", "CAST(doc_id AS VARCHAR)", "value_hash") + " AS fingerprint FROM cards)"
_accepted_cte = _cards_cte + ",\naccepted AS (SELECT DISTINCT fingerprint, CAST(doc_id AS VARCHAR) AS file FROM printed WHERE confidence < 0.9 UNION ALL SELECT repeat('0', 24), 'gone')"
_marked_cte = _accepted_cte + ",\nmarked AS (SELECT *, fingerprint IN (SELECT fingerprint FROM accepted) AS baselined FROM printed)"
_flow_ctes = (FLOWS, CLASSES_SQL, KNOWN_SQL, DECIDED_SQL)
_applied_cte = "applied AS (SELECT *, status = 'violation' AS violation, CASE WHEN dest_vendor != '' THEN dest_vendor WHEN dest_host != '' THEN dest_host ELSE dest_kind || ' (unknown host)' END AS name FROM stated WHERE status != 'dropped')"
_kind_rank = "CASE dest_kind WHEN 'third_party' THEN 1 WHEN 'network' THEN 2 WHEN 'ipc' THEN 3 WHEN 'log' THEN 4 WHEN 'storage' THEN 5 WHEN 'first_party' THEN 6 ELSE 0 END"
_few = lambda by, value, n: f"(SELECT {by}, list(v ORDER BY o, v) AS held FROM (SELECT {by}, v, o, row_number() OVER (PARTITION BY {by} ORDER BY o, v) AS r FROM (SELECT {by}, {value} AS v, min(ord) AS o FROM applied WHERE {value} != '' GROUP BY {by}, {value})) WHERE r <= {n} GROUP BY {by})"
_graph_cte = """said AS (SELECT s.flow, s.step, s.function FROM steps s WHERE s.flow IN (SELECT flow FROM applied) UNION ALL SELECT flow, 0, function FROM applied WHERE flow NOT IN (SELECT flow FROM steps)),
chain AS (SELECT flow, step AS place, 'fn:' || function AS id FROM said
  UNION ALL SELECT flow, -1, 'src:' || data_type || ':' || CASE WHEN source_desc != '' THEN source_desc ELSE sink_file || ':' || sink_line END FROM applied
  UNION ALL SELECT flow, 2147483647, 'sink:' || sink_rule || ':' || sink_file || ':' || sink_line FROM applied),
called AS (SELECT c.flow, 'fn:' || c.function AS id FROM callers c WHERE c.flow IN (SELECT flow FROM applied))"""
_nodes_cte = """nodes AS (SELECT id, CASE max(k) WHEN 1 THEN 'caller' WHEN 2 THEN 'function' WHEN 3 THEN 'source' ELSE 'sink' END AS kind,
  CASE max(rank) WHEN 3 THEN 'high' WHEN 2 THEN 'medium' WHEN 1 THEN 'low' END AS severity
FROM (SELECT c.id, CASE WHEN place = -1 THEN 3 WHEN place = 2147483647 THEN 4 ELSE 2 END AS k, CASE severity WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END AS rank FROM chain c JOIN applied USING (flow)
  UNION ALL SELECT id, 1, 0 FROM called) GROUP BY id)"""
_edges_cte = """edges AS (SELECT from_id, to_id, coalesce(list_sort(list(DISTINCT data_type) FILTER (data_type IS NOT NULL)), []) AS data_types, bool_and(calls) AS calls FROM (
  SELECT c.id AS from_id, c.to_id, a.data_type, FALSE AS calls FROM (SELECT flow, id, lead(id) OVER (PARTITION BY flow ORDER BY place) AS to_id FROM chain) c JOIN applied a USING (flow)
  UNION ALL SELECT k.id, e.entry, NULL, TRUE FROM called k JOIN (SELECT flow, 'fn:' || arg_min(function, step) AS entry FROM said GROUP BY flow) e USING (flow)
) WHERE from_id != to_id GROUP BY from_id, to_id)"""
_rate_sql = """CASE WHEN tp + fp = 0 THEN 1.0 ELSE tp / (tp + fp) END AS precision, CASE WHEN tp + fn = 0 THEN 1.0 ELSE tp / (tp + fn) END AS recall"""
_eval_cte = f"""thresholds AS (SELECT unnest([{", ".join(map(str, evaluate.THRESHOLDS))}])::DOUBLE AS threshold),
said AS (SELECT flow, CASE WHEN flow <= 3 OR flow = 14 THEN 'a' ELSE 'b' END AS "case", data_type, sink_rule, function, threshold FROM flows, thresholds WHERE confidence >= threshold),
told AS (SELECT *, row_number() OVER () AS lid FROM labels_),
met AS (SELECT s.flow, s.threshold, l.lid, l.ambiguous FROM said s JOIN told l ON s."case" = l."case" AND s.data_type = l.data_type AND s.sink_rule = l.sink_rule
  AND (s.function = l.function OR suffix(s.function, '.' || l.function) OR suffix(s.function, ':' || l.function) OR suffix(s.function, '/' || l.function))),
hits AS (SELECT flow, threshold, bool_or(NOT ambiguous) AS hit FROM met GROUP BY ALL),
outcome AS (
  SELECT s."case", s.data_type, split_part(s.sink_rule, '.', 1) AS sink, s.threshold, 0 AS tp, CAST(h.hit IS NULL AS INT) AS fp, 0 AS fn, CAST(h.hit IS NOT NULL AS INT) AS ambiguous
  FROM said s LEFT JOIN hits h USING (flow, threshold) WHERE h.hit IS NULL OR NOT h.hit
  UNION ALL
  SELECT l."case", l.data_type, split_part(l.sink_rule, '.', 1), t.threshold, CAST(m.lid IS NOT NULL AS INT), 0, CAST(m.lid IS NULL AS INT), 0
  FROM told l CROSS JOIN thresholds t LEFT JOIN (SELECT DISTINCT lid, threshold FROM met WHERE NOT ambiguous) m ON m.lid = l.lid AND m.threshold = t.threshold WHERE NOT l.ambiguous)"""
_sums = "CAST(sum(tp) AS BIGINT) AS tp, CAST(sum(fp) AS BIGINT) AS fp, CAST(sum(fn) AS BIGINT) AS fn, CAST(sum(ambiguous) AS BIGINT) AS ambiguous"
_rated = lambda inner: f"SELECT *, CASE WHEN precision + recall = 0 THEN 0.0 ELSE 2 * precision * recall / (precision + recall) END AS f1 FROM (SELECT *, {_rate_sql} FROM ({inner}))"
_note_re = r"^\s*(?://|#|--|/\*)\s*(ruleid|ok|todoruleid|todook):\s*([A-Za-z0-9_.,\- ]+?)\s*(?:\*/)?\s*$"
_notes_cte = f"""seen0 AS (SELECT *, regexp_extract(content, '{_note_re}', 1) AS mark, regexp_extract(content, '{_note_re}', 2) AS ids FROM note_lines),
seen AS (SELECT *, min(CASE WHEN mark = '' THEN line END) OVER (PARTITION BY file ORDER BY line ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS target FROM seen0),
notes AS (SELECT file, mark, trim(u) AS rule_id, target AS line FROM (SELECT file, mark, target, unnest(string_split(ids, ',')) AS u FROM seen WHERE mark != ''))"""

_own = "CASE class WHEN 'credential' THEN 'policy.classes.credential.' ELSE 'policy.' END"  # settings that the class has lists of its own for
_told_cte = f"""told AS (SELECT *, CASE decided_by
    WHEN 'ignored class' THEN 'policy.ignore_classes: ' || class WHEN 'confidence' THEN 'min_confidence: ' || printf('%.2f', confidence) || ' < 0.35'
    WHEN 'first party' THEN 'first_party_domains: ' || dest_host WHEN 'destination' THEN {_own} || 'fail_on: no ' || dest_kind
    WHEN 'policy confidence' THEN 'policy.min_confidence: ' || printf('%.2f', confidence) || ' < 0.55'
    WHEN 'transform' THEN {_own} || 'safe_transforms: ' || array_to_string(transforms, ', ') WHEN 'consent' THEN 'policy.consent_guarded: ' || dest_kind || ' after ' || array_to_string(guards, '; ')
    WHEN 'allow' THEN CASE entry WHEN 1 THEN 'policy.allow[1]: seed data' ELSE 'policy.allow[2]: ' END ELSE {_own} || 'fail_on: ' || dest_kind || ' at ' || printf('%.2f', confidence) END AS reason,
  list_filter([
    CASE decided_by WHEN 'confidence' THEN ['min_confidence', 'lower', printf('%.2f', floor(confidence * 100 + 1e-9) / 100), 'shown'] WHEN 'first party' THEN ['first_party_domains', 'remove', dest_host, 'violation']
      WHEN 'destination' THEN [{_own} || 'fail_on', 'add', dest_kind, 'violation'] WHEN 'policy confidence' THEN ['policy.min_confidence', 'lower', printf('%.2f', floor(confidence * 100 + 1e-9) / 100), 'violation']
      WHEN 'transform' THEN [{_own} || 'safe_transforms', 'remove', array_to_string(transforms, ', '), 'violation'] WHEN 'consent' THEN ['policy.consent_guarded', 'remove', dest_kind, 'violation']
      WHEN 'allow' THEN ['policy.allow', 'remove', CAST(entry AS VARCHAR), 'violation'] END,
    CASE WHEN status = 'violation' AND dest_host != '' AND dest_kind IN ('network', 'third_party') THEN ['first_party_domains', 'add', dest_host, 'info'] END,
    CASE WHEN status = 'violation' AND len(guards) > 0 THEN ['policy.consent_guarded', 'add', dest_kind, 'allowed'] END,
    CASE WHEN status = 'violation' AND len(transforms) > 0 THEN ['policy.safe_transforms', 'add', array_to_string(transforms, ', '), 'allowed'] END,
    CASE WHEN status = 'violation' AND confidence - 0.55 < 0.1 THEN ['policy.min_confidence', 'raise', printf('%.2f', confidence), 'info'] END,
    CASE WHEN status = 'violation' THEN [{_own} || 'fail_on', 'remove', dest_kind, 'info'] END], lambda c: c IS NOT NULL) AS changes FROM stated)"""

QUERIES = {
    "P01_decide": decide, "P03_allow": allow, "P05_severity": severity, "P04_literals": literal_policy, "B01_fingerprints": fingerprints, "B01_flow_fingerprints": flow_fingerprints,
    "B03_mark": marked, "B03_unseen": unseen, "B04_create": created, "M01_recipients": recipients, "M02_data_types": type_inventory, "M03_stores": stores, "G01_nodes": graph_nodes,
    "G01_edges": graph_edges, "V01_counts": report_counts, "V02_sorted": report_places, "A01_score": score, "A03_sweep": sweep, "A04_by_parts": by_parts, "A05_gates": gates,
    "A02_label_rates": label_rates, "A06_timing": event_timing, "A07_annotations": annotations, "A07_check": annotation_check, "IO13_sarif_levels": sarif_levels, "IO14_csv": csv_inventory, "P06_changes": policy_changes, "E01_story": explained, "E02_select": picked, "IO15_mermaid": mermaid, "IO15_dot": dot_rows, "G02_filters": graph_filters, "L25_file_rules": file_rules,
}

ORACLE_SQL = {
    "P01_decide": with_(*_flow_ctes) + "SELECT flow, status, decided_by, severity, CASE decided_by WHEN 'transform' THEN 'transform: ' || array_to_string(transforms, ',') WHEN 'consent' THEN 'consent: ' || array_to_string(guards, '; ') WHEN 'allow' THEN CASE entry WHEN 1 THEN 'allow: seed data' ELSE 'allow' END END AS allowed FROM stated",
    "IO13_sarif_levels": with_(*_flow_ctes, _applied_cte, _marked_cte) + """SELECT level, count(*) AS n FROM (
  SELECT CASE WHEN baselined THEN 'note' ELSE 'error' END AS level FROM marked
  UNION ALL SELECT CASE WHEN NOT violation THEN 'note' WHEN severity = 'high' THEN 'error' WHEN severity = 'medium' THEN 'warning' ELSE 'note' END FROM applied) GROUP BY level""",
    "IO14_csv": with_(*_flow_ctes, _applied_cte) + "SELECT data_type, sink_rule, dest_kind, array_to_string(transforms, ';') AS transforms, array_to_string(guards, ';') AS guards, sink_file AS file, sink_line AS line, violation FROM applied",
    "P06_changes": with_(*_flow_ctes, _told_cte) + "SELECT flow, reason, array_to_string(list_transform(changes, lambda c: c[1] || ' ' || c[2] || ' ' || c[3] || ' -> ' || c[4]), '; ') AS changes FROM told",
    "E01_story": with_(*_flow_ctes, _told_cte, STEPS) + """, parts AS (
  SELECT flow, 0 AS a, 0 AS b, 'source' AS part, CASE WHEN source_desc != '' THEN source_desc ELSE 'a value' END || ' holds ' || data_type AS text FROM flows
  UNION ALL SELECT flow, 1, step, 'step', 'through ' || function FROM steps
  UNION ALL SELECT flow, 2, 0, 'sink', sink_file || ':' || sink_line || ' matches ' || sink_rule || ', which sends to ' || dest_kind || CASE WHEN dest_host != '' THEN ' ' || dest_host ELSE '' END FROM flows
  UNION ALL SELECT flow, 3, 0, 'policy', status || ': ' || reason FROM told
  UNION ALL SELECT flow, 4, generate_subscripts(changes, 1), 'change', unnest(list_transform(changes, lambda c: c[1] || ': ' || c[2] || ' ' || c[3] || ', then ' || c[4])) FROM told)
SELECT flow, CAST(row_number() OVER (PARTITION BY flow ORDER BY a, b) AS INTEGER) AS place, part, text FROM parts""",
    "E02_select": "SELECT unnest([1, 14, 7]) AS flow",
    "IO15_mermaid": with_(*_flow_ctes, _applied_cte, STEPS, CALLERS, _graph_cte, _edges_cte) + """SELECT '  n' || substr(sha256(from_id), 1, 8) || '["' || replace(from_id, '"', '\'\'') || '"]' ||
  CASE WHEN calls THEN ' -.-> ' ELSE ' -->|' || array_to_string(data_types, ', ') || '| ' END || 'n' || substr(sha256(to_id), 1, 8) || '["' || replace(to_id, '"', '\'\'') || '"]' AS text FROM edges""",
    "G02_filters": with_(*_flow_ctes, _applied_cte, STEPS, CALLERS) + """, there AS (SELECT flow FROM (SELECT flow, function FROM steps UNION ALL SELECT flow, function FROM callers UNION ALL SELECT flow, function FROM flows) WHERE regexp_matches(function, '^app[.](main|pay[.])'))
SELECT flow, 'filtered' AS shown FROM applied WHERE violation AND data_type IN ('email', 'credit_card', 'phone') AND flow IN (SELECT flow FROM there) UNION ALL SELECT flow, 'all' FROM applied""",
    "IO15_dot": with_(*_flow_ctes, _applied_cte, STEPS, CALLERS, _graph_cte, _edges_cte, _nodes_cte) + """, parts AS (
  SELECT 0 AS part, 'digraph flows {' AS text UNION ALL SELECT 3, '}'
  UNION ALL SELECT 1, '  "' || replace(id, '"', '\\"') || '" [class=' || kind || '];' FROM nodes
  UNION ALL SELECT 2, '  "' || replace(from_id, '"', '\\"') || '" -> "' || replace(to_id, '"', '\\"') || '"' || CASE WHEN calls THEN ' [style=dashed]' ELSE ' [label="' || array_to_string(data_types, ', ') || '"]' END || ';' FROM edges)
SELECT CAST(row_number() OVER (ORDER BY part, text) AS BIGINT) AS line, text FROM parts""",
    "L25_file_rules": with_(FOUND) + f"""SELECT * FROM (SELECT file, test, data_type, class, CASE WHEN test AND class != 'credential' THEN floor(confidence * 0.6 * 100 + 0.5) / 100 ELSE confidence END AS confidence FROM found)
WHERE confidence >= 0.6 AND NOT (data_type = 'email' AND (regexp_matches('/' || lower(file), '/(i18n|l10n|locales|locale|translations)/') OR regexp_matches(upper(regexp_extract(file, '[^/]*$')), '^({"|".join(literals.COMMUNITY_FILES)})')))""",
    "P03_allow": with_(*_flow_ctes[:3]) + f"SELECT flow, {ALLOW_SQL} AS entry FROM known",
    "P05_severity": with_(*_flow_ctes[:3]) + f"SELECT flow, {SEVERITY_SQL} AS severity FROM known",
    "P04_literals": "WITH " + _cards_cte + "\nSELECT doc_id, line, col, data_type, confidence, class, severity, TRUE AS violation FROM printed",
    "B01_fingerprints": "WITH " + _cards_cte + "\nSELECT doc_id, line, col, fingerprint FROM printed",
    "B01_flow_fingerprints": with_(FLOWS) + f"SELECT flow, {digest_sql(sql_value('flow'), 'data_type', 'sink_rule', 'dest_host', 'function').replace('|| chr(0) || function', '|| chr(124) || dest_kind || chr(0) || function')} AS fingerprint FROM flows",
    "B03_mark": "WITH " + _marked_cte + "\nSELECT doc_id, line, col, baselined, NOT baselined AS is_new FROM marked",
    "B03_unseen": "WITH " + _accepted_cte + "\nSELECT fingerprint, file FROM accepted WHERE fingerprint NOT IN (SELECT fingerprint FROM printed)",
    "B04_create": "WITH " + _cards_cte + "\nSELECT DISTINCT fingerprint, 'literal' AS kind, data_type, CAST(doc_id AS VARCHAR) AS file FROM printed",
    "M01_recipients": with_(*_flow_ctes, _applied_cte) + f"""SELECT CAST(row_number() OVER (ORDER BY {_kind_rank}, name, dest_kind, dest_host, dest_vendor) AS INTEGER) AS place, name, dest_kind, flows, violations, data_types, sinks, transforms, held AS examples
FROM (SELECT dest_kind, dest_host, dest_vendor, any_value(name) AS name, count(*) AS flows, count(*) FILTER (violation) AS violations, list_sort(list(DISTINCT data_type)) AS data_types,
  list_sort(list(DISTINCT sink_rule)) AS sinks, list_sort(list_distinct(flatten(list(transforms)))) AS transforms FROM applied GROUP BY dest_kind, dest_host, dest_vendor)
JOIN {_few("dest_kind, dest_host, dest_vendor", "sink_file || ':' || sink_line", 5)} USING (dest_kind, dest_host, dest_vendor)""",
    "M02_data_types": with_(*_flow_ctes, _applied_cte, HINTS, _cards_cte.replace("cards AS", "cards AS", 1)) + f"""SELECT data_type, coalesce(r, []) AS recipients, coalesce(held, []) AS sources, coalesce(s, []) AS stored_in, coalesce(n, 0) AS committed
FROM (SELECT data_type, list_sort(list(DISTINCT name)) AS r FROM applied GROUP BY data_type) LEFT JOIN {_few("data_type", "source_desc", 6)} USING (data_type)
FULL JOIN (SELECT data_type, list_sort(list(DISTINCT regexp_replace(store, '^table:', '')) FILTER (kind IN ('entity', 'table', 'proto'))) AS s FROM hints GROUP BY data_type) USING (data_type)
FULL JOIN (SELECT data_type, count(*) AS n FROM printed GROUP BY data_type) USING (data_type)""",
    "M03_stores": with_(HINTS) + "SELECT store, kind, list_sort(list(DISTINCT field || '=' || data_type)) AS fields FROM hints GROUP BY store, kind",
    "G01_nodes": with_(*_flow_ctes, _applied_cte, STEPS, CALLERS, _graph_cte, _nodes_cte) + "SELECT * FROM nodes",
    "G01_edges": with_(*_flow_ctes, _applied_cte, STEPS, CALLERS, _graph_cte, _edges_cte) + "SELECT * FROM edges",
    "V01_counts": with_(*_flow_ctes, _applied_cte, _marked_cte) + """SELECT 'flow' AS finding, count(*) FILTER (violation) AS n_new, CAST(0 AS BIGINT) AS n_baselined, count(*) FILTER (NOT violation) AS n_accepted FROM applied
UNION ALL SELECT 'literal', count(*) FILTER (NOT baselined), count(*) FILTER (baselined), CAST(0 AS BIGINT) FROM marked HAVING count(*) > 0""",
    "V02_sorted": "WITH " + _marked_cte + "\nSELECT doc_id, line, col, row_number() OVER (ORDER BY baselined, doc_id, line, col, data_type) AS place FROM marked",
    "A01_score": with_(FLOWS, LABELS, _eval_cte) + _rated(f"SELECT \"case\", {_sums} FROM outcome WHERE threshold = 0.35 GROUP BY \"case\""),
    "A03_sweep": with_(FLOWS, LABELS, _eval_cte) + _rated(f"SELECT threshold, {_sums} FROM outcome GROUP BY threshold"),
    "A04_by_parts": with_(FLOWS, LABELS, _eval_cte) + _rated(f"SELECT data_type, sink, {_sums} FROM outcome WHERE threshold = 0.35 GROUP BY GROUPING SETS ((data_type), (sink), ())"),
    "A05_gates": with_(FLOWS, LABELS, _eval_cte) + f"SELECT \"case\", precision, recall FROM ({_rated(f'SELECT chr(97) AS x, \"case\", {_sums} FROM outcome WHERE threshold = 0.35 GROUP BY \"case\"')}) JOIN (VALUES ('a', 0.9, 0.5), ('b', 0.1, 0.5)) AS g(c, min_precision, min_recall) ON g.c = \"case\" WHERE precision < min_precision - 1e-9 OR recall < min_recall - 1e-9",
    "A02_label_rates": "WITH " + _cards_cte + ",\nhit AS (SELECT quality, doc_id IN (SELECT doc_id FROM printed) AS h FROM labels)\n" + _rated("SELECT count(*) FILTER (h AND quality = 1) AS tp, count(*) FILTER (h AND quality = 0) AS fp, count(*) FILTER (NOT h AND quality = 1) AS fn FROM hit"),
    "A06_timing": 'SELECT event_type AS "case", count(*) AS runs, quantile_cont(CAST(value AS DOUBLE), 0.5) AS median_ms, min(value) AS min_ms, max(value) AS max_ms FROM events GROUP BY event_type',
    "A07_annotations": with_(NOTES, _notes_cte) + "SELECT file, mark, rule_id, line FROM notes",
    "A07_check": with_(NOTES, REPORTED, _notes_cte) + """, leaks AS (SELECT sink_file AS file, sink_line AS line, sink_rule AS rule_id, bool_or(violation) AS leak FROM reported GROUP BY ALL),
told AS (SELECT n.file, n.line, n.rule_id, CASE WHEN mark = 'ruleid' AND l.leak IS NULL THEN 'no finding' WHEN mark = 'ok' AND l.leak THEN 'unexpected violation'
  WHEN mark = 'todoruleid' AND l.leak IS NOT NULL THEN 'now reported' WHEN mark = 'todook' AND NOT coalesce(l.leak, FALSE) THEN 'no longer reported' END AS problem
  FROM notes n LEFT JOIN leaks l ON l.file = n.file AND l.line = n.line AND l.rule_id = n.rule_id WHERE n.line IS NOT NULL)
SELECT * FROM told WHERE problem IS NOT NULL
UNION ALL SELECT file, line, rule_id, 'unannotated violation' FROM leaks l WHERE leak AND NOT EXISTS (SELECT 1 FROM notes n WHERE n.file = l.file AND n.line = l.line AND n.rule_id = l.rule_id)""",
}
