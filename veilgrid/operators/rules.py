"""Rule matching: call sites, field reads and parameters against declarative rules.

Rules are tables, so a deployment brings its own (``load`` reads a YAML or JSON
document). Call patterns carry the method name, so most rules meet calls by an
equality join; only wildcard names are compared one by one, against a broadcast side
of the rules' own size.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.sources.documents import records

KINDS = ("sink", "source", "transform", "api")
RULE_SCHEMA = (
    "ord int, id string, kind string, lang array<string>, call array<string>, receiver string, match_bare boolean, args array<int>, all_args boolean, "
    "dest_kind string, dest_host string, dest_vendor string, host_arg int, arg_is map<int,string>, arg_not map<int,string>, data_type string, "
    "field array<string>, param_annotation array<string>, confidence double, transform string, effect string, returns string, disabled boolean"
)
_KEYS = {
    "id", "kind", "lang", "call", "receiver", "match_bare", "arg", "dest", "host_arg", "arg_is", "arg_not", "data_type", "field", "param_annotation", "confidence",
    "transform", "effect", "returns", "category", "severity", "description", "disabled",
}
#: Confidences of a match.
RESOLVED, RECEIVER, RECEIVER_PATTERN, BARE, FIELD_RECEIVER = 1.0, 0.8, 0.75, 0.6, 0.8


def _many(value) -> list[str]:
    return [] if value is None else [value] if isinstance(value, str) else list(value)


def validate(rule: dict) -> None:
    """Raise ValueError on a rule that no engine could apply."""
    unknown = set(rule) - _KEYS
    if unknown:
        raise ValueError(f"{rule.get('id')}: unknown keys {sorted(unknown)}")
    kind = rule.get("kind", "sink")
    if not rule.get("id") or kind not in KINDS:
        raise ValueError(f"{rule.get('id')}: an id and a known kind are needed")
    if rule.get("disabled"):
        return
    if not _many(rule.get("lang")):
        raise ValueError(f"{rule['id']}: no language")
    if not (_many(rule.get("call")) or kind == "source" and (_many(rule.get("field")) or _many(rule.get("param_annotation")))):
        raise ValueError(f"{rule['id']}: nothing to match")
    needs = {"sink": rule.get("dest", {}).get("kind"), "source": rule.get("data_type"), "transform": rule.get("transform"), "api": rule.get("effect") or rule.get("returns")}
    if not needs[kind]:
        raise ValueError(f"{rule['id']}: a {kind} rule does not say what it does")
    for pattern in [rule.get("receiver"), *rule.get("arg_is", {}).values(), *rule.get("arg_not", {}).values()]:
        re.compile(pattern or "")
    if any(int(k) < -1 for k in [*rule.get("arg_is", {}), *rule.get("arg_not", {})]):
        raise ValueError(f"{rule['id']}: argument indexes start at 0, the receiver is -1")


def load(spark: SparkSession, *texts: str) -> DataFrame:
    """Rules of YAML or JSON documents, later ones replacing earlier ones of their id; disabled rules drop out."""
    rows: dict[str, tuple] = {}
    for text in texts:
        for rule in records(text, "rules"):
            validate(rule)
            dest, arg = rule.get("dest", {}), rule.get("arg", "*")
            indexes = [] if arg == "*" else [arg] if isinstance(arg, int) else list(arg)
            ints = lambda m: {int(k): v for k, v in (m or {}).items()}
            place = rows[rule["id"]][0] if rule["id"] in rows else len(rows)
            rows[rule["id"]] = (
                place, rule["id"], rule.get("kind", "sink"), _many(rule.get("lang")), _many(rule.get("call")), rule.get("receiver"), bool(rule.get("match_bare")), indexes, arg == "*",
                dest.get("kind"), dest.get("host", ""), dest.get("vendor", ""), rule.get("host_arg"), ints(rule.get("arg_is")), ints(rule.get("arg_not")), rule.get("data_type"),
                _many(rule.get("field")), _many(rule.get("param_annotation")), float(rule.get("confidence", 1.0)), rule.get("transform"), rule.get("effect"), rule.get("returns"), bool(rule.get("disabled")),
            )
    return spark.createDataFrame([r for r in rows.values() if not r[-1]], RULE_SCHEMA)


def override(base: DataFrame, extra: DataFrame) -> DataFrame:
    """``extra`` replaces rules of the same id in their place and appends others; disabled ones drop out."""
    both = base.withColumn("gen_", F.lit(0)).unionByName(extra.withColumn("gen_", F.lit(1)))
    last = Window.partitionBy("id").orderBy(F.col("gen_").desc(), F.col("ord").desc())
    place = F.min(F.struct("gen_", "ord")).over(Window.partitionBy("id"))
    kept = both.withColumns({"r_": F.row_number().over(last), "at_": place}).filter("r_ = 1 AND NOT disabled")
    return kept.withColumn("ord", F.row_number().over(Window.orderBy("at_", "id")).cast("int") - 1).drop("gen_", "r_", "at_")


def _escaped(text: Column) -> Column:
    return F.regexp_replace(text, "([^A-Za-z0-9_ ])", "\\\\$1")


def glob(pattern: Column) -> Column:
    """An anchored expression of a pattern whose ``*`` stands for any run of characters."""
    return F.concat(F.lit("^"), F.array_join(F.transform(F.split(pattern, "\\*", -1), _escaped), ".*"), F.lit("$"))


def _tail(callee: Column) -> Column:
    """The part after the import path: from the first dot behind the last slash."""
    last = F.substring_index(callee, "/", -1)
    return F.when(F.contains(callee, F.lit("/")) & F.contains(last, F.lit(".")), F.regexp_extract(last, "^[^.]*\\.(.*)$", 1)).otherwise(callee)


def rule_calls(rules: DataFrame) -> DataFrame:
    """A row per call pattern: rule columns with ``regex``, ``method`` and the class-like segment before it."""
    out = rules.withColumn("pattern", F.explode("call"))
    parts = F.split(_tail(F.col("pattern")), "\\.")
    segment = F.when(F.size(parts) > 1, F.element_at(parts, -2)).otherwise("")
    out = out.withColumns({"regex": glob(F.col("pattern")), "method": F.element_at(parts, -1), "segment": segment})
    wild = F.contains("method", F.lit("*"))
    return out.withColumn("wild", wild).withColumn("segment", F.when(F.regexp("segment", F.lit("^[A-Z][^*]*$")) & ~F.col("wild"), F.col("segment")).otherwise(""))


def last_segment(name: Column) -> Column:
    return F.regexp_extract(F.regexp_replace(F.regexp_replace(F.coalesce(name, F.lit("")), "^[*&]+", ""), "(?<=.)[<\\[].*$", ""), "([^./]*)$", 1)


def match_calls(calls: DataFrame, rules: DataFrame, kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The best match of every call and rule: call columns with rule, rule_kind, match_confidence and how.

    ``calls``: call_id, lang, callee (null: unresolved), name, recv_type, recv_text.
    """
    patterns = rule_calls(rules.filter(F.col("kind").isin(*kinds)))
    cols = [F.col(c) for c in ("id", "kind", "lang", "receiver", "match_bare", "regex", "method", "segment", "wild", "ord")]
    pats = patterns.select(*(c.alias(f"r_{n}") for c, n in zip(cols, ("id", "kind", "lang", "receiver", "bare", "regex", "method", "segment", "wild", "ord"))))
    lang = F.arrays_overlap("r_lang", F.array(F.col("lang"), F.lit("*")))
    named = calls.join(F.broadcast(pats.filter("NOT r_wild")), (F.col("name") == F.col("r_method")) & lang)
    wild = calls.join(F.broadcast(pats.filter("r_wild")), lang & F.expr("name RLIKE replace(concat('^', replace(r_method, '*', '.*'), '$'), '..*', '.*')"))
    # a resolved callee is matched by its whole pattern, whatever the call's own name is
    resolved = calls.filter("callee IS NOT NULL AND callee != ''")
    whole = resolved.join(F.broadcast(pats), lang & ((F.col("name") == F.col("r_method")) | F.col("r_wild")) & F.expr("callee RLIKE r_regex"))
    open_ = named.unionByName(wild).filter("callee IS NULL OR callee = ''")
    text = F.coalesce("recv_text", F.lit(""))
    score = (
        F.when(F.col("r_wild") & F.col("r_receiver").isNull(), None)
        .when((F.col("r_segment") != "") & (last_segment(F.col("recv_type")) == F.col("r_segment")), F.struct(F.lit(RECEIVER).alias("c"), F.concat(F.lit("receiver type "), "recv_type").alias("how")))
        .when((F.col("r_segment") != "") & (text != "") & (last_segment(text) == F.col("r_segment")), F.struct(F.lit(RECEIVER).alias("c"), F.concat(F.lit("receiver "), text).alias("how")))
        .when(F.col("r_receiver").isNotNull() & (text != "") & F.expr("recv_text RLIKE r_receiver"), F.struct(F.lit(RECEIVER_PATTERN).alias("c"), F.concat(F.lit("receiver name "), text).alias("how")))
        .when(F.col("r_bare") & ~F.col("r_wild") & text.isin("", "this"), F.struct(F.lit(BARE).alias("c"), F.concat(F.lit("bare call "), "name").alias("how")))
    )
    hits = whole.withColumn("hit", F.struct(F.lit(RESOLVED).alias("c"), F.lit("resolved").alias("how"))).unionByName(open_.withColumn("hit", score).filter("hit IS NOT NULL"))
    kept = calls.columns
    best = hits.groupBy(*kept, "r_id", "r_kind", "r_ord").agg(F.max("hit").alias("hit"))
    return best.select(*kept, F.col("r_id").alias("rule"), F.col("r_kind").alias("rule_kind"), F.col("r_ord").alias("rule_ord"), F.col("hit.c").alias("match_confidence"), F.col("hit.how").alias("how"))


def best_api(matched: DataFrame) -> DataFrame:
    """The api rule that describes each call best; ties go to the earlier rule."""
    order = Window.partitionBy("call_id").orderBy(F.col("match_confidence").desc(), "rule_ord")
    return matched.filter("rule_kind = 'api'").withColumn("r_", F.row_number().over(order)).filter("r_ = 1").drop("r_")


def match_fields(reads: DataFrame, rules: DataFrame) -> DataFrame:
    """Source rules of field reads: read columns with rule and match_confidence. ``reads``: lang, owner, field, recv."""
    pats = rules.filter("kind = 'source'").withColumn("p", F.explode("field"))
    pats = pats.select(F.col("id").alias("rule"), F.col("lang").alias("r_lang"), F.col("receiver").alias("r_receiver"), glob(F.regexp_extract("p", "^(.*)\\.[^.]*$", 1)).alias("r_owner"), F.substring_index("p", ".", -1).alias("r_field"))
    owner = F.regexp_replace(F.coalesce("owner", F.lit("")), "^[*&]+", "")
    met = reads.withColumn("owner_", owner).join(F.broadcast(pats), (F.col("field") == F.col("r_field")) & F.arrays_overlap("r_lang", F.array(F.col("lang"), F.lit("*"))))
    c = F.when((F.col("owner_") != "") & F.expr("owner_ RLIKE r_owner"), 1.0).when((F.coalesce("recv", F.lit("")) != "") & F.expr("recv RLIKE r_receiver"), FIELD_RECEIVER)
    return met.withColumn("c_", c).filter("c_ IS NOT NULL").groupBy(*reads.columns, "rule").agg(F.max("c_").alias("match_confidence"))


def match_parameters(params: DataFrame, rules: DataFrame) -> DataFrame:
    """Source rules of annotated parameters; an annotation with a key names its data itself. ``params``: lang, annotations."""
    pats = rules.filter("kind = 'source'").select(F.col("id").alias("rule"), F.col("lang").alias("r_lang"), F.explode("param_annotation").alias("annotation"))
    met = params.withColumn("annotation", F.explode("annotations")).join(F.broadcast(pats), "annotation").filter(F.arrays_overlap("r_lang", F.array(F.col("lang"), F.lit("*"))))
    return met.groupBy(*params.columns, "rule").agg(F.concat(F.lit("@"), F.min("annotation")).alias("how")).withColumn("match_confidence", F.lit(1.0))


def selected_arguments(args: DataFrame, matched: DataFrame, rules: DataFrame) -> DataFrame:
    """Arguments (call_id, idx, name, ...) that reach a matched sink, where its argument conditions hold.

    The receiver has index -1; a condition on an argument without a name sees the empty string.
    """
    spec = rules.select(F.col("id").alias("rule"), "args", "all_args", "arg_is", "arg_not")
    hit = matched.join(F.broadcast(spec), "rule")
    names = args.groupBy("call_id").agg(F.map_from_entries(F.collect_list(F.struct("idx", F.coalesce("name", F.lit(""))))).alias("names_"))
    hit = hit.join(names, "call_id", "left")
    said = lambda k: F.coalesce(F.try_element_at(F.col("names_"), k), F.lit(""))
    fine = F.forall(F.map_entries("arg_is"), lambda e: F.regexp(said(e["key"]), e["value"])) & ~F.exists(F.map_entries("arg_not"), lambda e: F.regexp(said(e["key"]), e["value"]))
    hit = hit.filter(fine).select("call_id", "rule", "match_confidence", "args", "all_args")
    return args.join(hit, "call_id").filter("(all_args AND idx >= 0) OR array_contains(args, idx)").drop("args", "all_args")


def destination(df: DataFrame, constant: str = "constant", first_party: list[str] | None = None) -> DataFrame:
    """Sets dest_host from a constant URL argument and dest_kind first_party for own domains (network only)."""
    url = F.when(F.contains(constant, F.lit("://")), F.col(constant)).when(~F.startswith(F.col(constant), F.lit("/")), F.concat(F.lit("https://"), F.col(constant)))
    out = df.withColumn("dest_host", F.coalesce(F.nullif(F.try_parse_url(url, F.lit("HOST")), F.lit("")), F.col("dest_host")))
    own = F.lit(False)
    for d in first_party or []:
        d = d.lower().removeprefix(".")
        own = own | (F.lower("dest_host") == d) | F.endswith(F.lower("dest_host"), F.lit(f".{d}"))
    out = out.withColumn("dest_kind", F.when((F.col("dest_kind") == "network") & (F.col("dest_host") != "") & own, "first_party").otherwise(F.col("dest_kind")))
    return out.withColumn("first_party", F.col("dest_kind") == "first_party")


def merge_heuristics(base: DataFrame, extra: DataFrame) -> DataFrame:
    """Rows (table, word, value): words of lists add up, values of maps are replaced."""
    both = base.withColumn("g_", F.lit(0)).unionByName(extra.withColumn("g_", F.lit(1)))
    return both.groupBy("table", "word").agg(F.max_by("value", "g_").alias("value"))


def digest(rules: DataFrame) -> str:
    """Identifies an effective rule set."""
    columns = sorted(rules.columns)
    text = rules.select("id", F.sha2(F.to_json(F.struct(*columns)), 256).alias("h")).agg(F.sha2(F.to_json(F.array_sort(F.collect_list(F.struct("id", "h")))), 256)).first()[0]
    return text[:32]
