import json

import pytest

from veilgrid.functions import taxonomy
from veilgrid.operators import analysis, rules, taint
from veilgrid.sources import frontends

SOURCE = """
import logging
import tracker
from util import mask_email
from web import request

def send(where, what=None):
    tracker.post(where, what)

def same(x):
    return x

class User:
    pass

def handle(conn, log):
    email = request.get("email")
    logging.info(email)
    logging.info(mask_email(email))
    body = request.get()
    tracker.post("https://t.io/x", body)
    u: User = make()
    u.home.phone = same(conn.ask("phone"))
    logging.info(u.home.phone)
    logging.info(u.home.other)
    logging.info(len(email))
    send(what=same(email), where="https://t.io/y")
    items = []
    items.append(email)
    logging.info(items)
    logging.info("dob: " + str(1), email == "x")
    conn.put("passport_no", conn.ask())

    def later():
        tracker.post("https://corp.io/z", email)

    run(later)
    run_all(email, lambda v: logging.warning(v))
"""
RULES = json.dumps({"rules": [
    {"id": "log", "lang": "python", "call": ["logging.info", "logging.warning"], "dest": {"kind": "log"}},
    {"id": "track", "lang": "python", "call": "tracker.post", "dest": {"kind": "network"}, "host_arg": 0, "arg": 1},
    {"id": "mask", "kind": "transform", "lang": "python", "call": "util.mask_email", "transform": "masked"},
    {"id": "request", "kind": "source", "lang": "python", "call": "web.request.get", "data_type": "request_data"},
    {"id": "put", "lang": "python", "call": "store.Conn.put", "receiver": "^conn$", "dest": {"kind": "storage"}, "arg": 1},
]})
WORDS = [("data_free", "len"), ("mutators", "append"), ("network", "fetch"), ("decoders", "unmarshal")]


@pytest.fixture(scope="module")
def lowered(spark):
    files = spark.createDataFrame([("app.py", "python", SOURCE), ("bad.py", "python", "def ("), ("x.go", "go", "package x")], "path string, lang string, text string")
    return frontends.lower(files)


def flows_of(spark, tables):
    held, types = rules.load(spark, RULES), taxonomy.data_types(spark)
    heuristics = spark.createDataFrame(WORDS, "table string, word string")
    return analysis.analyze(frontends.program(tables), held, types, heuristics, first_party=["corp.io"])


def test_flows_of_a_python_program(spark, lowered):
    line = {k + 1: text.strip() for k, text in enumerate(SOURCE.split("\n"))}
    found = {(r.data_type, line[r.sink_line], tuple(r.transforms), r.dest_kind) for r in flows_of(spark, lowered).collect()}
    wanted = {
        ("email", "logging.info(email)", (), "log"),
        ("email", "logging.info(mask_email(email))", ("masked",), "log"),
        ("request_data", 'tracker.post("https://t.io/x", body)', (), "network"),
        ("phone", "logging.info(u.home.phone)", (), "log"),
        ("email", "tracker.post(where, what)", (), "network"),  # by keyword, through same()
        ("email", "logging.info(items)", (), "log"),  # append
        ("passport", 'conn.put("passport_no", conn.ask())', (), "storage"),  # the key names the value
        ("email", 'tracker.post("https://corp.io/z", email)', (), "first_party"),  # captured
        ("email", "run_all(email, lambda v: logging.warning(v))", (), "log"),  # into a callback
    }
    assert wanted <= found
    sinks = {(d, text) for d, text, _, _ in found}
    assert not any(text in ("logging.info(u.home.other)", "logging.info(len(email))") for _, text in sinks)
    assert ("request_data", "logging.info(email)") not in sinks  # read under a known key


def test_tables_and_problems(spark, lowered):
    assert [r.file for r in lowered["problems"].collect()] == ["bad.py"]
    funcs = {r.name: r for r in lowered["funcs"].collect()}
    assert set(funcs) >= {"<module>", "send", "same", "handle", "handle.later"}
    assert len(funcs["handle.later"].captures) == 1 and len(funcs["send"].params) == 2
    assert sorted(r.module for r in lowered["imports"].collect()) == ["logging", "tracker", "util", "web"]


def test_fields(spark):
    edges = spark.createDataFrame(
        [("f#v", "f#o", "store", "a", None), ("f#o", "f#p", "copy", None, None), ("f#p", "f#q", "load", "a", None), ("f#p", "f#r", "load", "b", None), ("f#w", "f#s", "load", "b", 0.8), ("f#o", "f#big", "store", "x.y.z", None), ("f#big", "f#t", "load", "x", None)],
        "src string, dst string, via string, field string, whole double",
    ).selectExpr("*", "1.0D AS factor", "cast(null AS string) AS transform", "'a.py' AS file", "1 AS line")
    seeded = spark.createDataFrame([("f#v", "email", [], 0.9, "v", "a.py", 1), ("f#w", "phone", [], 0.9, "w", "a.py", 1)], "var string, data_type string, transforms array<string>, confidence double, source_desc string, file string, line int")
    got = {(r["var"], r.field_path, r.data_type): round(r.confidence, 3) for r in taint.propagate(seeded, edges).collect()}
    assert got == {
        ("f#v", "", "email"): 0.9, ("f#o", "a", "email"): 0.9, ("f#p", "a", "email"): 0.9, ("f#q", "", "email"): 0.9, ("f#w", "", "phone"): 0.9, ("f#s", "", "phone"): 0.72,
        ("f#big", "x.y.z", "email"): 0.9, ("f#t", "y.z", "email"): 0.9,
    }


def test_inherited_guards_on_cycles(spark):
    sites = [("main", "a", ["x"]), ("a", "b", ["y"]), ("b", "a", []), ("other", "b", ["x", "z"]), ("p", "q", ["w"]), ("q", "p", [])] + [(f"c{k}", f"c{k + 1}", ["d"] if k == 0 else []) for k in range(12)]
    df = spark.createDataFrame(sites, "caller string, callee string, guards array<string>")
    got = {r.func: r.guards for r in taint.inherited_guards(df).collect()}
    assert got["a"] == ["x"] and got["b"] == ["x"] and got["p"] == got["q"] == [] and got["c12"] == ["d"]
