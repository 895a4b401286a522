"""Closures and flows longer than any fixture's."""

from veilgrid.operators import program, taint


def test_a_ring_of_functions_is_one_component(spark):
    n = 67
    edges = spark.createDataFrame([(f"f{k:02}", f"f{(k + 1) % n:02}") for k in range(n)], "src string, dst string")
    nodes = edges.select(edges.src.alias("node"))
    assert {(r.node, r.component) for r in program.components(edges, nodes).collect()} == {(f"f{k:02}", "f00") for k in range(n)}


def test_a_flow_over_many_hops_arrives(spark):
    n = 43
    seeds = spark.createDataFrame([("f#0", "email", [], 0.9, "variable mail", "a.py", 1)], "var string, data_type string, transforms array<string>, confidence double, source_desc string, file string, line int")
    edges = spark.createDataFrame([(f"f#{k}", f"f#{k + 1}", 1.0, None, "a.py", k + 2) for k in range(n)] + [("f#1", "f#0", 1.0, None, "a.py", 1), ("f#2", "f#2", 0.9, None, "a.py", 3)], "src string, dst string, factor double, transform string, file string, line int")
    facts = {r["var"]: len(r.path) for r in taint.propagate(seeds, edges).collect()}
    assert facts == {f"f#{k}": k + 1 for k in range(n + 1)}
