"""Flows from sources to sinks over a relational intermediate representation.

Facts are rows (var, data_type, transforms, ...) that edges between variables carry on.
Each round joins the newest facts with the edges a few times over and keeps what is
better than before, by a total order, so the result does not depend on how the work is
dealt out. Factors are at most 1, so the rounds end.

Nodes are variables of functions, named ``func#var``; a fact may sit at a field path below
one. ``edges``: src, dst, factor, transform (null: none), file, line, and where fields
matter ``via`` (copy, load or store), ``field`` and ``whole``, the factor by which a load
takes what is known of the whole object only (null: not at all). ``analysis`` makes the
edges, seeds and sinks of a program.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.functions.detect import rounded
from veilgrid.sources.scratch import kept

MIN_CONFIDENCE = 0.2
#: Decimals to which confidences are compared.
PLACES = 12
#: Edges that facts follow before they are written.
CUT = 3
#: Segments of a field path at most; what is stored deeper sits at the last of them.
MAX_FIELDS = 3


def node(func: str, var: str):
    return F.concat_ws("#", func, F.col(var).cast("string"))


EDGE_COLUMNS = ("src", "dst", "factor", "transform", "file", "line", "via", "field", "whole")


def _with_fields(edges: DataFrame) -> DataFrame:
    more = {"via": F.lit("copy"), "field": F.lit(None).cast("string"), "whole": F.lit(None).cast("double")}
    return edges.withColumns({c: x for c, x in more.items() if c not in edges.columns})


def _carried_path() -> Column:
    """The field path behind an edge; null: the fact does not pass it."""
    at, f = F.col("field_path"), F.col("field")
    loaded = F.when(at == f, "").when(F.startswith(at, F.concat(f, F.lit("."))), F.substr(at, F.length(f) + 2)).when((at == "") & F.col("whole").isNotNull(), "")
    stored = F.substring_index(F.concat_ws(".", f, F.nullif(at, F.lit(""))), ".", MAX_FIELDS)
    return F.when(F.col("via") == "load", loaded).when(F.col("via") == "store", stored).otherwise(at)


def propagate(seeded: DataFrame, edges: DataFrame, rounds: int | None = None, floor: float = MIN_CONFIDENCE) -> DataFrame:
    """The best fact of every (var, field_path, data_type, transforms) with its path, an array of (file, line).

    Better is: more confident, then from a shorter path, then by source and path.
    Without ``rounds`` it goes on until no fact gets better, however long the flows are.
    """
    here = F.struct("file", F.col("line").cast("int").alias("line"))
    key = ["var", "field_path", "data_type", "transforms"]
    if "field_path" not in seeded.columns:
        seeded = seeded.withColumn("field_path", F.lit(""))
    order = Window.partitionBy(*key).orderBy(F.round("confidence", PLACES).desc(), F.size("path"), "source_desc", "path")
    best = lambda df: df.withColumn("r_", F.row_number().over(order)).filter("r_ = 1").drop("r_")
    columns = [*key, "confidence", "source_desc", "path"]
    facts = newest = kept(best(seeded.withColumn("path", F.array(here)).select(*columns)))
    steps = kept(_with_fields(edges).select("src", "dst", "factor", "transform", here.alias("here"), "via", "field", "whole"))
    factor = F.when((F.col("via") == "load") & (F.col("field_path") == ""), F.col("factor") * F.col("whole")).otherwise(F.col("factor"))

    def behind(now: DataFrame, old: DataFrame) -> DataFrame:
        """What one edge makes of facts, as far as it is better than what was known."""
        carried = now.join(steps, F.col("var") == F.col("src")).select(
            F.col("dst").alias("var"), _carried_path().alias("field_path"), "data_type",
            F.array_sort(F.when(F.col("transform").isNull(), F.col("transforms")).otherwise(F.array_union("transforms", F.array("transform")))).alias("transforms"),
            (F.col("confidence") * factor).alias("confidence"), "source_desc",
            F.when(F.element_at("path", -1) == F.col("here"), F.col("path")).otherwise(F.concat("path", F.array("here"))).alias("path"),
        ).filter((F.col("confidence") >= floor) & F.col("field_path").isNotNull())
        known = old.select(*key, F.round("confidence", PLACES).alias("c_"), F.size("path").alias("n_"))
        better = best(carried).join(known, key, "left").filter(f"c_ IS NULL OR round(confidence, {PLACES}) > c_ OR (round(confidence, {PLACES}) = c_ AND size(path) < n_)")
        return better.select(*columns)

    done = 0
    while rounds is None or done < rounds:
        # a few edges at a time, so that a long chain does not wait for a job at each of them
        hops = CUT if rounds is None else min(CUT, rounds - done)
        layers = [newest]
        for _ in range(hops):
            layers.append(behind(layers[-1], facts))
        made = kept(reduce(DataFrame.unionByName, [x.withColumn("hop", F.lit(h)) for h, x in enumerate(layers[1:], 1)]))
        facts = kept(best(facts.unionByName(made.drop("hop"))))
        newest = made.filter(F.col("hop") == hops).drop("hop")
        done += hops
        if newest.isEmpty():
            break
    return facts


def flows(facts: DataFrame, sinks: DataFrame, floor: float = MIN_CONFIDENCE) -> DataFrame:
    """Flows into sinks (func, var, sink_rule, dest_kind, dest_host, match_confidence, file, line), one a key.

    The key is data type, rule, function, place and transforms; unguarded beats guarded
    where sinks carry guards, then confidence, source and path length decide.
    """
    hit = sinks.withColumn("node", node("func", "var")) if "node" not in sinks.columns else sinks
    hit = hit.withColumnsRenamed({"file": "sink_file", "line": "sink_line", "var": "sink_var"})
    if "guards" not in hit.columns:
        hit = hit.withColumn("guards", F.array().cast("array<string>"))
    met = facts.join(hit, facts["var"] == hit["node"]).withColumn("confidence", rounded(F.col("confidence") * F.col("match_confidence"))).filter(F.col("confidence") >= floor)
    key = ["data_type", "sink_rule", "func", "sink_file", "sink_line", "transforms"]
    order = Window.partitionBy(*key).orderBy(F.size("guards") > 0, F.col("confidence").desc(), "source_desc", F.size("path"), "path")
    out = met.withColumn("r_", F.row_number().over(order)).filter("r_ = 1")
    return out.select("data_type", "sink_rule", F.col("func").alias("function"), "sink_file", "sink_line", "dest_kind", "dest_host", "transforms", "guards", "confidence", "source_desc", "path")


def guards(branches: DataFrame, dominators: DataFrame, preds: DataFrame, blocks: DataFrame) -> DataFrame:
    """(func, block, guards): consent checks whose passing branch dominates a block.

    ``branches``: func, block, passing (the successor when the check holds), check. The
    passing block needs the branch as its one predecessor.
    """
    single = preds.groupBy("func", "block").agg(F.count("*").alias("n"), F.min("predecessor").alias("predecessor")).filter("n = 1")
    fair = branches.withColumnRenamed("block", "from_block").join(single, (branches["func"] == single["func"]) & (F.col("passing") == single["block"]) & (F.col("from_block") == single["predecessor"])).select(branches["func"], F.col("passing").alias("dominator"), "check")
    held = dominators.join(fair, ["func", "dominator"]).groupBy("func", "block").agg(F.array_sort(F.collect_set("check")).alias("guards"))
    return blocks.join(held, ["func", "block"], "left").withColumn("guards", F.coalesce("guards", F.array().cast("array<string>")))


def inherited_guards(sites: DataFrame) -> DataFrame:
    """(func, guards): what every call site of a function is guarded by. ``sites``: caller, callee, guards.

    A function starts unknown (null), counts for nothing in its callees until one of its
    own sites is known, and then only loses guards until nothing changes, so cycles of
    calls end at what holds on every way into them. A caller that nobody calls has no
    guards of its own; neither has a cycle without a way in.
    """
    empty = F.array().cast("array<string>")
    held = kept(sites.select(F.col("callee").alias("func")).distinct().withColumn("guards", F.lit(None).cast("array<string>")))
    while True:
        inherited = held.select(F.col("func").alias("caller"), F.col("guards").alias("inherited"), F.col("guards").isNull().alias("open"))
        at = sites.withColumnRenamed("guards", "own").join(inherited, "caller", "left").withColumn("all_", F.when(~F.coalesce("open", F.lit(False)), F.array_sort(F.array_union("own", F.coalesce("inherited", empty)))))
        met = at.groupBy("callee").agg(F.collect_set("all_").alias("lists"))
        common = F.aggregate(F.slice("lists", 2, F.size("lists")), F.col("lists")[0], lambda acc, x: F.array_intersect(acc, x))
        now = kept(met.select(F.col("callee").alias("func"), F.when(F.size("lists") > 0, F.array_sort(common)).alias("guards")))
        same = now.join(held.withColumnRenamed("guards", "before"), "func").filter(~F.col("guards").eqNullSafe(F.col("before"))).isEmpty()
        if same:
            return now.withColumn("guards", F.coalesce("guards", empty))
        held = now
