"""Program facts as tables: control flow, dominance, class dispatch, call chains, incremental selection, IR checks.

Tables come from an extractor: ``ir_funcs`` (func, name, lang, file, start_line, end_line),
``ir_instrs`` (func, idx, op, dst, args, ...), ``cfg_edges`` (func, from_block, to_block),
``class_edges`` (sub, super, lang), ``class_methods`` (class, method, func, lang) and
``calls`` (caller, callee).
"""

from __future__ import annotations

from itertools import count

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.sources.files import selected
from veilgrid.sources.scratch import kept

MAX_TARGETS, MAX_CALLERS, CALLER_DEPTH = 16, 5, 2
#: Hops after which the table of all pairs, or of all labels, is written.
CUT = 6


def closure(edges: DataFrame, depth: int | None = None, starts: DataFrame | None = None) -> DataFrame:
    """(src, dst, hops): pairs joined by a path, of at most ``depth`` edges if given, with its fewest hops; cycles are fine.

    ``starts`` (a column ``src``) limits the sources, so that only what they reach is followed.
    """
    base = edges.select("src", "dst").distinct()
    first = base if starts is None else base.join(starts.select("src").distinct(), "src", "left_semi")
    seen = frontier = first.withColumn("hops", F.lit(1))
    for hop in count(2) if depth is None else range(2, depth + 1):
        step = frontier.select("src", F.col("dst").alias("via")).join(base.select(F.col("src").alias("via"), "dst"), "via").select("src", "dst").distinct()
        frontier = kept(step.join(seen, ["src", "dst"], "left_anti").withColumn("hops", F.lit(hop)))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        seen = seen if hop % CUT else kept(seen)
    return seen


def reached(starts: DataFrame, edges: DataFrame, depth: int | None = None) -> DataFrame:
    """(node): the starts (a column ``node``) and all that they reach, over at most ``depth`` edges if given."""
    seen = frontier = kept(starts.select("node").distinct())
    for hop in count(1):
        if depth is not None and hop > depth:
            break
        step = frontier.join(edges.select(F.col("src").alias("node"), "dst"), "node").select(F.col("dst").alias("node")).distinct()
        frontier = kept(step.join(seen, "node", "left_anti"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
        seen = seen if hop % CUT else kept(seen)
    return seen


def predecessors(cfg: DataFrame) -> DataFrame:
    return cfg.select("func", F.col("to_block").alias("block"), F.col("from_block").alias("predecessor")).distinct()


def _least(nodes: DataFrame, edges: DataFrame, src: str, dst: str) -> DataFrame:
    """(node, least): the least node from which each node is reached, itself included."""
    loops = nodes.select(F.col("node").alias(src), F.col("node").alias(dst))
    steps = kept(edges.select(src, dst).unionByName(loops))
    held = kept(nodes.select("node", F.col("node").alias("least")))
    while True:
        now = held
        for _ in range(CUT):
            now = steps.join(now, F.col(src) == F.col("node")).groupBy(F.col(dst).alias("to_")).agg(F.min("least").alias("least")).withColumnRenamed("to_", "node")
        now = kept(now)
        if now.join(held.withColumnRenamed("least", "before"), "node").filter("least < before").isEmpty():
            return now
        held = now


def components(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(node, component): strongly connected components, named by their least node.

    Nodes are split into classes by the least node that reaches them and the least that
    they reach, again and again inside the classes, until none splits: then the least
    node of a class reaches all of it and all of it reaches that node. Tables stay as
    large as the graph.
    """
    links = edges.select("src", "dst").filter("src != dst").distinct()
    every = kept(nodes.select("node").unionByName(links.select(F.explode(F.array("src", "dst")).alias("node"))).distinct())
    classes = every.withColumn("class", F.lit("")).select("node", "class")
    n_classes = 1
    inside = kept(links)
    while True:
        ahead, back = _least(every, inside, "src", "dst"), _least(every, inside, "dst", "src")
        split = ahead.join(back.withColumnRenamed("least", "least_back"), "node").withColumn("class", F.struct("least", "least_back"))
        classes = kept(classes.withColumnRenamed("class", "before").join(split, "node").select("node", F.sha2(F.to_json(F.struct("before", "class")), 256).alias("class")))
        n = classes.select("class").distinct().count()
        if n == n_classes:
            break
        n_classes = n
        inside = kept(inside.join(classes.select(F.col("node").alias("src"), F.col("class").alias("a")), "src").join(classes.select(F.col("node").alias("dst"), F.col("class").alias("b")), "dst").filter("a = b").select("src", "dst"))
    least = classes.groupBy("class").agg(F.min("node").alias("component"))
    return nodes.select("node").distinct().join(classes, "node").join(least, "class").select("node", "component")


def levels(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(component, level): an order of work on components: those of level k call only such of lower levels.

    ``edges``: (src calls dst). What calls nobody outside its component has level 0.
    """
    named = kept(components(edges, nodes))
    at = lambda c, name: named.select(F.col("node").alias(c), F.col("component").alias(name))
    links = kept(edges.select("src", "dst").join(at("src", "a"), "src").join(at("dst", "b"), "dst").filter("a != b").select("a", "b").distinct())
    held = kept(named.select("component").distinct().withColumn("level", F.lit(0)))
    while True:
        above = links.join(held, F.col("b") == F.col("component")).groupBy("a").agg((F.max("level") + 1).alias("up"))
        now = kept(held.join(above, F.col("component") == F.col("a"), "left").select("component", F.greatest("level", F.coalesce("up", F.lit(0))).alias("level")))
        if now.join(held.withColumnRenamed("level", "before"), "component").filter("level > before").isEmpty():
            return now
        held = now


def dominators(cfg: DataFrame, entry: int = 0) -> DataFrame:
    """(func, block, dominator) of reachable blocks. Graphs of one function are small; many functions run side by side."""
    import pandas as pd

    def each(frame: pd.DataFrame) -> pd.DataFrame:
        func = frame["func"].iloc[0]
        succ: dict[int, list[int]] = {}
        for a, b in zip(frame["from_block"], frame["to_block"]):
            succ.setdefault(int(a), []).append(int(b))

        def blocks(without: int | None) -> set[int]:
            if without == entry:
                return set()
            seen, work = {entry}, [entry]
            while work:
                for b in succ.get(work.pop(), ()):
                    if b not in seen and b != without:
                        seen.add(b)
                        work.append(b)
            return seen

        every = blocks(None)
        rows = [(func, b, d) for d in sorted(every) for b in sorted(every - blocks(d))]
        return pd.DataFrame(rows, columns=["func", "block", "dominator"])

    return cfg.groupBy("func").applyInPandas(each, "func string, block int, dominator int")


def short_class(name: str):
    return F.regexp_extract(name, "([^./:]*)$", 1)


def dispatch(calls: DataFrame, class_edges: DataFrame, class_methods: DataFrame) -> DataFrame:
    """(call_id, target, hops): the static target and the overrides in transitive subtypes of the receiver's type.

    ``calls``: call_id, lang, target, recv_type, name. A short name counts where one
    class has it. At most MAX_TARGETS a call, nearest first.
    """
    classes = class_edges.select(F.col("sub").alias("class")).unionByName(class_methods.select("class")).distinct()
    shorts = classes.groupBy(short_class("class").alias("short")).agg(F.count("*").alias("n"), F.min("class").alias("class")).filter("n = 1").drop("n")
    up = class_edges.withColumn("written", F.regexp_replace("super", "^[*&]+", ""))
    named = up.join(classes.select(F.col("class").alias("written"), F.col("class").alias("exact")), "written", "left").join(shorts.select(F.col("short"), F.col("class").alias("by_short")), short_class("written") == F.col("short"), "left")
    edges = named.select(F.coalesce("exact", "by_short", "written").alias("src"), F.col("sub").alias("dst")).filter("src != dst")
    recv = F.regexp_replace(F.regexp_replace("recv_type", "^[*&]+", ""), "\\?$", "")
    open_ = calls.filter("recv_type IS NOT NULL AND recv_type != '' AND name != ''").withColumn("recv", recv)
    open_ = open_.join(classes.select(F.col("class").alias("recv"), F.col("class").alias("exact")), "recv", "left").join(shorts.select("short", F.col("class").alias("by_short")), short_class("recv") == F.col("short"), "left")
    roots = open_.select("call_id", "lang", "name", F.coalesce("exact", "by_short", "recv").alias("src"))
    below = closure(edges, starts=roots)
    over = roots.join(below, "src").join(class_methods.select(F.col("class").alias("dst"), F.col("method").alias("name"), F.col("func").alias("target"), F.col("lang").alias("m_lang")), ["dst", "name"])
    over = over.filter("m_lang = '' OR lang = '' OR m_lang = lang").select("call_id", "target", "hops")
    static = calls.filter("target IS NOT NULL AND target != ''").select("call_id", "target", F.lit(0).alias("hops"))
    best = static.unionByName(over).groupBy("call_id", "target").agg(F.min("hops").alias("hops"))
    order = Window.partitionBy("call_id").orderBy("hops", "target")
    return best.withColumn("r_", F.row_number().over(order)).filter(F.col("r_") <= MAX_TARGETS).drop("r_")


def call_graph(sites: DataFrame, dispatched: DataFrame, created: DataFrame | None = None) -> DataFrame:
    """(caller, callee): what every function may call: static targets and overrides, constructors and closures it creates.

    ``sites``: call_id, func; ``dispatched``: call_id, target; ``created``: func, target.
    """
    edges = sites.join(dispatched, "call_id").select(F.col("func").alias("caller"), F.col("target").alias("callee"))
    if created is not None:
        edges = edges.unionByName(created.select(F.col("func").alias("caller"), F.col("target").alias("callee")))
    return edges.filter("callee IS NOT NULL AND callee != ''").distinct()


def call_chains(paths: DataFrame, funcs: DataFrame, calls: DataFrame) -> DataFrame:
    """(flow, step, function, line, depth): the innermost function around every path position, repeats collapsed.

    ``paths``: flow, pos, file, line. The depth goes up with a call, down with a return,
    and starts at the least depth of its flow.
    """
    at = paths.join(funcs, (paths["file"] == funcs["file"]) & paths["line"].between(F.col("start_line"), F.col("end_line")), "left")
    inner = at.groupBy("flow", "pos", paths["line"]).agg(F.min_by("func", F.struct(F.col("end_line") - F.col("start_line"), F.col("func"))).alias("func"))
    by = Window.partitionBy("flow").orderBy("pos")
    named = inner.withColumn("function", F.coalesce("func", F.lit("?")))
    steps = named.withColumn("before", F.lag("function").over(by)).filter("before IS NULL OR before != function").withColumn("before", F.lag("function").over(by))
    edge = calls.select("caller", "callee").distinct()
    down = edge.select(F.col("caller").alias("before"), F.col("callee").alias("function"), F.lit(1).alias("into"))
    back = edge.select(F.col("callee").alias("before"), F.col("caller").alias("function"), F.lit(1).alias("out"))
    moved = steps.join(down, ["before", "function"], "left").join(back, ["before", "function"], "left")
    delta = F.when(F.col("into") == 1, 1).when(F.col("out") == 1, -1).otherwise(0)
    deep = moved.withColumn("depth", F.sum(delta).over(by))
    deep = deep.withColumn("depth", (F.col("depth") - F.min("depth").over(Window.partitionBy("flow"))).cast("int"))
    return deep.select("flow", (F.row_number().over(by) - 1).alias("step"), "function", "line", "depth")


def callers(chains: DataFrame, calls: DataFrame) -> DataFrame:
    """(flow, function): up to MAX_CALLERS functions that call a flow's first one."""
    entry = chains.filter("step = 0").select("flow", F.col("function").alias("callee"))
    seen = entry.join(calls.select("caller", "callee").distinct(), "callee").filter("caller != callee")
    order = Window.partitionBy("flow").orderBy("caller")
    return seen.withColumn("r_", F.row_number().over(order)).filter(F.col("r_") <= MAX_CALLERS).select("flow", F.col("caller").alias("function"))


def files_to_rescan(changed: DataFrame, funcs: DataFrame, calls: DataFrame, depth: int = CALLER_DEPTH) -> DataFrame:
    """(file, why): changed files, and files of functions that call into them within ``depth`` calls."""
    start = funcs.join(changed, "file", "left_semi").select(F.col("func").alias("node"))
    near = reached(start, calls.select(F.col("callee").alias("src"), F.col("caller").alias("dst")), depth)
    more = near.withColumnRenamed("node", "func").join(funcs, "func").select("file").distinct().join(changed, "file", "left_anti")
    return changed.select("file").distinct().withColumn("why", F.lit("changed")).unionByName(more.withColumn("why", F.lit("calls a changed file")))


def reachable_files(entries: DataFrame, imports: DataFrame) -> DataFrame:
    """Files that an entry file depends on, itself included. ``imports``: (src, dst)."""
    return reached(entries.select(F.col("file").alias("node")), imports).withColumnRenamed("node", "file")


def scanned_files(files: DataFrame, mode: str = "full", changed: DataFrame | None = None, funcs: DataFrame | None = None, calls: DataFrame | None = None, paths: list[str] | None = None) -> DataFrame:
    """The files that a scan of some mode reads: ``full`` and ``literals`` all, ``diff`` what changed and its callers, ``paths`` the given ones.

    ``files`` has a ``path``; a diff needs ``changed`` (file), ``funcs`` and ``calls``.
    """
    if mode in ("full", "literals"):
        return files
    if mode == "paths":
        return selected(files, paths or [])
    if mode == "diff":
        return files.join(files_to_rescan(changed, funcs, calls).select(F.col("file").alias("path")), "path", "left_semi")
    raise ValueError(f"unknown mode {mode}")


def valid_summaries(summaries: DataFrame, files: DataFrame, engine: str) -> DataFrame:
    """Cached summaries (func, file, file_hash, engine, ...) whose file and engine are unchanged."""
    return summaries.filter(F.col("engine") == engine).join(files.select("file", "file_hash"), ["file", "file_hash"], "left_semi")


def updated_summaries(old: DataFrame, new: DataFrame, lowered: DataFrame, full: bool = False) -> DataFrame:
    """The cache after a run: all replaced, or only functions of the files that were lowered again."""
    return new if full else old.join(lowered.select("file").distinct(), "file", "left_anti").unionByName(new)


def merge_modules(*parts: DataFrame) -> DataFrame:
    """All functions in a stable order; the second and later of one id get ``~n``."""
    both = parts[0]
    for p in parts[1:]:
        both = both.unionByName(p)
    by = Window.partitionBy("func").orderBy("file", "start_line")
    n = F.row_number().over(by)
    return both.withColumn("n_", n).withColumn("func", F.when(F.col("n_") > 1, F.concat("func", F.lit("~"), F.col("n_").cast("string"))).otherwise(F.col("func"))).drop("n_")


def verify(funcs: DataFrame, instrs: DataFrame, cfg: DataFrame) -> DataFrame:
    """(func, problem, detail): what is not well formed: unknown functions, double definitions, uses before any definition, stray edges."""
    detail = lambda c: F.col(c).cast("string").alias("detail")
    unknown = instrs.join(funcs, "func", "left_anti").select("func", F.lit("unknown function").alias("problem"), detail("idx"))
    twice = instrs.filter("dst >= 0").groupBy("func", "dst").agg(F.count("*").alias("n")).filter("n > 1").select("func", F.lit("defined twice").alias("problem"), detail("dst"))
    defined = instrs.filter("dst >= 0").select("func", F.col("dst").alias("arg")).unionByName(funcs.select("func", F.explode("params").alias("arg"))).distinct()
    used = instrs.select("func", F.explode("args").alias("arg")).filter("arg >= 0").distinct()
    undefined = used.join(defined, ["func", "arg"], "left_anti").select("func", F.lit("never defined").alias("problem"), detail("arg"))
    blocks = instrs.select("func", F.col("block").alias("to_block")).distinct()
    stray = cfg.join(blocks, ["func", "to_block"], "left_anti").select("func", F.lit("edge to no block").alias("problem"), detail("to_block"))
    return unknown.unionByName(twice).unionByName(undefined).unionByName(stray).distinct()
