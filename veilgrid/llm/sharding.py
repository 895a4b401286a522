"""Sharding by histogram sort, under the law of equal bytes.

Rows are ordered by (hash of the text, hash of the id), so equal texts stand side by
side. Shard borders come from exact byte counts: a first histogram over the top bits
of the key, then, for each border that still misses its target by more than the
tolerance, finer probes inside the one cell it falls into, between the smallest and
largest key there. A border takes the nearest edge of a group of equal texts if that misses
the target by no more than GROUP_TOLERANCE of a shard, so groups of up to twice that
never part; only a larger group, which no shard could absorb, is cut, to the finer
tolerance. Each round is one aggregation with a bounded result; the rows themselves
move once, to the cell that numbers their slots.

Null texts count as no bytes and are equal to each other; rows without an id are placed
like any other. Rows equal in id and text have equal keys and stay in one shard. A very
long text may fill more than a shard. An empty table gives an empty result. Only
DataFrame functions run.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.llm.common import Scratch

SHARDS = 40
#: Bytes that every row costs besides its text.
ROW_BYTES = 16
#: Part of a shard's bytes by which a border may miss.
TOLERANCE = 0.002
#: The same where the border falls into a group of equal texts and would cut it.
GROUP_TOLERANCE = 0.05
#: A round has 2**PROBE_BITS probes inside a cell; after so many rounds the nearest border is taken.
PROBE_BITS, ROUNDS = 9, 24
#: Cells that number slots: rows above 1/HEAVY of all (and above HEAVY_ROWS) split a cell.
HEAVY, HEAVY_ROWS = 4096, 2000
TOP_BITS = 16
LOW, HIGH = -(1 << 63), (1 << 63) - 1


def text_bytes(text: str = "text") -> Column:
    return F.coalesce(F.octet_length(text), F.lit(0)).cast("long") + ROW_BYTES


def _keys(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return docs.withColumns({"key1_": F.xxhash64(text_col), "key2_": F.xxhash64(F.lit("id"), id_col), "size_": text_bytes(text_col)})


class _Border:
    """A border between two shards: bytes wanted below it, and the cell that holds it."""

    def __init__(self, want: float):
        self.want, self.below = want, 0
        self.cell: tuple[int, int, int, int] | None = (LOW, HIGH, LOW, HIGH)  # ranges of both keys, inclusive
        self.at: tuple[int, int] | None = None  # rows from this key on lie above; None: no row does

    def settle(self, edges: list[tuple[int, tuple[int, int] | None]]) -> None:
        """Take the nearest of (bytes below, key)."""
        self.at = min(edges, key=lambda e: abs(e[0] - self.want))[1]
        self.cell = None


def _probe(keys: DataFrame, cells: list[tuple[int, int, int, int]]) -> dict[int, list]:
    """For each cell its non-empty subcells in key order: (lo, hi, key number, bytes, rows, extremes)."""
    number, step = F.lit(None).cast("int"), F.lit(None).cast("long")
    for k, (a, b, c, d) in enumerate(cells):
        first = a < b
        lo, hi, name = (a, b, "key1_") if first else (c, d, "key2_")
        inside = F.col("key1_").between(a, b) if first else (F.col("key1_") == a) & F.col("key2_").between(c, d)
        if hi - lo >= 1 << 62:
            at = F.shiftright(name, 64 - TOP_BITS) + (1 << (TOP_BITS - 1))
        else:
            at = F.shiftright(F.col(name) - F.lit(lo), max(0, (hi - lo).bit_length() - PROBE_BITS))
        number, step = F.when(inside, k).otherwise(number), F.when(inside, at.cast("long")).otherwise(step)
    found = (
        keys.select("key1_", "key2_", "size_", number.alias("cell"), step.alias("step"))
        .filter("cell IS NOT NULL")
        .groupBy("cell", "step")
        .agg(F.sum("size_").alias("bytes"), F.count("*").alias("rows"), *(F.expr(f"{f}({k})").alias(f"{f}_{k}") for k in ("key1_", "key2_") for f in ("min", "max")))
        .collect()
    )
    out: dict[int, list] = {}
    for r in sorted(found, key=lambda r: (r.cell, r.step)):
        out.setdefault(r.cell, []).append(r)
    return out


def splitters(keys: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE, rounds: int = ROUNDS) -> tuple[list[tuple[int, int] | None], list]:
    """Keys at which the shards 1, 2, ... begin, and the first round's histogram."""
    whole = (LOW, HIGH, LOW, HIGH)
    first = _probe(keys, [whole]).get(0, [])
    total = sum(r.bytes for r in first)
    borders = [_Border(total * k / shards) for k in range(1, shards)]
    slack, group_slack = tolerance * total / shards, group_tolerance * total / shards
    histograms = {whole: first}
    for _ in range(rounds):
        for b in (b for b in borders if b.cell):
            below, of = b.below, histograms[b.cell]
            by_first = b.cell[0] < b.cell[1]
            for r in of:
                if below + r.bytes >= b.want:
                    break
                below += r.bytes
            else:
                b.settle([(below, None)])
                continue
            one = r.min_key1_ == r.max_key1_
            lo = (r.min_key1_, LOW) if by_first else (r.min_key1_, r.min_key2_)
            after = [x for x in of if x.step > r.step]
            # the next key above the subcell, if any row of this cell has one; else just past it
            if after:
                hi = (after[0].min_key1_, LOW) if by_first else (after[0].min_key1_, after[0].min_key2_)
            elif by_first:
                hi = (r.max_key1_ + 1, LOW) if r.max_key1_ < HIGH else None
            elif r.max_key2_ < HIGH:
                hi = (r.max_key1_, r.max_key2_ + 1)
            else:
                hi = (r.max_key1_ + 1, LOW) if r.max_key1_ < HIGH else None
            edges = [(below, lo), (below + r.bytes, hi)]
            least = one and r.min_key2_ == r.max_key2_
            # edges of a first key's only value are those of a group of equal texts
            if least or min(abs(e[0] - b.want) for e in edges) <= (group_slack if one and by_first else slack):
                b.settle(edges)
            else:
                b.below, b.cell = below, (r.min_key1_, r.max_key1_, r.min_key2_, r.max_key2_)
                b.edges = edges
        cells = list(dict.fromkeys(b.cell for b in borders if b.cell))
        if not cells:
            break
        histograms = dict(zip(cells, (v for _, v in sorted(_probe(keys, cells).items()))))
    for b in borders:
        if b.cell:
            b.settle(b.edges)
    return [b.at for b in borders], first


def shard_rows(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, tolerance: float = TOLERANCE, group_tolerance: float = GROUP_TOLERANCE, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """All rows and columns with ``size``, ``shard`` and ``slot`` (gapless from 0 in each shard).

    Columns of these names that ``docs`` already has are replaced.
    """
    scratch = Scratch(spark, "sharding")
    keyed = _keys(docs, id_col, text_col)
    keys = scratch.keep(keyed.select("key1_", "key2_", "size_"))
    at, first = splitters(keys, shards, tolerance, group_tolerance)
    above = [(F.col("key1_") > a) | ((F.col("key1_") == a) & (F.col("key2_") >= b)) for a, b in filter(None, at)]
    shard = reduce(lambda x, y: x + y, [c.cast("int") for c in above], F.lit(0))
    most = max(HEAVY_ROWS, sum(r.rows for r in first) // HEAVY)
    heavy = [(r.step, -(-r.rows // most)) for r in first if r.rows > most]
    top = 1 << (TOP_BITS - 1)
    cut = F.lit(0).cast("long")
    if heavy:  # at most HEAVY cells
        parts = F.try_element_at(F.map_from_arrays(F.array(*(F.lit(s) for s, _ in heavy)), F.array(*(F.lit(n) for _, n in heavy))), F.col("cell_"))
        cut = F.coalesce(F.expr(f"(shiftright(key2_, {64 - TOP_BITS}) + {top})") * parts / (2 * top), F.lit(0)).cast("long")
    keyed = keyed.withColumn("shard", shard).withColumn("cell_", (F.shiftright("key1_", 64 - TOP_BITS) + top).cast("long"))
    held = ["shard", "cell_", "cut_"]
    keyed = keyed.withColumn("cut_", cut)
    counts = keys.withColumn("shard", shard).withColumn("cell_", (F.shiftright("key1_", 64 - TOP_BITS) + top).cast("long")).withColumn("cut_", cut)
    counts = counts.groupBy(*held).agg(F.count("*").alias("rows_"))
    before = Window.partitionBy("shard").orderBy("cell_", "cut_").rowsBetween(Window.unboundedPreceding, -1)
    offsets = counts.select(*held, F.coalesce(F.sum("rows_").over(before), F.lit(0)).alias("before_"))
    in_cell = Window.partitionBy(*held).orderBy("key1_", "key2_", id_col)
    return (
        keyed.join(offsets, held)
        .withColumn("slot", (F.col("before_") + F.row_number().over(in_cell) - 1).cast("long"))
        .withColumn("size", F.col("size_"))
        .drop("key1_", "key2_", "size_", "cell_", "cut_", "before_")
    )


def shard_digest(spark: SparkSession, docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Where each document goes, with the checksum of its text in place of the text."""
    slim = docs.select("doc_id", "text")
    placed = shard_rows(spark, slim.withColumn("text_crc32", F.crc32(F.coalesce("text", F.lit("")).cast("binary"))), shards)
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
