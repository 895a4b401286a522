"""N-gram Jaccard self-join by vertical partitioning of the global n-gram order.

Every document is its set of distinct word n-grams, held as 64-bit hashes. Equal sets
collapse to one class at once. The n-grams have one global order, rare first: a
counting sketch over all documents gives each n-gram's rank, its hash settles ties.
Two sets above the threshold must share an n-gram among the first few of each in
that order, so only these prefixes are dealt out to find candidates.

Overlaps are counted by fragments: the order is cut into fragments of even weight,
each candidate's sets are cut at the same places, the parts of a pair that lie in
one fragment meet apart from all others and give a partial count, and the counts
are summed per pair.

A pair first has to pass bounds: on sizes, on what is left of both orders from the
shared n-gram on, and on the sum over strips of the hash range of the smaller count.

Documents that share a prefix n-gram are first compared with one of them only. What
that links is merged to components; then members of such a group that are in
different components are compared too, those of its largest component only from the
other side, and the likeliest pairs by their bounds before the rest. Pairs inside one component need no comparison, so large groups of near
copies never expand to all pairs and yet no link between components is missed.

Null and empty texts have an empty set and are linked with nothing. Texts with fewer
words than an n-gram have one n-gram, the whole sequence. Repeated rows are
one document; were a doc_id to come with several texts, one set stands for it in
comparisons and its rows share a component. Rows without an id are linked by equal
sets only and have no component of their own. Other columns are not read.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from veilgrid.llm.common import Scratch, map_texts, mark_ids

WORDS, PERCENT = 3, 90
#: log2 of the sketch's counters, counters in a chunk, sketches that one task merges, and fragments of the order.
SKETCH_BITS, CHUNK, MERGE, FRAGMENTS = 22, 1 << 16, 128, 8
#: log2 of the strips of the hash range whose n-grams every document counts, to bound overlaps without its set.
SIZE_BITS = 8
#: Coarser strips, and how many fine ones make one.
FOLDED = 64
WIDTH = (1 << SIZE_BITS) // FOLDED
#: Pairs of every set that are compared before the rest of the pairs across components.
LIKELY = 2
#: N-grams hashed before the sketch takes them in.
BATCH_GRAMS = 1_000_000

_U = np.uint64
_LOWER = bytes(c + 32 if 65 <= c <= 90 else 32 if 9 <= c <= 13 else c for c in range(256))
_BASE = 0x9E3779B97F4A7C15
_MULTIPLIERS = (0xD1B54A32D192ED03, 0x7FB5D329728EA185, 0x81DADEF4BC2DD44D)
_SHORT = 0xA0761D6478BD642F


@lru_cache(maxsize=1)
def _powers(log_size: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, modulo 2**64."""
    out = []
    for base in (_BASE, pow(_BASE, -1, 1 << 64)):
        powers = np.full(1 << log_size, base, _U)
        powers[0] = 1
        out.append(np.multiply.accumulate(powers))
    return tuple(out)


def forget() -> None:
    """Let go the powers."""
    _powers.cache_clear()


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(31))) * _U(_MULTIPLIERS[1])
    x = (x ^ (x >> _U(27))) * _U(_MULTIPLIERS[2])
    return x ^ (x >> _U(33))


def word_hashes(text: str) -> np.ndarray:
    """A hash of every word, A to Z in lower case: a polynomial of its bytes, then mixed."""
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass").translate(_LOWER), np.uint8)
    blank = raw == 32
    edges = np.flatnonzero(np.diff(np.concatenate(([True], blank, [True])).astype(np.int8)))
    start, end = edges[::2], edges[1::2]
    if not len(start):
        return np.zeros(0, _U)
    power, inverse = _powers(max(17, len(raw).bit_length()))
    sums = np.zeros(len(raw) + 1, _U)
    np.cumsum((raw.astype(_U) + _U(1)) * power[: len(raw)], out=sums[1:])
    return _mix((sums[end] - sums[start]) * inverse[start] + (end - start).astype(_U) * _U(_SHORT))


def gram_set(text: str | None, words: int = WORDS) -> np.ndarray:
    """The sorted distinct n-gram hashes of a text."""
    w = word_hashes(text or "")
    if not len(w):
        return w
    n = min(words, len(w))
    grams = w[: len(w) - n + 1].copy()
    for k in range(1, n):
        grams = _mix(grams * _U(_MULTIPLIERS[0]) + w[k : len(w) - n + 1 + k] + _U(_BASE))
    if n < words:
        grams = _mix(grams ^ _U(_SHORT))
    return np.unique(_mix(grams + _U(words)))


def _digest(grams: np.ndarray) -> tuple[int, int]:
    return tuple(np.frombuffer(hashlib.blake2b(grams.tobytes(), digest_size=16).digest(), np.int64).tolist())


def prefix_size(n: int, percent: int) -> int:
    """N-grams of an ordered set of n of which a partner above the threshold has at least one among its own first."""
    return n - -(-percent * n // 100) + 1


def _codes(counts: np.ndarray) -> np.ndarray:
    """Counts on a logarithmic scale of 256 steps."""
    return np.minimum(255, np.floor(8 * np.log2(1.0 + counts))).astype(np.uint8)


def _keys(grams: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Places in the global order: the sketch's rank, then the hash."""
    return (codes[(grams >> _U(64 - SKETCH_BITS)).astype(np.int64)].astype(_U) << _U(56)) | (grams >> _U(8))


def _count(counts: np.ndarray, places: list[np.ndarray]) -> None:
    """Add the places' counts, chunk by chunk, so that nothing else of the sketch's size is held."""
    held = np.sort(np.concatenate(places))
    cuts = np.searchsorted(held, np.arange(0, len(counts) + 1, CHUNK))
    for k in range(len(cuts) - 1):
        if cuts[k] < cuts[k + 1]:
            counts[k * CHUNK : (k + 1) * CHUNK] += np.bincount(held[cuts[k] : cuts[k + 1]] - k * CHUNK, minlength=CHUNK).astype(np.int32)


def _profile(docs: DataFrame, words: int) -> DataFrame:
    """A row per document with its set's size and digest, and rows with chunks of each task's sketch."""
    schema = T.StructType([docs.schema["doc_id"], *(T.StructField(c, T.LongType()) for c in ("n", "d1", "d2")), T.StructField("sizes", T.ArrayType(T.IntegerType())), T.StructField("task", T.LongType()), T.StructField("chunk", T.IntegerType()), T.StructField("counts", T.BinaryType())])
    names = schema.names

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        counts, waiting, size = np.zeros(1 << SKETCH_BITS, np.int32), [], 0
        for frame in frames:
            rows = []
            for text in frame["text"]:
                grams = gram_set(text, words)
                rows.append((len(grams), *_digest(grams), np.bincount((grams >> _U(64 - SIZE_BITS)).astype(np.int64), minlength=1 << SIZE_BITS).astype(np.int32)))
                waiting.append((grams >> _U(64 - SKETCH_BITS)).astype(np.int32))
                size += len(grams)
                if size > BATCH_GRAMS:
                    _count(counts, waiting)
                    waiting, size = [], 0
            out = pd.DataFrame(rows, columns=["n", "d1", "d2", "sizes"])
            out.insert(0, "doc_id", frame["doc_id"].to_numpy())
            yield out.assign(task=None, chunk=None, counts=None).astype({"n": "int64", "task": "Int64", "chunk": "Int32"})
        if waiting:
            _count(counts, waiting)
        waiting = []
        parts = [(k, zlib.compress(x.tobytes(), 1)) for k, x in enumerate(counts.reshape(-1, CHUNK)) if x.any()]
        if parts:
            out = pd.DataFrame({"chunk": [k for k, _ in parts], "counts": [x for _, x in parts]}).astype({"chunk": "Int32"})
            yield out.assign(doc_id=None, n=None, d1=None, d2=None, sizes=None, task=TaskContext.get().partitionId())[names].astype({"n": "Int64", "d1": "Int64", "d2": "Int64"})

    return map_texts(docs.select("doc_id", "text"), each, schema)


def _merged_sketch(scratch: Scratch, parts: DataFrame) -> np.ndarray:
    """The codes of all counters: a tree of merges, each of a bounded number of chunks, then one byte a counter."""

    def merge(frame: pd.DataFrame) -> pd.DataFrame:
        total = sum(np.frombuffer(zlib.decompress(x), np.int32).astype(np.int64) for x in frame["counts"])
        return pd.DataFrame({"chunk": [frame["chunk"].iloc[0]], "task": [int(frame["task"].iloc[0])], "counts": [zlib.compress(np.minimum(total, 2**31 - 1).astype(np.int32).tobytes(), 1)]})

    while (parts.agg(F.max("task")).first()[0] or 0) > 0:
        parts = parts.select("chunk", F.floor(F.col("task") / MERGE).cast("long").alias("task"), "counts")
        parts = scratch.keep(parts.groupBy("chunk", "task").applyInPandas(merge, "chunk int, task long, counts binary"))
    codes = np.zeros(1 << SKETCH_BITS, np.uint8)
    for r in parts.select("chunk", "counts").toLocalIterator():  # at most one row a chunk
        codes[r.chunk * CHUNK : (r.chunk + 1) * CHUNK] = _codes(np.frombuffer(zlib.decompress(bytes(r.counts)), np.int32))
    return codes


def _prefixes(docs: DataFrame, codes, words: int, percent: int) -> DataFrame:
    schema = T.StructType([T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("d1", T.LongType()), T.StructField("n", T.LongType()), T.StructField("grams", T.ArrayType(T.LongType()))])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"].tolist(), frame["text"]):
                found = gram_set(text, words)
                if len(found):
                    first = np.sort(_keys(found, codes.value))[: prefix_size(len(found), percent)]
                    rows.append((doc, _digest(found)[0], len(found), first.view(np.int64)))
            yield pd.DataFrame(rows, columns=schema.names)

    return map_texts(docs.select("doc_id", "text").filter("doc_id IS NOT NULL"), each, schema)


def _borders(codes: np.ndarray, fragments: int) -> np.ndarray:
    """Keys that cut the global order into fragments of about even weight."""
    weight = np.bincount(codes, np.exp2(codes / 8.0), 256)
    upto = np.cumsum(weight)
    wanted = upto[-1] * np.arange(1, fragments) / fragments
    level = np.minimum(np.searchsorted(upto, wanted), 255)
    within = np.clip((wanted - (upto[level] - weight[level])) / np.maximum(weight[level], 1), 0, 0.999)
    return (level.astype(_U) << _U(56)) | (within * float(1 << 56)).astype(_U)


def _segments(docs: DataFrame, codes, borders: np.ndarray, words: int) -> DataFrame:
    """(id, d1, fragment, segment): the sets of the given documents, cut by fragments."""
    schema = T.StructType([T.StructField("id", docs.schema["doc_id"].dataType), T.StructField("d1", T.LongType()), T.StructField("fragment", T.IntegerType()), T.StructField("segment", T.ArrayType(T.LongType()))])

    def each(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for doc, text in zip(frame["doc_id"].tolist(), frame["text"]):
                grams = gram_set(text, words)
                part = np.searchsorted(borders, _keys(grams, codes.value), side="right")
                d1 = _digest(grams)[0]
                rows += [(doc, d1, int(k), grams[part == k].view(np.int64)) for k in np.unique(part)]
            yield pd.DataFrame(rows, columns=schema.names).astype({"fragment": "int32", "d1": "int64"})

    return map_texts(docs.select("doc_id", "text"), each, schema)


def _overlaps(scratch: Scratch, docs: DataFrame, chosen: DataFrame, pairs: DataFrame, codes, borders: np.ndarray, words: int, fragments: int) -> DataFrame:
    """(a, na, b, nb, common) of the given pairs: partial counts per fragment, summed. ``chosen``: (id, d1) of the sets."""
    ids = scratch.keep(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct())
    held = _segments(mark_ids(scratch, docs.select("doc_id", "text"), "doc_id", ids, "hit_").filter("hit_"), codes, borders, words).join(chosen.join(ids, "id", "left_semi"), ["id", "d1"], "left_semi")
    held = scratch.keep(held.dropDuplicates(["id", "fragment"]).drop("d1"))
    by_part = pairs.withColumn("fragment", F.explode(F.sequence(F.lit(0), F.lit(fragments - 1))))
    met = by_part.join(held.withColumnsRenamed({"id": "a", "segment": "x"}), ["a", "fragment"]).join(held.withColumnsRenamed({"id": "b", "segment": "y"}), ["b", "fragment"])

    partial = F.size(F.array_intersect("x", "y")).cast("long")
    return met.select("a", "na", "b", "nb", partial.alias("common")).groupBy("a", "na", "b", "nb").agg(F.sum("common").alias("common"))


def connected(scratch: Scratch, links: DataFrame) -> DataFrame:
    """(id, root): the least id of every node's component, by alternating large and small stars."""
    edges = scratch.keep(links.select("a", "b").filter("a != b").distinct())
    sign = None
    while True:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.join(least, "a").filter("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).filter("a != b").distinct()
        low = down.groupBy("a").agg(F.min("b").alias("m"))
        small = down.join(low, "a").select(F.explode(F.array(F.struct("a", F.col("m").alias("b")), F.struct(F.col("b").alias("a"), F.col("m").alias("b")))).alias("e")).select("e.a", "e.b").filter("a != b").distinct()
        edges = scratch.keep(small)
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if now == sign:
            return edges.groupBy("a").agg(F.min("b").alias("root")).withColumnRenamed("a", "id")
        sign = now


def components(spark: SparkSession, docs: DataFrame, words: int = WORDS, percent: int = PERCENT, fragments: int = FRAGMENTS) -> DataFrame:
    """doc_id, n_shingles, component_id of every row."""
    scratch = Scratch(spark, "ngram-join")
    profile = scratch.keep(_profile(docs, words))
    sketch = _merged_sketch(scratch, profile.filter("chunk IS NOT NULL").select("chunk", "task", "counts"))
    codes, borders = spark.sparkContext.broadcast(sketch), _borders(sketch, fragments)
    sets = profile.filter("chunk IS NULL").select("doc_id", "n", "d1", "d2", "sizes")
    classes = scratch.keep(sets.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc_id").alias("id")))

    # one set for each id; were an id to have several, the one of the least digest
    chosen = scratch.keep(classes.filter("id IS NOT NULL").groupBy("id").agg(F.min(F.struct("d1", "d2")).alias("d")).select("id", "d.d1"))

    sized = scratch.keep(sets.withColumnRenamed("doc_id", "id").join(chosen, ["id", "d1"], "left_semi").groupBy("id").agg(F.any_value("sizes").alias("sizes")))
    prefixes = _prefixes(docs, codes, words, percent).join(chosen, ["id", "d1"], "left_semi").dropDuplicates(["id"])
    by_gram = Window.partitionBy("gram")
    member = F.struct("id", "n", "pos")
    groups = scratch.keep(
        prefixes.select("id", "n", F.posexplode("grams").alias("pos", "gram"))
        .withColumn("size", F.count("*").over(by_gram))
        .filter("size > 1")
        .withColumn("pivot", F.min(member).over(by_gram))
        .drop("size")
    )

    def may_link(na: str, pa: str, nb: str, pb: str) -> F.Column:
        """Sizes near enough, and enough n-grams left from the first common one on."""
        near = (100 * F.least(na, nb) >= percent * F.greatest(na, nb))
        left = 1 + F.least(F.col(na) - F.col(pa), F.col(nb) - F.col(pb)) - 1
        return near & (left * (100 + percent) >= percent * (F.col(na) + F.col(nb)))

    def bounded(pairs: DataFrame) -> DataFrame:
        """The pairs whose strips leave room for enough common n-grams."""
        held = pairs.join(sized.select(F.col("id").alias("a"), F.col("sizes").alias("x")), "a").join(sized.select(F.col("id").alias("b"), F.col("sizes").alias("y")), "b")
        most = F.aggregate(F.zip_with("x", "y", lambda p, q: F.least(p, q)), F.lit(0), lambda p, q: p + q)
        return held.withColumn("most", most).filter(F.col("most") * (100 + percent) >= percent * (F.col("na") + F.col("nb"))).select("a", "na", "b", "nb", "most")

    def linked(pairs: DataFrame) -> DataFrame:
        enough = "100 * common >= {0} * (na + nb - common)".format(percent)
        return scratch.keep(_overlaps(scratch, docs, chosen, pairs, codes, borders, words, fragments).filter(enough).select("a", "b"))

    star = groups.select(F.col("pivot.id").alias("a"), F.col("pivot.n").alias("na"), F.col("pivot.pos").alias("pa"), F.col("id").alias("b"), F.col("n").alias("nb"), F.col("pos").alias("pb"))
    star = scratch.keep(bounded(star.filter("a != b").filter(may_link("na", "pa", "nb", "pb")).select("a", "na", "b", "nb").distinct()).drop("most"))
    links = linked(star)
    roots = scratch.keep(connected(scratch, links))

    labelled = groups.drop("pivot").join(roots, "id", "left").withColumn("root", F.coalesce("root", "id"))
    per_root = labelled.groupBy("gram", "root").agg(F.count("*").alias("k"))
    largest = per_root.groupBy("gram").agg(F.max_by("root", F.struct("k", "root")).alias("largest"), F.count("*").alias("roots")).filter("roots > 1").drop("roots")
    # coarser strips go along, so that most pairs end inside the join
    folded = F.transform(F.sequence(F.lit(0), F.lit(FOLDED - 1)), lambda k: F.aggregate(F.slice("sizes", k * WIDTH + 1, F.lit(WIDTH)), F.lit(0), lambda x, y: x + y))
    mixed = scratch.keep(labelled.join(largest, "gram").join(sized.select("id", folded.alias("strips")), "id"))
    member_columns = ("id", "n", "pos", "root", "strips")
    one = mixed.filter("root != largest").select("gram", *(F.col(c).alias(f"{c}1") for c in member_columns))
    other = mixed.select(F.col("gram").alias("gram2"), "largest", *(F.col(c).alias(f"{c}2") for c in member_columns))
    common = F.aggregate(F.zip_with("strips1", "strips2", lambda p, q: F.least(p, q)), F.lit(0), lambda p, q: p + q)
    room = common * (100 + percent) >= percent * (F.col("n1") + F.col("n2"))
    crossing = one.join(other, (F.col("gram") == F.col("gram2")) & (F.col("root1") != F.col("root2")) & ((F.col("id1") < F.col("id2")) | (F.col("root2") == F.col("largest"))) & may_link("n1", "pos1", "n2", "pos2") & room)
    first = F.col("id1") < F.col("id2")
    pair = [F.when(first, F.col(x)).otherwise(F.col(y)).alias(n) for n, x, y in (("a", "id1", "id2"), ("na", "n1", "n2"), ("b", "id2", "id1"), ("nb", "n2", "n1"))]
    crossing = scratch.keep(bounded(crossing.select(*pair).distinct().join(star.select("a", "b"), ["a", "b"], "left_anti")))
    for last in (False, True):
        if crossing.isEmpty():
            break
        chosen_pairs = crossing
        if not last:  # the likeliest partners of every set; what they link spares most other pairs
            rank = lambda c: F.row_number().over(Window.partitionBy(c).orderBy((F.col("most") / (F.col("na") + F.col("nb"))).desc(), "a", "b"))
            chosen_pairs = scratch.keep(crossing.withColumns({"ra": rank("a"), "rb": rank("b")}).filter(F.least("ra", "rb") <= LIKELY))
        links = scratch.keep(links.unionByName(linked(chosen_pairs.select("a", "na", "b", "nb"))))
        roots = scratch.keep(connected(scratch, links))
        if not last:
            rest = crossing.join(chosen_pairs.select("a", "b"), ["a", "b"], "left_anti")
            for c in ("a", "b"):
                rest = rest.join(roots.select(F.col("id").alias(c), F.col("root").alias(f"r{c}")), c, "left").withColumn(f"r{c}", F.coalesce(f"r{c}", c))
            crossing = scratch.keep(rest.filter("ra != rb").select("a", "na", "b", "nb", "most"))

    classes = classes.join(roots, "id", "left").select("d1", "d2", F.coalesce("root", "id").alias("root"))
    return (
        sets.join(classes.withColumnsRenamed({"d1": "e1", "d2": "e2"}), (F.col("d1") == F.col("e1")) & (F.col("d2") == F.col("e2")) & (F.col("n") > 0), "left")
        .select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("root", "doc_id").alias("component_id"))
    )


def distinct_documents(spark: SparkSession, docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """All columns of one document of each component, the one of the least id.

    Of rows that repeat a doc_id one stays. Rows without an id stay.
    """
    scratch = Scratch(spark, "ngram-distinct")
    found = components(spark, docs, words, percent).filter("doc_id IS NOT NULL").groupBy("doc_id").agg(F.min("component_id").alias("component_"), F.count("*").alias("times_"))
    found = scratch.keep(found.filter("component_ != doc_id OR times_ > 1").select(F.col("doc_id").alias("id_"), "component_"))
    # only rows that may go are exchanged
    marked = mark_ids(scratch, docs, "doc_id", found.select("id_"), "hit_")
    near = marked.filter("hit_").join(found.hint("merge"), F.col("doc_id") == F.col("id_"), "left")
    order = Window.partitionBy("doc_id", "component_").orderBy("text")
    near = near.withColumn("row_", F.row_number().over(order)).filter("component_ IS NULL OR (component_ = doc_id AND row_ = 1)")
    return near.select(*docs.columns).unionByName(marked.filter("NOT hit_").select(*docs.columns))
