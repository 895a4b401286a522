"""Line dedup by winnowing over line hashes.

Lines that hold a word are hashed. A window starts at every such line and takes in
lines until it has ``min_words`` words; its least line hash is a fingerprint of the
document, so any two places that share a run of that many words share a
fingerprint. Fingerprints that occur once in the corpus drop out with the windows
they stand for. The other windows are joined, by the hash of all their lines, to the
first place (by document and line) that has the same; each join fixes a diagonal,
the pair of documents with the distance of the positions. Along a diagonal the match
is extended both ways, line by line, and every run of equal lines with ``min_words``
words or more is deleted from the later place. The earliest place of every line so
deleted stays; of a passage that repeats inside itself (forty equal short lines), that
is the first line alone, however short. Only whole equal lines are compared: a passage
whose ends lie inside longer lines keeps those.

Windows are joined by all their lines, not by the fingerprint alone, for the first place
of a line need not be the first of the run around it, and pairing all places of a line
that many documents share would grow with the square of their number.

Lines without a word are not compared and stay. Null texts stay null; a document
whose lines all go keeps an empty text. Rows that repeat a doc_id are one
document's copies: they are numbered, and each but the first loses what it repeats.
An empty table gives an empty result. Only DataFrame functions run; line hashes are
pairs of 64-bit hashes. A passage that very many documents share costs each of them
one join row: places meet only the first, never each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from veilgrid.llm.common import WORD, Scratch, mark_ids

MIN_WORDS = 50


def _lines(docs: DataFrame) -> DataFrame:
    """(doc, line, pos, hash, words) of lines with a word; pos counts only those."""
    at = F.posexplode(F.split("text", "\n", -1)).alias("line", "content")
    words = F.regexp_count("content", F.lit(WORD)).alias("words")
    lines = docs.filter("text IS NOT NULL").select("doc", at).select("doc", "line", F.struct(F.xxhash64("content").alias("a"), F.xxhash64(F.lit("line"), "content").alias("b")).alias("hash"), words).filter("words > 0")
    by_line = Window.partitionBy("doc").orderBy("line")
    return lines.withColumn("pos", F.row_number().over(by_line)).withColumn("upto", F.sum("words").over(by_line.rowsBetween(Window.unboundedPreceding, 0)) - F.col("words"))


def removed_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """(doc, line, words) of every deleted line; ``docs`` has an orderable, unique ``doc`` and a ``text``."""
    scratch = Scratch(spark, "line-dedup")
    # a run's words: at most what one window needs beyond its first line
    ahead = Window.partitionBy("doc").orderBy("upto").rangeBetween(0, min_words - 1)
    hashes = F.transform("window", lambda x: x["hash"])
    lines = scratch.keep(
        _lines(docs)
        .withColumn("window", F.collect_list(F.struct("hash", "pos")).over(ahead))
        .withColumn("full", F.sum("words").over(ahead) >= min_words)
        .select(
            "doc", "line", "pos", "hash", "words",
            F.when(F.col("full"), F.array_min("window")).alias("least"),
            F.when(F.col("full"), F.struct(F.xxhash64(hashes).alias("a"), F.xxhash64(F.lit("window"), hashes).alias("b"))).alias("content"),
        )
    )
    windows = lines.filter("least IS NOT NULL")
    place = F.struct("doc", "least.pos")
    shared = windows.groupBy("least.hash").agg(F.min(place).alias("x"), F.max(place).alias("y")).filter("x != y").select("hash")
    windows = windows.select("content", "doc", "pos", F.col("least.hash").alias("hash")).join(shared.hint("merge"), "hash", "left_semi")
    first = windows.groupBy("content").agg(F.min(F.struct("doc", "pos")).alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    diagonals = scratch.keep(
        windows.join(first.hint("merge"), "content")
        .filter(F.struct("doc", "pos") != F.col("first"))
        .select("doc", F.col("first.doc").alias("origin"), (F.col("pos") - F.col("first.pos")).alias("shift"))
        .distinct()
    )
    later = diagonals.hint("merge").join(lines.select("doc", "line", "pos", "hash", "words"), "doc").withColumn("at", F.col("pos") - F.col("shift"))
    early = lines.select(F.col("doc").alias("origin"), F.col("pos").alias("at"), "hash")
    equal = later.join(early.hint("merge"), ["origin", "at", "hash"])
    on = ["doc", "origin", "shift"]
    run = equal.withColumn("run", F.col("pos") - F.row_number().over(Window.partitionBy(*on).orderBy("pos")))
    size = F.sum("words").over(Window.partitionBy(*on, "run"))
    return run.withColumn("size", size).filter(F.col("size") >= min_words).select("doc", "line", "words").distinct()


def dedup_lines(spark: SparkSession, docs: DataFrame, min_words: int = MIN_WORDS) -> DataFrame:
    """All columns of ``docs`` with the text that stays, ``n_lines_removed`` and ``n_words_removed`` (replaced if there are such)."""
    docs = docs.drop("n_lines_removed", "n_words_removed")
    scratch = Scratch(spark, "line-dedup-rows")
    ties = Window.partitionBy("doc_id").orderBy("text", *(c for c, k in docs.dtypes if c not in ("doc_id", "text") and not k.startswith(("map", "variant"))))
    held = docs
    keys = docs.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1 OR doc_id IS NULL")
    if not keys.isEmpty():  # only then rows are numbered by a window
        held = docs.withColumn("copy_", F.row_number().over(ties))
    else:
        held = docs.withColumn("copy_", F.lit(1))
    doc = F.struct(F.col("doc_id").alias("id"), F.col("copy_").alias("copy"))
    gone = removed_lines(spark, held.select(doc.alias("doc"), "text"), min_words)
    gone = scratch.keep(gone.groupBy("doc").agg(F.collect_list("line").alias("gone_"), F.sum("words").alias("words_")))
    # only texts that may lose lines are exchanged
    marked = mark_ids(scratch, held.withColumn("doc_", doc), "doc_", gone.select("doc"), "hit_")
    changed = marked.filter("hit_").join(gone.withColumnRenamed("doc", "doc_").hint("merge"), "doc_", "left")
    joined = changed.unionByName(marked.filter("NOT hit_").withColumns({"gone_": F.lit(None).cast("array<int>"), "words_": F.lit(None).cast("long")}))
    left = F.filter(F.split("text", "\n", -1), lambda x, k: ~F.array_contains("gone_", k))
    text = F.when(F.col("gone_").isNull(), F.col("text")).otherwise(F.array_join(left, "\n"))
    return joined.select(*(text.alias(c) if c == "text" else F.col(c) for c in docs.columns), F.coalesce(F.size("gone_"), F.lit(0)).cast("long").alias("n_lines_removed"), F.coalesce("words_", F.lit(0)).cast("long").alias("n_words_removed"))
