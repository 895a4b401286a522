import random
import zlib

from veilgrid.llm.sharding import shard_digest, shard_rows


def rows_of(df):
    by = {}
    for r in df.collect():
        by.setdefault(r.shard, []).append(r)
    for held in by.values():
        assert sorted(r.slot for r in held) == list(range(len(held)))
    return by


def test_equal_bytes_with_hot_group(spark):
    rnd = random.Random(8)
    texts = ["x" * rnd.randint(0, 60) + str(i) for i in range(4000)] + ["copy " * 12] * 2000 + [None] * 20
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = rows_of(shard_digest(spark, docs))
    size = {k: sum(r.size for r in v) for k, v in by.items()}
    mean = sum(size.values()) / 40
    assert sorted(size) == list(range(40))
    assert max(abs(s - mean) for s in size.values()) <= 0.1 * mean
    seen = {r.doc_id: r for v in by.values() for r in v}
    assert len(seen) == len(texts)
    for i, text in enumerate(texts):
        raw = (text or "").encode()
        assert (seen[i].size, seen[i].text_crc32, seen[i].grown_shard, seen[i].law) == (len(raw) + 16, zlib.crc32(raw), None, "bytes")


def test_few_rows_repeats_and_other_columns(spark):
    docs = spark.createDataFrame([(1, "a", 5, "k"), (1, "a", 5, "k"), (2, None, None, None), (3, "é" * 400_000, 1, "")], "doc_id long, text string, rows_ int, size string")
    docs = docs.withColumnRenamed("size", "note")
    by = rows_of(shard_rows(spark, docs, shards=3))
    assert sum(map(len, by.values())) == 4
    assert {r.note for v in by.values() for r in v} == {"k", None, ""}
    assert shard_digest(spark, docs.limit(0)).count() == 0


def test_only_large_groups_are_cut(spark):
    rnd = random.Random(9)
    texts = [f"{i} " + "y" * rnd.randint(0, 300) for i in range(3000)]
    small = [f"group {g} " + "z" * 200 for g in range(60)]  # 8 copies each, about a seventh of a shard's tolerance
    texts += [t for t in small for _ in range(8)] + ["big " * 50] * 1500 + [None] * 30
    rnd.shuffle(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    by = rows_of(shard_digest(spark, docs))
    size = {k: sum(r.size for r in v) for k, v in by.items()}
    mean = sum(size.values()) / 40
    assert max(abs(s - mean) for s in size.values()) <= 0.1 * mean
    where = {}
    for shard, held in by.items():
        for r in held:
            where.setdefault(texts[r.doc_id], set()).add(shard)
    cut = {t for t, shards in where.items() if len(shards) > 1}
    assert cut == {"big " * 50}


def test_null_ids_and_a_text_larger_than_a_shard(spark):
    docs = spark.createDataFrame([(None, "a"), (None, None), (1, "b" * 2_000_000)] + [(i, f"c{i}") for i in range(2, 60)], "doc_id long, text string")
    rows = [r for v in rows_of(shard_digest(spark, docs, shards=4)).values() for r in v]
    assert len(rows) == 61 and sum(r.size for r in rows) == sum(len(t or "") + 16 for _, t in [(0, "a"), (0, None), (1, "b" * 2_000_000)] + [(0, f"c{i}") for i in range(2, 60)])
