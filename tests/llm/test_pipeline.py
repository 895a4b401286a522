import itertools
import random
import re
import string
import sys
from pathlib import Path

import duckdb
import pandas as pd
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import types as T

import corpus_pipeline
from veilgrid.llm import oracles
from veilgrid.llm.common import WORD, Scratch, map_texts
from veilgrid.llm.packing import token_pieces
from veilgrid.llm.quality_classifier import _row_features, fit_quality, pack_features
from veilgrid.llm.quality_rules import fit_line_field, judge, measure

WORDS, LOWER = re.compile(WORD), str.maketrans(string.ascii_uppercase, string.ascii_lowercase)

DATA = Path("/root/testdata/sf0.001")


def test_stages(spark):
    if not DATA.exists():
        pytest.skip("no data tables here")
    scratch = Scratch(spark, "test-pipeline")
    docs = table = spark.read.parquet(str(DATA / "documents.parquet"))
    before = {r.doc_id: r for r in table.collect()}
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "quality_classifier", "line_dedup", "ngram_jaccard_join", "best_fit_packing"]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, str(DATA)))
        assert docs.columns == table.columns
        rows = {r.doc_id: r for r in docs.collect()}
        assert set(rows) <= set(before)
        for i, r in rows.items():
            lines = before[i].text.split("\n")
            assert set(r.text.split("\n")) <= set(lines) and (r.lang, r.source) == (before[i].lang, before[i].source)
            assert name in ("quality_rules", "quality_classifier") or r.n_chars == len(r.text)
        before = rows
    labels = {r.doc_id: r.quality for r in spark.read.parquet(str(DATA / "labels.parquet")).collect()}
    texts = {r.doc_id: r.text for r in table.collect()}
    clean = [i for i, q in labels.items() if q == 1 and measure(texts[i])[0][0] >= 10]
    after_models = spark.read.parquet(str(DATA / "documents.parquet"))
    for _, stage in corpus_pipeline.STAGES[:2]:
        after_models = scratch.keep(stage(spark, after_models, str(DATA)))
    kept = {r.doc_id for r in after_models.select("doc_id").collect()}
    assert sum(i in kept for i in clean) >= 0.9 * len(clean)
    assert not any(i in kept for i, q in labels.items() if q == 0 and i in texts) or sum(i in kept for i, q in labels.items() if q == 0) <= 0.1 * len(labels)
    packed = corpus_pipeline.sequences(spark, docs, str(DATA)).collect()
    assert {r.doc_id for r in packed} == set(before)
    room = {}
    for r in packed:
        room.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for held in room.values():
        at = 0
        for offset, length in sorted(held):
            assert offset == at
            at += length
        assert at <= 4096


def written(spark, folder, docs, labels):
    docs.write.parquet(f"{folder}/documents.parquet")
    labels.write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def odd_documents(spark):
    """Odd rows among plain ones, in a table with columns whose names the operators use themselves."""
    rnd = random.Random(14)
    words = "the river of stones went over bright fields near an old town and its people sang".split()
    # distinct words make the texts distinct
    sentence = lambda k, n: " ".join(f"{rnd.choice(words)}{rnd.choice('abcdefgh')}{k if j % 3 == 0 else ''}" for j in range(n)).capitalize() + "."
    texts = [(i, "\n".join(sentence(i, rnd.randint(12, 25)) for _ in range(rnd.randint(2, 5)))) for i in range(60)]
    texts += [(100 + i, " ".join(f"{w.upper()}!!" for w in rnd.choices(words, k=40)) + f" {i}!!") for i in range(40)]
    long = "\n".join(sentence(1000 + k, 18) for k in range(1500))
    base = dict(texts)
    texts += [(200, None), (201, ""), (202, " \n "), (203, long), (None, sentence(77, 30)), (None, None), (5, base[5]), (5, base[5]), (204, base[7]), (205, base[8].replace("the", "thy", 1)), (206, long + "\n" + sentence(99, 14))]
    names = "doc kept hash size id gram n_words n_lines_removed score label component_id piece sequence_id offset".split()
    rows = [(i, t, "en", "s", None if t is None else len(t), *("x",) * len(names)) for i, t in texts]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{n} string" for n in names))
    labels = spark.createDataFrame([(i, int(i < 60), 0) for i in [*range(0, 60, 2), *range(100, 140, 2)]] + [(None, 1, 0), (3, None, None)], "doc_id long, quality int, toxic int")
    return docs, labels


def test_stages_on_odd_documents(spark, tmp_path):
    docs, labels = odd_documents(spark)
    folder = written(spark, tmp_path, docs, labels)
    now, columns = docs, docs.columns
    stages = dict(corpus_pipeline.STAGES)
    scratch = Scratch(spark, "test-odd")
    kept = {}
    for name in list(stages)[:-1]:
        now = scratch.keep(stages[name](spark, now, folder))
        assert now.columns == columns
        kept[name] = sorted((r.doc_id is None, r.doc_id) for r in now.collect())
        # every stage also takes the odd rows themselves and an empty table
        out = stages[name](spark, docs, folder)
        assert out.columns == columns and out.count() <= docs.count()
        assert stages[name](spark, docs.limit(0), folder).count() == 0
    ids = {n: [i for _, i in v] for n, v in kept.items()}
    assert not {100 + i for i in range(40)} & set(ids["quality_rules"]) and {200, 201, 202}.isdisjoint(ids["quality_rules"])
    assert set(range(60)) | {203, 206} <= set(ids["quality_classifier"]) and ids["quality_classifier"].count(5) == 3
    assert ids["line_dedup"].count(5) <= 1 and 206 not in ids["line_dedup"]  # it kept one line of 1,501
    assert 203 in ids["ngram_jaccard_join"] and {204, 205}.isdisjoint(ids["ngram_jaccard_join"])
    assert set(range(60)) <= set(ids["ngram_jaccard_join"])
    packed = stages["best_fit_packing"](spark, now, folder).collect()
    assert {r.doc_id for r in packed} == set(ids["ngram_jaccard_join"]) and max(r.offset + r.length for r in packed) <= 4096
    assert stages["best_fit_packing"](spark, docs, folder).count() >= docs.count()
    assert stages["best_fit_packing"](spark, docs.limit(0), folder).count() == 0


def test_without_labels_only_the_base_rules_reject(spark, tmp_path):
    docs, labels = odd_documents(spark)
    folder = written(spark, tmp_path, docs, labels.limit(0))
    out = corpus_pipeline.rules(spark, docs, folder)
    assert sorted(r.text for r in out.collect()) == sorted(r.text for r in docs.collect() if not judge(r.text, None)[5])
    assert corpus_pipeline.classifier(spark, docs, folder).count() == docs.count()


def test_stages_against_brute_force(spark):
    if not DATA.exists():
        pytest.skip("no data tables here")
    scratch = Scratch(spark, "test-brute")
    docs = spark.read.parquet(str(DATA / "documents.parquet"))
    labels = spark.read.parquet(str(DATA / "labels.parquet"))
    rows = {r.doc_id: r.asDict() for r in docs.collect()}
    held = {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = scratch.keep(stage(spark, docs, str(DATA)))
        held[name] = {r.doc_id: r.asDict() for r in docs.collect()}
    whole = spark.read.parquet(str(DATA / "documents.parquet"))
    field, model = fit_line_field(spark, whole, labels), fit_quality(spark, whole, labels)
    expected = {i: r for i, r in rows.items() if judge(r["text"], field)[-1]}
    assert held["quality_rules"] == expected
    expected = {i: r for i, r in expected.items() if model.score(*_row_features(r["text"], r["lang"], r["source"], r["n_chars"]))[2] >= 0.5}
    assert held["quality_classifier"] == expected
    con = duckdb.connect()
    con.execute("CREATE TABLE docs (doc_id BIGINT, text VARCHAR)")
    con.executemany("INSERT INTO docs VALUES (?, ?)", [(i, r["text"]) for i, r in expected.items()])
    gone = {}
    for doc, line in con.execute(f"WITH {oracles.REMOVED_LINES.format(docs='docs')} SELECT doc, line FROM gone").fetchall():
        gone.setdefault(doc, set()).add(line - 1)
    after = {}
    for i, r in expected.items():
        lines = r["text"].split("\n")
        text = "\n".join(x for k, x in enumerate(lines) if k not in gone.get(i, ()))
        left, lost = len(WORDS.findall(text)), sum(len(WORDS.findall(lines[k])) for k in gone.get(i, ()))
        if i not in gone or left >= lost:
            after[i] = r | ({"text": text, "n_chars": len(text)} if i in gone else {})
    assert held["line_dedup"] == after
    sets = {}
    for i, r in after.items():
        w = [x.translate(LOWER) for x in WORDS.findall(r["text"])]
        sets[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in itertools.combinations(sorted(sets), 2):
        common = len(sets[a] & sets[b])
        if common and 100 * common >= 80 * (len(sets[a]) + len(sets[b]) - common):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    assert held["ngram_jaccard_join"] == {i: r for i, r in after.items() if find(i) == i}


def test_workers_hold_no_tables_of_earlier_operators(spark):
    docs = spark.range(8).selectExpr("id AS doc_id", "concat('some words of document ', id) AS text").coalesce(1)
    pack_features(docs).collect()
    token_pieces(docs, public_tokenizers.path("word_bpe_49k.json")).collect()

    def held(frames):
        for frame in frames:
            words, packing = sys.modules.get("veilgrid.llm.quality_classifier"), sys.modules.get("veilgrid.llm.packing")
            left = len(words._buckets if words else ()) + (packing.tokenizer.cache_info().currsize if packing else 0)
            yield pd.DataFrame({"doc_id": frame["doc_id"], "left": left, "met": words is not None and packing is not None})

    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("left", T.LongType()), T.StructField("met", T.BooleanType())])
    rows = map_texts(docs, held, schema).collect()
    assert {(r.left, r.met) for r in rows} == {(0, True)}


def test_stages_hold_little_of_a_table_at_once(spark, tmp_path):
    """Every task has a row group that it reads and one that it writes on the heap."""
    words = "array_join(transform(sequence(1, 40), k -> sha2(concat(id, ' ', k), 512)), ' ')"
    docs = spark.range(0, 9000, 1, 1).selectExpr("id AS doc_id", f"{words} AS text")
    folder = written(spark, tmp_path, docs, spark.createDataFrame([], "doc_id long, quality int"))
    corpus_pipeline.rules(spark, spark.read.parquet(f"{folder}/documents.parquet"), folder).coalesce(1).write.parquet(f"{folder}/out")
    (path,) = Path(folder, "out").glob("*.parquet")
    made = pq.ParquetFile(path).metadata
    assert made.num_rows == 9000
    assert max(made.row_group(k).total_byte_size for k in range(made.num_row_groups)) < 20 << 20 < sum(made.row_group(k).total_byte_size for k in range(made.num_row_groups))
    assert int(spark.conf.get("spark.sql.parquet.columnarReaderBatchSize")) <= 1000
