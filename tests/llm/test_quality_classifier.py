import random

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from veilgrid.llm.quality_classifier import SHAPES, _bucket, _logistic, _Rows, fit_quality, pack_features, retain_documents, score_documents, score_packed

WORDS = [f"{a}{b}{c}" for a in ("th", "on", "re", "wa") for b in ("er", "al", "in") for c in ("ing", "ed", "s", "ly")]


def documents(spark, n=400):
    rnd = random.Random(9)
    rows = []
    for i in range(n):
        good = i % 3 != 0
        words = rnd.choices(WORDS, k=rnd.randint(20, 80)) if good else [rnd.choice(WORDS).upper() + "!!"] * rnd.randint(20, 60)
        rows.append((i, " ".join(words), "en" if rnd.random() < 0.8 else None, f"s{i % 5 if good else 5 + i % 2}", len(words) * 6, "clash"))
    return rows, spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, score string")


def test_held_out_accuracy(spark):
    rows, docs = documents(spark)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(0, 400, 2)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    model = fit_quality(spark, docs, labels, labelled=120, pool=60)
    made = {r.doc_id: r for r in score_documents(docs, model).collect()}
    held = range(1, 400, 2)
    assert np.mean([made[i].kept == (i % 3 != 0) for i in held]) >= 0.97
    # metadata alone already tells something here, and scores are probabilities
    assert np.mean([made[i].metadata_score for i in held if i % 3]) > np.mean([made[i].metadata_score for i in held if i % 3 == 0])
    assert all(0 <= x <= 1 for r in made.values() for x in r[1:4])


def test_odd_rows(spark):
    _, docs = documents(spark, 40)
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(40)], "doc_id long, quality int, toxic int")
    model = fit_quality(spark, docs, labels)
    odd = spark.createDataFrame([(1, None, None, None, None), (2, "", "en", "s", 0), (2, "", "en", "s", 0), (3, "x" * 300_000, "en", "s", -5)], "doc_id long, text string, lang string, source string, n_chars long")
    assert score_documents(odd, model).count() == 4
    assert score_documents(odd.limit(0), model).count() == 0
    assert score_documents(odd.drop("lang", "n_chars"), model).count() == 4
    kept = retain_documents(odd.drop("lang").withColumn("kept", odd.text), model)
    assert kept.columns == ["doc_id", "text", "source", "n_chars", "kept"]
    expected = sorted(r.doc_id for r in score_documents(odd.drop("lang"), model).filter("kept").collect())
    assert sorted(r.doc_id for r in kept.collect()) == expected
    assert fit_quality(spark, docs, labels.filter("quality = 1")) is None
    rows = score_documents(odd, None).collect()
    assert all(r.score is None and r.kept for r in rows)


def test_logistic_gradient_reaches_the_optimum():
    rnd = np.random.default_rng(10)
    x = rnd.normal(size=(300, 3))
    y = (rnd.random(300) < 1 / (1 + np.exp(-(x @ [1, -2, 0.5] + 0.3)))).astype(float)
    w = _logistic(_Rows([([0, 1, 2], list(r)) for r in x], 3), y, np.ones(300), 2000, 0.05, 0.0)
    residual = y - 1 / (1 + np.exp(-(w[0] + x @ w[1:])))
    assert abs(residual.mean()) < 1e-3 and np.abs(x.T @ residual / 300).max() < 1e-3


def test_scores_keep_the_share_of_all_labels(spark):
    docs = spark.createDataFrame([(i, "the same words", "en", "s", 14) for i in range(720)], "doc_id long, text string, lang string, source string, n_chars long")
    labels = spark.createDataFrame([(i, int(i % 6 != 0), 0) for i in range(720)], "doc_id long, quality int, toxic int")
    scores = [score_documents(docs.limit(1), fit_quality(spark, docs, labels, labelled=n)).first().score for n in (60, 720)]
    assert all(abs(s - 5 / 6) < 0.04 for s in scores) and abs(scores[0] - scores[1]) < 0.02


def test_every_unlabelled_document_teaches(spark):
    """A word that only documents beyond the first 3,000 by hash hold is learnt from their metadata."""
    docs = spark.range(4200).select(F.col("id").alias("doc_id"), (F.col("id") % 2 == 0).alias("good"), F.xxhash64(F.lit("co-training"), "id").alias("place"))
    docs = docs.withColumn("late", (F.col("doc_id") >= 900) & (F.row_number().over(Window.orderBy(F.col("doc_id") < 900, "place")) > 3000))
    said = F.when(F.col("late"), F.when(F.col("good"), "plain words omega").otherwise("plain words zeta")).otherwise("plain words")
    docs = docs.select("doc_id", said.alias("text"), F.lit("en").alias("lang"), F.when(F.col("good"), "a").otherwise("b").alias("source"), F.lit(14).cast("long").alias("n_chars")).cache()
    labels = spark.range(900).select(F.col("id").alias("doc_id"), (1 - F.col("id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    model = fit_quality(spark, docs, labels)
    omega, zeta = (model.content[1 + SHAPES + _bucket(w)] for w in ("omega", "zeta"))
    assert docs.filter("text like '%zeta'").count() > 50 and omega > 0.05 and zeta < -0.05


def test_scores_from_packed_features(spark):
    rnd = random.Random(21)
    words = "the river and old town of bright stones walks over fields".split()
    rows = [(i, " ".join(rnd.choice(words) if i % 2 else rnd.choice(words).upper() + "!!" for _ in range(rnd.randint(5, 60))), "en", "web" if i % 3 else "shop", 10 * i) for i in range(120)]
    rows += [(500, None, None, None, None), (501, "", "en", "web", 0), (502, "the river " * 30_000, "en", "web", 300_000), (None, "no id", "en", "web", 5), (7, rows[7][1], "en", "web", 70)]
    docs = spark.createDataFrame([(*r, "x", 1.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, label string, score double")
    labels = spark.createDataFrame([(i, i % 2) for i in range(0, 120, 3)] + [(None, 1)], "doc_id long, quality int")
    model = fit_quality(spark, docs, labels)
    plain = sorted((r.doc_id or -1, r.content_score, r.metadata_score, r.score) for r in score_documents(docs, model).collect())
    quick = sorted((r.doc_id or -1, r.content_score, r.metadata_score, r.score) for r in score_packed(pack_features(docs), model).collect())
    assert len(plain) == len(quick) == len(rows) and np.allclose(plain, quick, atol=1e-5)
    kept = retain_documents(docs, model)
    assert kept.columns == docs.columns and {r.label for r in kept.collect()} <= {"x"}
    assert [r.score for r in score_packed(pack_features(docs), None).collect()] == [None] * len(rows)
    assert score_packed(pack_features(docs.limit(0)), model).count() == 0
