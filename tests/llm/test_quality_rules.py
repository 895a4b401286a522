import itertools
import random
import re

import numpy as np

from veilgrid.llm.quality_rules import N_FEATURES, LineField, fit_line_field, judge, judge_documents, measure, repeated_words, retain_documents, self_train

WORDS = "the thing of and river stone walks slowly over bright fields near old town".split()


def sentence(rnd, n):
    return " ".join(rnd.choice(WORDS) for _ in range(n)).capitalize() + "."


def brute_counts(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    inside = {j for i, w in enumerate(windows) if windows.count(w) > 1 for j in range(i, i + 5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    dups = sum(x in lines[:i] for i, x in enumerate(lines))
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dups, len(inside)


def test_counts_against_brute_force():
    rnd = random.Random(5)
    for _ in range(300):
        text = "".join(rnd.choice(["a", "bé", " ", "\n", "\t", "\x0b", "#", "|", " ", "c d e f g "]) for _ in range(rnd.randint(0, 80)))
        assert measure(text)[0] == brute_counts(text)
    assert repeated_words([]) == 0 and repeated_words("a b c d e a b c d e".split()) == 10


def test_viterbi_is_the_best_sequence():
    rnd = np.random.default_rng(6)
    field = LineField(rnd.normal(size=(N_FEATURES, 2)), rnd.normal(size=(2, 2)))
    for n in range(1, 8):
        rows = [sorted(set(rnd.integers(0, N_FEATURES, 4).tolist())) for _ in range(n)]

        def score(labels):
            return sum(field.emit[f, y].sum() for f, y in zip(rows, labels)) + sum(field.move[a, b] for a, b in zip(labels, labels[1:]))

        assert score(field.viterbi(rows)) == max(map(score, itertools.product((0, 1), repeat=n))) or np.isclose(score(field.viterbi(rows)), max(map(score, itertools.product((0, 1), repeat=n))))


def test_held_out_documents(spark):
    rnd = random.Random(7)
    good = ["\n".join(sentence(rnd, rnd.randint(8, 30)) for _ in range(rnd.randint(1, 8))) for _ in range(120)]
    junk = [" ".join(w.upper() + "!!" for w in rnd.choices(WORDS, k=40)) + "\n" + " ".join(w + "***" for w in rnd.choices(WORDS, k=40)) for _ in range(120)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(good + junk)] + [(900, None, "x"), (901, "", "x"), (902, "two words", "x")], "doc_id long, text string, kept string")
    labels = spark.createDataFrame([(i, int(i < 120), 0) for i in range(240) if i % 2] + [(None, 1, 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    field = fit_line_field(spark, docs, labels)
    rows = {r.doc_id: r for r in judge_documents(docs, field).collect()}
    held = [i for i in range(240) if i % 2 == 0]
    assert sum(rows[i].kept == (i < 120) for i in held) >= 0.95 * len(held)
    assert all(rows[i].base_failed and not rows[i].kept for i in (900, 901, 902))
    kept = retain_documents(docs, field)
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, r in rows.items() if r.kept)
    # no labels: the base rules decide alone
    assert fit_line_field(spark, docs, labels.limit(0)) is None
    assert judge_documents(docs, None).filter("kept").count() == sum(not r.base_failed for r in rows.values())
    assert judge_documents(docs.limit(0), field).count() == 0


def shout(rnd, n):
    return " ".join(w.upper() + "!!" for w in rnd.choices(WORDS, k=n))


def test_lines_are_labelled_inside_documents():
    rnd = random.Random(8)
    good = [[sentence(rnd, rnd.randint(8, 30)) for _ in range(rnd.randint(2, 8))] for _ in range(150)]
    bad = [[shout(rnd, rnd.randint(8, 30)) for _ in range(rnd.randint(2, 8))] for _ in range(150)]
    for lines in bad[::2]:  # a proper sentence above and below the junk
        lines.insert(0, sentence(rnd, 12))
        lines.append(sentence(rnd, 12))
    for lines in good[::3]:
        lines.insert(1, shout(rnd, 5))
    runs = [(d, label, measure("\n".join(x))[1]) for label, kind in ((1, good), (0, bad)) for d, x in enumerate(kind, 1000 * label)]
    field = self_train(runs)
    lines = [sentence(rnd, 14), shout(rnd, 20), shout(rnd, 25), sentence(rnd, 10), sentence(rnd, 12), shout(rnd, 9)]
    assert field.viterbi(measure("\n".join(lines))[1]) == [1, 0, 0, 1, 1, 0]
    # mixed documents; a single short line among many others may be smoothed over
    mixed = [[judge("\n".join(x), field)[6] for x in kind] for kind in (bad[::2], good[::3])]
    assert sum(0 < s < 1 for s in mixed[0]) >= 0.95 * len(mixed[0]) and sum(0 < s < 1 for s in mixed[1]) >= 0.3 * len(mixed[1])
    assert all(judge("\n".join(x), field)[7] for x in good[::3])
    # transitions come from lines that differ inside their document, and matter
    apart = LineField.train([r for _, _, r in runs], [[y] * len(r) for _, y, r in runs], np.ones(len(runs)), chained=False)
    assert np.allclose(apart.move, 0) and not np.allclose(field.move, 0)
    assert self_train([r for r in runs if r[1]]) is None


def brute_likelihood(field, rows, labels):
    """Log-probability of a labelling, over all labellings."""
    score = lambda y: sum(field.emit[f, k].sum() for f, k in zip(rows, y)) + sum(field.move[a, b] for a, b in zip(y, y[1:]))
    return score(labels) - np.logaddexp.reduce([score(y) for y in itertools.product((0, 1), repeat=len(rows))])


def test_training_raises_the_likelihood_of_whole_sequences():
    rnd = random.Random(10)
    runs = [[sorted(rnd.sample(range(N_FEATURES), 3)) for _ in range(rnd.randint(1, 6))] for _ in range(20)]
    labels = [[rnd.randint(0, 1) for _ in r] for r in runs]
    weights = np.full(20, 1 / 20)
    total = lambda f: sum(brute_likelihood(f, r, y) for r, y in zip(runs, labels))
    fields = [LineField.train(runs, labels, weights, rounds=n, decay=0.0) for n in (1, 20, 200)]
    assert total(fields[0]) < total(fields[1]) < total(fields[2])
    # at the end, no step of a transition raises it
    best = LineField.train(runs, labels, weights, rounds=1500, rate=0.05, decay=0.05)
    penalty = lambda f: 0.05 / 2 * ((f.emit**2).sum() + (f.move**2).sum())
    value = total(best) / 20 - penalty(best)
    for place in [(0, 0), (1, 0)]:
        for step in (-0.2, 0.2):
            move = best.move.copy()
            move[place] += step
            other = LineField(best.emit, move)
            assert total(other) / 20 - penalty(other) < value


def test_long_texts_repeated_rows_and_other_columns(spark):
    rnd = random.Random(9)
    long_good, long_bad = "\n".join(sentence(rnd, 15) for _ in range(3000)), "\n".join(shout(rnd, 15) for _ in range(3000))
    rows = [(1, long_good), (2, long_bad), (3, sentence(rnd, 30)), (4, shout(rnd, 30)), (1, long_good), (None, long_good), (None, None)]
    docs = spark.createDataFrame([(d, t, 1, True, "x") for d, t in rows], "doc_id long, text string, n_words int, kept boolean, quality string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 0)], "doc_id long, quality int")
    field = fit_line_field(spark, docs, labels)
    found = judge_documents(docs, field).collect()
    assert sorted((r.doc_id or 0, r.kept) for r in found) == [(0, False), (0, True), (1, True), (1, True), (2, False), (3, True), (4, False)]
    assert {(r.n_words, r.n_dup_lines) for r in found if r.doc_id == 1} == {(45_000, 0)}
    kept = retain_documents(docs, field)
    assert kept.columns == docs.columns and sorted((r.doc_id or 0, r.n_words, r.quality) for r in kept.collect()) == [(0, 1, "x"), (1, 1, "x"), (1, 1, "x"), (3, 1, "x")]
    bounded = fit_line_field(spark, docs, labels, segments=20)
    assert bounded is None or bounded.emit.shape == field.emit.shape
