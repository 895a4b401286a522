import random
import re

import pytest

from veilgrid.llm.ngram_join import components, gram_set


def brute(docs, words, percent):
    sets = {}
    for i, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets[i] = {tuple(w[k : k + words]) for k in range(len(w) - words + 1)} if len(w) >= words else {tuple(w)} if w else set()
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def corpus(rnd):
    base = [[f"W{rnd.randint(0, 60)}é" for _ in range(rnd.randint(1, 60))] for _ in range(25)]
    docs = []
    for i in range(260):
        words = list(rnd.choice(base))
        for _ in range(rnd.choice((0, 0, 1, 1, 2, 4))):
            words[rnd.randrange(len(words))] = f"x{rnd.randint(0, 5)}"
        docs.append((i * 3 + 1, rnd.choice((" ", "\n", "\t")).join(words).swapcase() if i % 5 == 0 else " ".join(words)))
    return docs + [(2000, None), (2001, ""), (2002, " \n"), (2003, "one"), (2004, "ONE "), (2005, "one two"), (2006, "two one"), (2007, "y " * 3000)]


@pytest.mark.parametrize("words, percent", [(3, 90), (5, 80), (2, 50)])
def test_components_against_brute_force(spark, words, percent):
    docs = corpus(random.Random(words))
    df = spark.createDataFrame([(i, t, 0, "g") for i, t in docs], "doc_id long, text string, n int, gram string")
    got = components(spark, df, words, percent)
    assert got.columns == ["doc_id", "n_shingles", "component_id"]
    expected = brute(docs, words, percent)
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == expected
    assert len({c for _, c in expected.values()}) < len(docs) - 50


def test_repeats_nulls_and_empty_table(spark):
    rows = [(1, "a b c d"), (1, "a b c d"), (None, "a b c d"), (None, None), (7, "q r s t"), (7, "q r s u"), (9, "q r s t")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r.doc_id or 0, r.n_shingles, r.component_id or 0) for r in components(spark, df).collect())
    assert got == [(0, 0, 0), (0, 2, 1), (1, 2, 1), (1, 2, 1), (7, 2, 7), (7, 2, 7), (9, 2, 7)]
    assert components(spark, df.limit(0)).count() == 0


def test_grams_are_words_in_sequence():
    assert len(gram_set("a b c a b c", 3)) == 3
    assert gram_set("A\tb  c", 3).tolist() == gram_set("a b\x0cc", 3).tolist() != gram_set("a bc", 3).tolist()
    assert gram_set("É b c", 3).tolist() != gram_set("é b c", 3).tolist()
    assert gram_set("a b", 3).tolist() != gram_set("a b", 2).tolist()


def test_very_long_texts(spark):
    long = " ".join(f"w{k * 7919 % 100_003}" for k in range(100_000))
    docs = spark.createDataFrame([(5, long), (6, long + " one more"), (7, long[: len(long) // 2]), (8, "w1 w2 w3")], "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in components(spark, docs).collect()}
    assert got == {5: (99_998, 5), 6: (100_000, 5), 7: (got[7][0], 7), 8: (1, 8)}
