import random

from veilgrid.llm.line_dedup import dedup_lines


def brute(docs, least):
    """docs: (id, text) in order; the deleted (id, line) pairs by the operator's definition."""
    lines = {i: [(k, x, len(x.split())) for k, x in enumerate(t.split("\n")) if x.split()] for i, t in docs if t is not None}
    first, windows = {}, []
    for i in sorted(lines):
        for p in range(len(lines[i])):
            total, q = 0, p
            while q < len(lines[i]) and total < least:
                total += lines[i][q][2]
                q += 1
            if total >= least:
                content = tuple(x for _, x, _ in lines[i][p:q])
                windows.append((content, i, p))
                first.setdefault(content, (i, p))
    gone = set()
    for content, i, p in windows:
        a, q = first[content]
        if (a, q) == (i, p):
            continue
        run, shift = [], p - q
        for k, (line, x, n) in enumerate(lines[i]):
            if 0 <= k - shift < len(lines[a]) and lines[a][k - shift][1] == x:
                run.append((line, n))
                continue
            gone |= {(i, line) for line, _ in run} if sum(n for _, n in run) >= least else set()
            run = []
        gone |= {(i, line) for line, _ in run} if sum(n for _, n in run) >= least else set()
    return gone


def expected(docs, gone):
    return {i: None if t is None else "\n".join(x for k, x in enumerate(t.split("\n")) if (i, k) not in gone) for i, t in docs}


def test_against_brute_force(spark):
    rnd = random.Random(11)
    lines = [" ".join(f"w{rnd.randint(0, 9)}" for _ in range(rnd.randint(1, 6))) for _ in range(12)] + ["", "  ", "\t"]
    docs = [(i, "\n".join(rnd.choice(lines) for _ in range(rnd.randint(0, 14)))) for i in range(150)] + [(200, None), (201, ""), (202, "a b c d e f g\n" * 40)]
    df = spark.createDataFrame([(i, t, "x", 1) for i, t in docs], "doc_id long, text string, line string, pos int")
    made = dedup_lines(spark, df, min_words=7)
    assert made.columns == ["doc_id", "text", "line", "pos", "n_lines_removed", "n_words_removed"]
    gone = brute(docs, 7)
    assert len(gone) > 100
    got = {r.doc_id: (r.text, r.n_lines_removed) for r in made.collect()}
    assert {i: t for i, (t, _) in got.items()} == expected(docs, gone)
    assert sum(n for _, n in got.values()) == len(gone)


def test_repeated_ids_and_empty_table(spark):
    text = "one two three four five six seven\nlast"
    df = spark.createDataFrame([(1, text), (1, text), (None, text), (None, None), (2, "last\n" + text)], "doc_id long, text string")
    rows = sorted(((r.doc_id is not None, r.doc_id or 0, r.text or ""), r.n_lines_removed) for r in dedup_lines(spark, df, min_words=7).collect())
    # the null id sorts first and keeps the passage; everything later loses it
    assert rows == [((False, 0, ""), 0), ((False, 0, text), 0), ((True, 1, ""), 2), ((True, 1, ""), 2), ((True, 2, "last"), 2)]
    assert dedup_lines(spark, df.limit(0)).count() == 0


def test_very_long_text(spark):
    long = "\n".join(f"line {k} of a very long text that goes on and on {k * 7}" for k in range(20_000))
    docs = spark.createDataFrame([(1, long), (2, long + "\nits own end"), (3, "before\n" + long[: len(long) // 2])], "doc_id long, text string")
    rows = {r.doc_id: r for r in dedup_lines(spark, docs).collect()}
    assert rows[1].text == long and rows[2].text == "its own end" and rows[2].n_lines_removed == 20_000
    assert rows[2].n_words_removed == 20_000 * 13
    assert rows[3].text.startswith("before") and len(rows[3].text) < 80
