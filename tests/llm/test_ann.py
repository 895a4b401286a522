import numpy as np

from veilgrid.llm.ann import DEGREE, SHARD, SHARD_BYTES, _beam, _lifted, _prune, build_graph, every_nth, nearest, shard_size


def brute(rows, k, every):
    fine = {i: np.array(v, float) for i, v in rows if v and all(x is not None and np.isfinite(x) for x in v) and any(v)}
    out = {}
    for q in (i for i in fine if i % every == 0):
        near = sorted((-float(fine[q] @ v), i) for i, v in fine.items() if i != q and len(v) == len(fine[q]))
        out[q] = near[:k]
    return out


def check(spark, rows, k, every, shard):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<float>, rank int")
    rows = [(r.vec_id, r.embedding) for r in df.collect()]  # as floats
    wanted = brute(rows, k, every)
    got = {}
    for r in nearest(spark, df, every_nth(df, n=every), k, shard=shard).collect():
        got.setdefault(r.query_id, []).append((r.rank, r.vec_id, r.score))
    hit = total = 0
    assert set(got) == {q for q, near in wanted.items() if near}
    for q, near in wanted.items():
        mine = sorted(got.get(q, []))
        assert [r for r, _, _ in mine] == list(range(1, len(near) + 1))
        assert [(-s, i) for _, i, s in mine] == sorted((-s, i) for _, i, s in mine)
        hit += len({i for _, i, _ in mine} & {i for _, i in near})
        total += len(near)
    return hit / total


def test_recall_against_brute_force(spark):
    rnd = np.random.default_rng(12)
    centres = rnd.normal(size=(8, 24))
    x = centres[rnd.integers(0, 8, 1500)] + 0.7 * rnd.normal(size=(1500, 24))
    x *= rnd.uniform(0.2, 3, size=(1500, 1))
    assert check(spark, [(i, v.tolist()) for i, v in enumerate(x)], 20, 20, 400) >= 0.95


def test_copies_ties_and_odd_vectors(spark):
    rows = [(i, [1.0, 0.0]) for i in range(200)] + [(300 + i, [0.5, 0.1 * i]) for i in range(30)]
    rows += [(400, None), (420, []), (440, [0.0, 0.0]), (460, [float("nan"), 1.0]), (480, [None, 1.0]), (500, [float("inf"), 1.0]), (520, [1.0, 2.0, 3.0])]
    assert check(spark, rows, 20, 20, 1000) == 1.0
    assert check(spark, rows[:3], 20, 1, 1000) == 1.0
    df = spark.createDataFrame([], "vec_id long, embedding array<float>")
    assert nearest(spark, df, every_nth(df)).count() == 0


def test_pruning_keeps_the_nearest_and_drops_what_it_hides():
    points = np.array([[0, 0], [1, 0], [1.1, 0], [0, 2.0]], np.float32)
    ids = np.array([[1, 2, 3]])
    near = np.array([[1.0, 1.21, 4.0]], np.float32)
    assert _prune(points, np.array([0]), ids, near, 3, 1.2).tolist() == [[1, 3, -1]]


def test_beam_on_a_small_graph_finds_everything():
    points = _lifted(np.random.default_rng(13).normal(size=(60, 5)))
    edges, entry = build_graph(points)
    ids, near = _beam(points, edges, entry, points[:4], 60)
    assert [sorted(x) for x in ids.tolist()] == [list(range(60))] * 4
    assert (np.diff(near, axis=1) >= 0).all() and ids[:, 0].tolist() == [0, 1, 2, 3]


def test_shards_grow_slower_than_the_table():
    sizes = [shard_size(n, 64) for n in (100, 10**4, 10**5, 10**6, 10**12)]
    assert sizes[:2] == [SHARD, SHARD] and sizes == sorted(sizes)
    assert all(10 * n / shard_size(10 * n, 64) < 5 * n / shard_size(n, 64) for n in (10**5, 10**6))
    assert all(shard_size(10**12, d) * (20 * d + 8 * DEGREE) <= SHARD_BYTES for d in (2, 64, 1024, 4096))


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    rows = [(20, [1.0, 0.0]), (20, [1.0, 0.0]), (40, [0.0, 1.0]), (None, [1.0, 1.0]), (7, [0.6, 0.8]), (7, [0.6, 0.8]), (8, [0.6, 0.8])]
    df = spark.createDataFrame([(i, v, "x", "y", 1, 2.0, [1]) for i, v in rows], "vec_id long, embedding array<float>, shard string, size string, id int, score double, ids array<int>")
    found = [(r.query_id, r.rank, r.vec_id, round(r.score, 6)) for r in nearest(spark, df, every_nth(df)).orderBy("query_id", "rank").collect()]
    assert found == [(20, 1, 7, 0.6), (20, 2, 8, 0.6), (20, 3, 40, 0.0), (40, 1, 7, 0.8), (40, 2, 8, 0.8), (40, 3, 20, 0.0)]
