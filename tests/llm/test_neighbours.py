import numpy as np

from docloom.llm import neighbours as N


def brute(ids, x, queries, k):
    out = set()
    for q in queries:
        s = x @ x[ids.tolist().index(q)]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:k]
        out |= {(q, r, int(ids[i])) for r, i in enumerate(order, 1)}
    return out


def rows(spark, ids, x):
    return spark.createDataFrame([(int(i), [float(np.float32(c)) for c in v], "clash") for i, v in zip(ids, x)], "vec_id long, embedding array<float>, score string").repartition(4)


def test_recall(spark):
    rng = np.random.default_rng(3)
    ids = rng.permutation(3000)
    x = (rng.standard_normal((3000, 48)) * rng.uniform(0.2, 3, (3000, 1))).astype(np.float32).astype(float)
    x[5] = x[6]
    got = N.nearest(rows(spark, ids, x)).toPandas()
    queries = [q for q in ids.tolist() if q % 20 == 0]
    assert len(got) == 20 * len(queries)
    want = brute(ids, x, queries, 20)
    found = {(q, v) for q, _, v in want} & set(zip(got.query_id, got.vec_id))
    assert len(found) >= 0.98 * len(want)
    at = {int(i): k for k, i in enumerate(ids)}
    exact = [x[at[v]] @ x[at[q]] for q, v in zip(got.query_id, got.vec_id)]
    assert np.allclose(got.score, exact, rtol=0, atol=1e-12)
    for _, g in got.groupby("query_id"):
        g = g.sort_values("rank")
        assert list(g["rank"]) == list(range(1, 21)) and (np.diff(g.score) <= 0).all()


def test_blocks_of_queries(spark):
    rng = np.random.default_rng(4)
    ids, x = np.arange(400), rng.standard_normal((400, 16)).astype(np.float32).astype(float)
    got = N.nearest(rows(spark, ids, x), block=5, k=5, epsilon=8).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == brute(ids, x, range(0, 400, 20), 5)


def test_bounds_hold():
    rng = np.random.default_rng(6)
    x, q = rng.standard_normal((4000, 64)), rng.standard_normal((10, 64))
    turn = N.rotation(64)
    value, apart = N.estimates((q @ turn).astype(np.float32), *N.encode(x, turn), 3.0)
    outside = np.abs(value - q @ x.T) > apart * np.linalg.norm(q, axis=1)[:, None]
    assert outside.mean() < 0.003 and np.allclose(turn @ turn.T, np.eye(64))


def test_cells_prune_clusters():
    """Clustered vectors: most cells are ruled out by the triangle bound, and
    most rows of those that are met by their codes; nothing is missed."""
    rng = np.random.default_rng(7)
    middle = rng.standard_normal((40, 32))
    x = (middle[rng.integers(0, 40, 6000)] + 0.05 * rng.standard_normal((6000, 32))).astype(np.float32).astype(float)
    ids, turn = np.arange(6000), N.rotation(32)
    q = N.Queries(ids[::50], x[::50], turn, N.centres(x[:3000]), N.first_floor(ids[::50], x[::50], ids[:3000], x[:3000], 20))
    met = [0, 0, 0]
    i, v, s = q.best(ids, x, q.floor.copy(), 20, 3.0, met)
    assert met[0] == 120 * 6000 and met[1] < 0.3 * met[0] and met[2] < 0.1 * met[0]
    got = {(int(q.ids[a]), int(b)) for a, b, c in zip(i, v, s)}
    want = brute(ids, x, ids[::50].tolist(), 20)
    assert len({(a, b) for a, _, b in want} & got) >= 0.99 * len(want)


def test_sql(spark):
    """Scores, ranks and ties as SQL has them, to the last bit."""
    import duckdb

    rng = np.random.default_rng(8)
    x = rng.integers(-2, 3, (300, 8)).astype(float)
    vectors = rows(spark, np.arange(300), x)
    duckdb_rows = [(int(i), list(map(float, v))) for i, v in enumerate(x)]
    c = duckdb.connect()
    c.sql("CREATE TABLE embeddings (vec_id BIGINT, embedding FLOAT[])")
    c.executemany("INSERT INTO embeddings VALUES (?, ?)", duckdb_rows)
    want = c.sql(f"SELECT query_id, rank, vec_id, score FROM ({N.ORACLE})").fetchall()
    assert sorted(map(tuple, N.nearest(vectors, epsilon=8).collect())) == sorted(want)


def test_long_vectors_and_many_copies(spark):
    """512 components; a third of the rows are one vector."""
    rng = np.random.default_rng(9)
    x = rng.standard_normal((90, 512)).astype(np.float32).astype(float)
    x[30:60] = x[30]
    got = N.nearest(rows(spark, np.arange(90), x), k=5, epsilon=8, seed=1).collect()
    assert {(r.query_id, r.rank, r.vec_id) for r in got} == brute(np.arange(90), x, range(0, 90, 20), 5)


def test_unusable_vectors(spark):
    bad = [(20, None), (40, [0.0, 0.0]), (60, [1.0, None]), (80, [1.0, float("nan")]), (100, [float("inf"), 1.0]), (120, [1.0]), (None, [1.0, 1.0])]
    good = [(0, [1.0, 0.0]), (1, [1.0, 0.0]), (2, [1.0, 0.0]), (3, [-1.0, 2.0]), (0, [1.0, 0.0])]
    df = spark.createDataFrame(bad + good, "vec_id long, embedding array<float>")
    got = sorted((r.query_id, r.rank, r.vec_id, r.score) for r in N.nearest(df).collect())
    assert got == [(0, 1, 1, 1.0), (0, 2, 2, 1.0), (0, 3, 3, -1.0)]
    assert N.nearest(df.filter("false")).count() == 0 and N.nearest(df.filter("vec_id = 3")).count() == 0
