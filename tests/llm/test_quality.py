import zlib

import numpy as np
import pytest

from docloom.llm import quality as Q


def corpus(n=400):
    rng = np.random.default_rng(1)
    rows, marks = [], []
    for i in range(n):
        bad = i % 5 == 0
        w = ["".join(rng.choice(list("abcdefgh"), rng.integers(2, 9))) for _ in range(rng.integers(30, 90))]
        rows.append((i, " ".join(x.upper() + "!!" if bad else x for x in w)))
        marks.append((i, int(not bad)))
    return rows, marks


def test_held_out_accuracy(spark, docs):
    rows, marks = corpus()
    labels = spark.createDataFrame([*marks, (9999, 0), (3, None)], "doc_id long, quality int")
    got = {r.doc_id: r for r in Q.classify(docs([*rows, (700, None), (701, ""), (None, "x y"), (0, rows[0][1])]), labels).collect()}
    assert len(got) == 403
    for i, r in got.items():
        assert r.held_out == (i is not None and zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3)
    held = [(got[i].predicted, y) for i, y in marks if got[i].held_out]
    assert len(held) > 50 and sum(p == y for p, y in held) >= 0.97 * len(held)


def test_held_out_labels_have_no_influence(spark, docs):
    rows, marks = corpus(200)
    flip = [(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, y in marks]
    a, b = ({r.doc_id: r.score for r in Q.classify(docs(rows), spark.createDataFrame(m, "doc_id long, quality int")).collect()} for m in (marks, flip))
    assert a == pytest.approx(b, abs=1e-9)


def test_labels_of_one_kind_or_none(spark, docs):
    rows, _ = corpus(20)
    for marks, want in (([(i, 1) for i in range(20)], 1.0), ([], 0.5)):
        got = Q.classify(docs(rows), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
        assert {r.score for r in got} == {want}
    assert Q.classify(docs([]), spark.createDataFrame([], "doc_id long, quality int")).count() == 0


def test_accepted_rows(spark, docs):
    rows, marks = corpus()
    d = docs(rows)
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    out = Q.accepted(d, labels)
    assert out.columns == d.columns
    want = {r.doc_id for r in Q.classify(d, labels).collect() if r.predicted}
    assert {r.doc_id for r in out.collect()} == want


def test_isotonic():
    good, n = np.array([0, 2, 1, 0, 5.0]), np.array([4, 4, 4, 0, 5.0])
    k = Q.isotonic(good, n)
    assert (np.diff(k) >= 0).all() and k[1] == k[2] == pytest.approx(3 / 8) and k[0] == 0 and k[4] == 1


def test_features_approximate_a_kernel():
    m = Q.Model(features=4096, width=0.3)
    x = np.random.default_rng(0).standard_normal((5, Q.DIM))
    z = m.lift(x)[:, :4096]
    d = ((x[:, None] - x[None]) ** 2).sum(-1)
    assert np.abs(z @ z.T - np.exp(-d * 0.09 / 2)).max() < 0.08


def test_statistics_do_not_depend_on_the_slice():
    raw = [b"One two. one TWO!\nline\n", b"", "é#1 x".encode(), b"a b c a b c"]
    off = np.cumsum([0, *map(len, raw)])
    whole = Q.statistics(np.frombuffer(b"".join(raw), np.uint8), off)
    for i, t in enumerate(raw):
        assert np.allclose(whole[i], Q.statistics(np.frombuffer(t, np.uint8), np.array([0, len(t)]))[0])


def test_isotonic_is_the_least_squares_fit():
    """Against the max-min formula, on random bins."""
    rng = np.random.default_rng(3)
    for _ in range(50):
        n = rng.integers(1, 9, 12).astype(float)
        good = np.floor(rng.random(12) * (n + 1))
        mean = lambda a, b: good[a : b + 1].sum() / n[a : b + 1].sum()
        want = [max(min(mean(a, b) for b in range(i, 12)) for a in range(i + 1)) for i in range(12)]
        assert np.allclose(Q.isotonic(good, n), want)


def test_weights_solve_the_ridge(spark):
    """Partition sums and folds against one direct solve over all rows."""
    rng = np.random.default_rng(4)
    f = rng.standard_normal((500, Q.DIM)).astype(np.float32)
    y = (f[:, 0] + 0.3 * rng.standard_normal(500) > 0).astype(int)
    rows = spark.createDataFrame([(v.tolist(), int(t), i % Q.FOLDS) for i, (v, t) in enumerate(zip(f, y))], "f array<float>, y int, fold int").repartition(5)
    m = Q.fit(rows, features=32)
    z = m.lift(f.astype(float))
    direct = np.linalg.solve(z.T @ z + Q.RIDGE * 500 * np.eye(z.shape[1]) / z.shape[1], z.T @ y)
    assert np.allclose(m.weights, direct, atol=1e-6)
    assert ((m.score(f.astype(float)) >= 0.5) == y).mean() > 0.85


def test_a_bounded_sample_is_enough(spark, docs):
    rows, marks = corpus()
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    assert 40 <= Q.sampled_labels(labels, 80).count() <= 120
    got = {r.doc_id: r for r in Q.classify(docs(rows), labels, most=160).collect()}
    held = [(got[i].predicted, y) for i, y in marks if got[i].held_out]
    assert sum(p == y for p, y in held) >= 0.9 * len(held)


def test_one_very_long_text(spark, docs):
    rows, marks = corpus(60)
    long = " ".join(t for _, t in rows) * 200
    got = Q.classify(docs([*rows, (999, long)]), spark.createDataFrame(marks, "doc_id long, quality int")).collect()
    assert len(got) == 61 and all(0 <= r.score <= 1 for r in got)
