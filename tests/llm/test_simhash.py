import numpy as np
import pytest
import xxhash

from docloom.llm import simhash as H
from docloom.llm.common import written


def brute_print(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum((2 * sum(v >> k & 1 for v in h) > len(h)) << k for k in range(64))


def brute(fps, ids):
    fps = np.array(fps, np.uint64)
    near = np.bitwise_count(fps[:, None] ^ fps[None]) <= 3
    big = 1 << 62
    label = np.array([i if i is not None else big for i in ids])
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            return near.sum(1) - 1, [x if x != big else None for x in label.tolist()]
        label = new


def test_documents(docs, awkward):
    rows = awkward + [(20, "THE Quick brown"), (21, "the quick BROWN"), (22, "É a b"), (23, "é a b")]
    got = H.near_duplicates(docs(rows)).collect()
    near, comp = brute([brute_print(r[1]) for r in rows], [r[0] for r in rows])
    want = sorted((str(r[0]), f"{brute_print(r[1]):016x}", int(n), str(c)) for r, n, c in zip(rows, near, comp))
    assert sorted((str(r.doc_id), r.fingerprint, r.n_near, str(r.component_id)) for r in got) == want


def chain(rng, n, flips):
    out = [int(rng.integers(0, 1 << 63))]
    for _ in range(n - 1):
        x = out[-1]
        for b in rng.choice(63, flips, False):
            x ^= 1 << int(b)
        out.append(x)
    return out


@pytest.mark.parametrize("big, deep", [(1 << 18, 1), (40, 2), (1 << 18, 3)])
def test_shards_and_trees(spark, big, deep):
    """Chains, a dense ball (one hot shard), many fingerprints of one half, and
    noise, against all pairs; with big = 40 the hot shards are split by vantage
    points of the other half."""
    rng = np.random.default_rng(5)
    centre = int(rng.integers(0, 1 << 63))
    ball = [centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.choice(47, (600, 2))]
    hot = [centre & 0xFFFFFFFF | int(x) << 32 for x in rng.integers(0, 1 << 31, 300)]
    fps = sorted({*chain(rng, 60, 3), *chain(rng, 40, 2), *ball, *hot, *rng.integers(0, 1 << 63, 500).tolist()})
    n = rng.integers(1, 4, len(fps))
    classes = written(spark.createDataFrame([(f, int(k)) for f, k in zip(fps, n)], "fp long, n long"), "classes")
    links = written(H.near_links(classes, big, deep), "links")
    x = np.array(fps, np.uint64)
    near = (np.bitwise_count(x[:, None] ^ x[None]) <= 3) & ~np.eye(len(x), dtype=bool)
    want = {f: int(c) for f, c in zip(fps, near @ n) if c}
    got = {r.x: r.s for r in links.filter("kind = 0").groupBy("x").agg({"y": "sum"}).withColumnRenamed("sum(y)", "s").collect()}
    assert got == want
    roots = {r.node: r.root for r in H.components(links.filter("kind = 1").select("x", "y")).collect()}
    _, comp = brute(fps, fps)
    assert {f: roots.get(f, f) for f in fps} == dict(zip(fps, comp))


def test_branches_are_pruned():
    """Of 20,000 random fingerprints in one shard by the first half, the tree
    compares less than a hundredth of the pairs, and finds those planted."""
    rng = np.random.default_rng(6)
    fp = np.unique(rng.integers(0, 1 << 63, 20000))
    mate = fp[:50] ^ np.int64(1 << 40) ^ np.int64(1 << 3)
    every = np.concatenate((fp, mate))
    rows = np.concatenate((every, every))
    kind = np.repeat([H.HOME, H.NEXT], len(every))
    out, x, y, links = H.shard_links(np.zeros(len(rows), np.int64), rows, np.ones(len(rows), np.int64), kind, np.zeros(len(rows), np.int64))
    assert links.met[0] > 4e8 and 0 < links.met[1] < links.met[0] / 100
    assert {int(f) for f, k in zip(x, out) if k == 0} >= {int(f) for f in mate}


def test_long_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)], "x long, y long").repartition(5)
    assert {r.root for r in H.components(edges).collect()} == {0}


def test_one_of_each_stays(docs, awkward):
    """Of every component the row of the least id; equal rows collapse, and
    rows without id or with one id twice go only if another row is kept."""
    rows = awkward + [(9, "one two"), (30, "one two"), (None, "alone here now"), (None, "alone here now"), (50, "first text of two"), (50, "second quite other words")]
    d = docs(rows)
    out = H.deduplicated(d)
    assert out.columns == d.columns
    got = [(r.doc_id, r.text) for r in out.collect()]
    near, comp = brute([brute_print(r[1]) for r in rows], list(range(len(rows))))
    want = {}
    for r, c in zip(rows, comp):
        want.setdefault(c, []).append(r)
    assert len(got) == len(want)
    assert sorted(str(i) for i, _ in got) == sorted(str(min((r[0] for r in rs if r[0] is not None), default=None)) for rs in want.values())
    assert (50, "first text of two") in got and (50, "second quite other words") in got


def test_empty(docs):
    assert H.near_duplicates(docs([])).count() == 0 and H.deduplicated(docs([])).count() == 0
