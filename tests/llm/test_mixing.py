import re

import numpy as np
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import mixing as X


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 60), st.integers(1, 9), min_size=1, max_size=12), st.floats(0, 1))
def test_budget(hist, share):
    size, n = np.array(list(hist)), np.array(list(hist.values()))
    budget = round(share * (size * n).sum())
    got = X.fit_budget(size, n, budget)
    assert ((got >= 0) & (got <= n)).all()
    reach = {0}
    for s, c in hist.items():
        reach = {r + s * k for r in reach for k in range(c + 1)}
    assert abs(int((size * got).sum()) - budget) == min(abs(r - budget) for r in reach)


def test_budget_with_a_common_divisor_and_one_odd_size():
    fit = lambda sizes, counts, budget: int(np.dot(sizes, X.fit_budget(np.array(sizes), np.array(counts), budget)))
    assert fit([2, 1_000_001], [10**9, 1], 10**9 + 1) == 10**9 + 1
    assert fit([1000, 1001], [10**6, 1], 500_300) == 500_001
    assert fit([30, 42], [5, 5], 100) == 102
    assert fit(list(range(50, 3000)), [2] * 2950, 1_234_567) == 1_234_567


def test_large_documents_overshoot_if_that_is_nearer():
    fit = lambda sizes, counts, budget: X.fit_budget(np.array(sizes), np.array(counts), budget).tolist()
    assert fit([200_000], [1], 180_000) == [1] and fit([200_000], [1], 90_000) == [0]
    assert fit([300_000, 200_000], [1, 1], 150_000) == [0, 1]


def waterfill(sizes, weights, total):
    target, open_ = {}, set(sizes)
    while open_:
        level = (total - sum(target.values())) / sum(weights[s] for s in open_)
        full = {s for s in open_ if weights[s] * level >= 2 * sizes[s]}
        if not full:
            return target | {s: weights[s] * level for s in open_}
        for s in full:
            target[s] = 2 * sizes[s]
        open_ -= full
    return target


def test_documents(docs, awkward):
    sources = ["b", "a", None, "c", "é", ""]
    rows = [(d, t, "en", sources[i % 6]) for i, (d, t, *_) in enumerate(awkward * 3)]
    rows += [(100 + i, "w " * (i % 50 + 1), "en", "a") for i in range(300)]
    got = X.mix(docs(rows)).toPandas()
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))
    assert sorted(got["size"]) == sorted(words(r[1]) for r in rows)
    total = {}
    for r in rows:
        total[r[3]] = total.get(r[3], 0) + words(r[1])
    order = sorted((s for s in total if s is not None), key=lambda s: s.encode()) + [None]
    weights = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}
    want = waterfill(total, weights, 1.5 * sum(total.values()))
    # words taken by (source_size, target)
    have = got.groupby(["source_size", "target"]).taken.sum()
    for s in total:
        taken = have[total[s]]
        t = taken.index[np.argmin(abs(taken.index - want[s]))]
        assert abs(t - want[s]) < 1e-6 * max(1, want[s])
    assert (got.taken <= 2 * got["size"]).all() and (got.taken % got["size"].where(got["size"] > 0, 1) == 0).all()
    for (w, t), taken in have.items():
        alike = sum(total[s] == w and abs(want[s] - t) < 1e-6 * max(1, t) for s in total)
        assert abs(taken - t * alike) <= max(got["size"].max() if w > 20000 else 60, 0.002 * t)
    again = X.mix(docs(rows).repartition(3)).toPandas()
    cols = ["doc_id", "size", "source_size", "taken"]
    assert sorted(map(str, got[cols].fillna(-1).astype(int).values.tolist())) == sorted(map(str, again[cols].fillna(-1).astype(int).values.tolist()))


def test_rows_follow_the_mix(docs):
    rows = [(i, "w " * (i % 9 + 1), "en", "ab"[i % 2]) for i in range(60)]
    d = docs(rows)
    out = X.mixed_documents(d)
    assert out.columns == d.columns
    took = {r["doc_id"]: r["taken"] // r["size"] for r in X.mix(d).collect()}
    got = {}
    for r in out.collect():
        got[r["doc_id"]] = got.get(r["doc_id"], 0) + 1
    assert got == {k: v for k, v in took.items() if v}


def test_rows_without_a_name(docs):
    """Null and repeated ids in bulk are told apart by their texts, and equal
    rows by number."""
    rows = [(None, "w " * (i % 9 + 1), "en", "a") for i in range(90)] + [(7, "v " * (i % 3 + 1), "en", "a") for i in range(30)] + [(8, "u v", "en", "b")] * 11
    d = docs(rows)
    took = X.mix(d).toPandas()
    out = X.mixed_documents(d).collect()
    assert sum(len(r.text.split()) for r in out) == took.taken.sum() and set(took.taken // took["size"]) <= {0, 1, 2}
    for source in "ab":
        target = sum(len(r[1].split()) for r in rows if r[3] == source)
        assert sum(len(r.text.split()) for r in out if r.source == source) <= 2 * target
    counts = [sum(r.text == t and r.doc_id == i for r in out) for i, t in {(r[0], r[1]) for r in rows}]
    assert all(c >= 0 for c in counts) and len(out) == sum(counts)


def test_empty(docs):
    assert X.mix(docs([])).count() == 0
    assert X.mix(docs([(1, None), (2, "")])).toPandas().taken.tolist() == [0, 0]
