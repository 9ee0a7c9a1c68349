import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import automata as A


def brute(rows, window=13):
    docs = [(i if i is not None else A.LAST, (t or "").encode().split()) for i, t, *_ in rows]
    low = {}
    for i, w in docs:
        for s in range(len(w) - window + 1):
            k = tuple(w[s : s + window])
            low[k] = min(low.get(k, A.LAST), i)
    out = []
    for i, w in docs:
        gone = set()
        for s in range(len(w) - window + 1):
            if low[tuple(w[s : s + window])] < i:
                gone |= set(range(s, s + window))
        keep = b" ".join(x for k, x in enumerate(w) if k not in gone)
        out.append((len(w), len(gone), hashlib.sha256(keep).hexdigest()))
    return out


def collection(seed):
    rng = random.Random(seed)
    text = lambda n: [rng.choice(["the", "a", "of", "rä", "x", "yy", "zz.", "Q"]) + str(rng.randint(0, 9)) for _ in range(n)]
    shared = [text(30) for _ in range(5)]
    rows = []
    for i in range(60):
        w = text(rng.randint(0, 60))
        for s in rng.sample(shared, rng.randint(0, 2)):
            a = rng.randint(0, 12)
            w[len(w) // 2 : len(w) // 2] = s[a : a + rng.randint(8, 25)]
        rows.append((rng.randint(1000, 2000), (rng.choice([" ", "  ", "\n", "\t "])).join(w)))
    return rows + [(50, rows[3][1]), (3000, rows[3][1]), (3001, "go " * 40), (3002, "go " * 13), (None, rows[4][1])]


@pytest.mark.parametrize("limit,hot", [(1 << 25, 1 << 16), (0, 1 << 16), (1 << 25, 2), (0, 2)])
def test_against_all_windows(docs, awkward, limit, hot):
    rows = awkward + collection(1)
    got = A.digest(A.without_known(docs(rows).repartition(3), limit=limit, hot=hot)).collect()
    have = sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got)
    assert have == sorted((str(r[0]), *b) for r, b in zip(rows, brute(rows)))


def test_a_hot_anchor_within_one_text(docs):
    """A passage repeated thousands of times in one long text isn't gathered."""
    rows = [(1, "a b c d e f g h i j k l m n " * 30000), (2, "x y a b c d e f g h i j k l m n o p"), (3, "alone")]
    got = A.digest(A.without_known(docs(rows), hot=1000)).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256) for r in got) == sorted((str(r[0]), *b) for r, b in zip(rows, brute(rows)))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text("ab", max_size=12), min_size=1, max_size=6), st.text("abc", max_size=12), st.integers(1, 4))
def test_automaton(strings, query, window):
    sam = A.SuffixAutomaton()
    for i, s in enumerate(strings):
        sam.add(s, len(strings) - i)
    sam.finish()
    want = []
    for k in range(window - 1, len(query)):
        w = query[k - window + 1 : k + 1]
        want.append(min([len(strings) - i for i, s in enumerate(strings) if w in s], default=A.LAST))
    assert sam.firsts(query, window) == want


def test_texts_and_empty(docs):
    t = " ".join(f"w{i}" for i in range(20))
    found = A.without_known(docs([(1, t), (2, "b " + t + "  e"), (3, "alone")]))
    assert {r.doc_id: r.text for r in A.cleaned(found).collect()} == {1: t, 2: "b e", 3: "alone"}
    assert A.digest(A.without_known(docs([]))).count() == 0
