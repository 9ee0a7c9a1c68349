import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from docloom.llm import suffix_array as S


def brute(texts, span):
    raw = [(t or "").encode() for t in texts]
    count = Counter(b[i : i + span] for b in raw for i in range(len(b) - span + 1))
    out = []
    for b in raw:
        gone = bytearray(len(b))
        for i in range(len(b) - span + 1):
            if count[b[i : i + span]] > 1:
                gone[i : i + span] = b"\1" * span
        keep = bytes(c for c, g in zip(b, gone) if not g)
        out.append((len(b), sum(gone), (b"\0" + bytes(gone)).count(b"\0\1"), hashlib.sha256(keep).hexdigest()))
    return out


def collection(seed):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdeé") for _ in range(rng.randint(1, 6)))
    text = lambda n: " ".join(word() for _ in range(n))
    shared = [text(60) for _ in range(4)]
    texts = []
    for _ in range(40):
        t = text(rng.randint(0, 120))
        for s in rng.sample(shared, rng.randint(0, 2)):
            cut = rng.randint(0, len(s) // 2)
            t = t[: len(t) // 2] + s[cut : cut + rng.randint(100, 400)] + t[len(t) // 2 :]
        texts.append(t)
    return texts + [texts[0], "ab" * 400, "x" * 199, "y" * 200, "y" * 201, "z" * 300, texts[5] + "!" + texts[5]]


@pytest.mark.parametrize("limit,hot", [(1 << 25, 1 << 16), (0, 1 << 16), (1 << 25, 2), (0, 2)])
def test_against_all_strings(docs, awkward, limit, hot):
    """Broadcast and shuffled anchors; positional transform and digests."""
    rows = awkward + [(100 + i, t) for i, t in enumerate(collection(3))]
    got = S.digest(S.without_repeats(docs(rows).repartition(3), limit=limit, hot=hot)).collect()
    have = sorted((str(r.doc_id), r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got)
    assert have == sorted((str(r[0]), *b) for r, b in zip(rows, brute([r[1] for r in rows], 200)))


def test_positional_transform():
    rng = np.random.default_rng(0)
    groups = np.sort(rng.integers(0, 6, 60))
    columns = rng.integers(0, 2, (30, 60)).astype(np.uint8)
    columns[:, 10:20] = columns[:, 30:40]
    got = S.repeated_windows(groups, columns, 8)
    for c in range(23):
        keys = [(g, columns[c : c + 8, i].tobytes()) for i, g in enumerate(groups)]
        n = Counter(keys)
        assert got[c].tolist() == [n[k] > 1 for k in keys]


def test_texts_and_empty(docs):
    t = "".join(chr(97 + i * 7 % 26) for i in range(300))
    found = S.without_repeats(docs([(1, "head " + t), (2, t + " tail"), (3, "alone")]))
    assert {r.doc_id: r.text for r in S.cleaned(found).collect()} == {1: "head ", 2: " tail", 3: "alone"}
    assert S.digest(S.without_repeats(docs([]))).count() == 0
