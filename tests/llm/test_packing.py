import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import packing as K


def sequences(plan):
    bins = {}
    for length, first, many, seq, off in plan.tolist():
        for i in range(many):
            bins.setdefault(seq + i, []).append((off, length))
    return bins


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 40), st.integers(0, 30), max_size=20))
def test_plan_is_whole_and_gapless(counts):
    plan = K.plan_packing(counts, 40)
    for length, n in counts.items():
        spans = sorted((r[1], r[1] + r[2]) for r in plan.tolist() if r[0] == length)
        assert [s for a, b in spans for s in range(a, b)] == list(range(n))
    for slots in sequences(plan).values():
        at = 0
        for off, length in sorted(slots):
            assert off == at
            at += length
        assert at <= 40
    # all sequences but one are more than half full
    assert len(sequences(plan)) <= 2 * sum(k * n for k, n in counts.items()) / 40 + 1


def test_large_items_are_matched_optimally():
    # 2 x 27 pair with 2 x 13 only if the matching looks for the best partner
    assert len(sequences(K.plan_packing({27: 2, 13: 2, 20: 2, 14: 1, 26: 1}, 40))) == 4
    assert max(sum(3 * ln > 40 for _, ln in s) for s in sequences(K.plan_packing({14: 9, 15: 7, 38: 3}, 40)).values()) == 2


def test_cut():
    assert K.cut(5, 4) == [(0, 1), (1, 4)] and K.cut(8, 4) == [(0, 4), (4, 4)] and K.cut(3, 4) == [(0, 3)]


def test_both_files_give_the_same_ids():
    a, b = (K.encoder(K.vocabulary(f"byte_bpe_50k.{x}")) for x in ("json", "tiktoken"))
    for s in ["", " ", "a  b\n\n c", "été 日本語 😀​", "x<|endoftext|>y", "don't  ...\t1234", "\x00\x1f"]:
        assert a(s) == b(s)


def test_documents(docs, awkward):
    got = K.pack(docs(awkward)).toPandas()
    encode = K.encoder(K.vocabulary("byte_bpe_50k.json"))
    want = []
    for doc_id, text, *_ in awkward:
        ids = np.array([*encode(text or ""), 0], "<u4")
        for k, (start, length) in enumerate(K.cut(len(ids), 2048)):
            want.append((doc_id if doc_id is not None else -1, k, start, length, zlib.crc32(ids[start : start + length].tobytes())))
    have = sorted(got.fillna({"doc_id": -1})[["doc_id", "piece", "start", "length", "ids_crc32"]].astype(int).itertuples(index=False, name=None))
    assert have == sorted(want)
    for _, s in got.groupby("sequence_id"):
        s = s.sort_values("offset")
        assert (s.offset == s.length.cumsum() - s.length).all() and s.length.sum() <= 2048
    assert got.sequence_id.nunique() <= -(-got.length.sum() // 2048) + 1


def test_special_literal_is_its_token(docs):
    """Against the tokenizer file as it is."""
    from tokenizers import Tokenizer

    plain = Tokenizer.from_file(K.vocabulary("byte_bpe_50k.json"))
    rows = list(enumerate(["x<|endoftext|>y", "<|endoftext|>", "a <|endoftext|>  <|endoftext|>\n b<|endoftext|", "x y"]))
    got = {r.doc_id: (r.length, r.ids_crc32) for r in K.pack(docs(rows)).collect()}
    for i, t in rows:
        ids = [*plain.encode(t, add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))


def test_empty(docs):
    assert K.pack(docs([])).count() == 0


@pytest.mark.parametrize("seed", [1, 2])
def test_reruns_agree(docs, awkward, seed):
    d = docs(awkward)
    assert sorted(map(str, K.pack(d).collect())) == sorted(map(str, K.pack(d.repartition(seed)).collect()))


def test_rows_without_a_name(docs):
    """Null and repeated ids in bulk, many of them of one length."""
    rows = [(None, "same text here")] * 200 + [(None, f"text number {i}") for i in range(100)] + [(7, f"other {i % 5}") for i in range(100)]
    got = K.pack(docs(rows), capacity=16).toPandas()
    assert len(got) == 400
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.iloc[0] == 0 and (g.offset.iloc[1:].to_numpy() == (g.offset + g.length).iloc[:-1].to_numpy()).all() and g.length.sum() <= 16


def test_intermediate_tables_can_be_released(spark):
    import os

    from docloom.llm.common import made, release, written
    from docloom.sources.scratch import shared_folder

    root = shared_folder(spark).removeprefix("file://")
    df = written(spark.range(3), "kept")
    assert df.count() == 3 and any(n.startswith("kept-") for n in os.listdir(root))
    before = made()
    later, last = written(spark.range(2), "later"), written(spark.range(2), "last")
    assert later.count() == 2 and release(spark, before, keep=1) == 1 and last.count() == 2
    assert release(spark) >= 1 and not any(n.startswith(("kept-", "last-")) for n in os.listdir(root))
