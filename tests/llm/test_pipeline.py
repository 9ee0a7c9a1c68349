"""The corpus pipeline, stage by stage, against plain Python."""

import re
import zlib

import numpy as np
import pytest

import corpus_pipeline as C
from docloom.llm import packing as K
from docloom.llm import privacy as V
from docloom.llm import quality as Q
from docloom.llm import simhash as H
from docloom.llm.common import written


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.001"
    docs, out = spark.read.parquet(f"{sf}/documents.parquet"), []
    out.append(docs.toPandas())
    for name, f in C.STAGES:
        docs = written(f(spark, docs, sf), "test")
        out.append(docs.toPandas())
    return out


def test_columns(stages):
    for s in stages[1:-1]:
        assert list(s.columns) == list(stages[0].columns)
    assert [n for n, _ in C.STAGES] == ["quality classifier", "SimHash near-dedup", "PII", "mixing to target weights", "best-fit packing"]


def test_quality(spark, stages):
    sf = "/root/testdata/sf0.001"
    scores = Q.classify(spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")).toPandas()
    assert set(stages[1].doc_id) == set(scores[scores.predicted == 1].doc_id) and 0 < len(stages[1]) < len(stages[0])


def test_near_duplicates(stages):
    before = stages[1]
    fp = np.array([H.fingerprint(t.encode()) for t in before.text], np.int64).view(np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None]) <= 3
    label = before.doc_id.to_numpy()
    while True:
        new = np.array([label[r].min() for r in near])
        if (new == label).all():
            break
        label = new
    assert sorted(stages[2].doc_id) == sorted(set(label.tolist())) and len(stages[2]) < len(before)


def test_privacy(stages):
    before, after = (s.set_index("doc_id") for s in stages[2:4])
    assert set(before.index) == set(after.index)
    for i, t in before.text.items():
        if not any(V.base_spans(t)):
            assert after.text[i] == t
        else:
            assert not any(V.base_spans(after.text[i])) and re.search(r"\[(EMAIL|IP|CARD|PHONE)\]", after.text[i])
    assert (after.n_chars == after.text.str.len()).all()


def test_mixing(stages):
    before, after = stages[3], stages[4]
    times = after.groupby("doc_id").size()
    assert set(times.index) <= set(before.doc_id) and times.max() <= 2
    words = before.set_index("doc_id").text.map(lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t)))
    assert abs((words[times.index] * times).sum() - 1.5 * words.sum()) <= 0.01 * words.sum()


def test_packing(stages):
    before, after = stages[4], stages[5]
    encode = K.encoder(K.vocabulary("byte_bpe_50k.json"))
    want = []
    for i, t in zip(before.doc_id, before.text):
        ids = np.array([*encode(t), 0], "<u4")
        want += [(i, k, a, n, zlib.crc32(ids[a : a + n].tobytes())) for k, (a, n) in enumerate(K.cut(len(ids), 2048))]
    assert sorted(after[["doc_id", "piece", "start", "length", "ids_crc32"]].itertuples(index=False, name=None)) == sorted(want)
    assert after.groupby("sequence_id").length.sum().max() <= 2048


def test_run(spark, stages):
    assert C.run(spark, "/root/testdata/sf0.001").count() == len(stages[5])


def test_stages_take_awkward_rows(spark, docs, awkward, tmp_path):
    """Nulls, empties, repeated rows, clashing columns: no stage fails, and all
    but the last keep the columns."""
    spark.createDataFrame([(4, 1), (6, 0)], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    for rows in (awkward, []):
        d = docs(rows)
        for name, f in C.STAGES[:-1]:
            assert f(spark, d, str(tmp_path)).columns == d.columns, name
            written(f(spark, d, str(tmp_path)), "stage").count()
        C.STAGES[-1][1](spark, d, str(tmp_path)).count()
