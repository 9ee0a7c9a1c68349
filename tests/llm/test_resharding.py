import itertools
import zlib

import pytest

from docloom.llm import resharding as S
from docloom.llm.common import written


def test_flow_is_cheapest():
    supply, demand, cost = [3, 2], [1, 2, 2], [[4, 1, 3], [2, 5, 1]]
    flow = S.min_cost_flow(supply, demand, cost)
    assert [sum(r) for r in flow] == supply and [sum(c) for c in zip(*flow)] == demand
    best = min(
        sum(f * c for f, c in zip(x, sum(cost, [])))
        for x in itertools.product(range(4), repeat=6)
        if [sum(x[:3]), sum(x[3:])] == supply and [x[0] + x[3], x[1] + x[4], x[2] + x[5]] == demand
    )
    assert sum(flow[i][j] * cost[i][j] for i in range(2) for j in range(3)) == best
    with pytest.raises(ValueError):
        S.min_cost_flow([1], [2], [[0]])


def test_staying_is_preferred():
    plan = S.blocks([10, 0, 2], [4, 4, 4])
    assert (0, 0, 0) in plan and [p for p in plan if p[0] == 2] == [(2, 0, 2)]
    assert S.split_evenly(10, [0, 20, 4]) == [7, 0, 3] and S.split_evenly(3, [5, 5, 5]) == [1, 1, 1]


@pytest.fixture
def place(tmp_path):
    """Rows written as a table, located and placed."""

    def run(df, shards=16, files=3):
        path = str(tmp_path / f"table{len(list(tmp_path.iterdir()))}")
        df.repartition(files).write.parquet(path)
        table = df.sparkSession.read.parquet(path)
        return table, S.resharded(table, shards)

    return run


def test_documents(docs, awkward, place, tmp_path):
    """Null and empty texts, copies, repeated rows, a very long text, and
    columns that clash; then the files."""
    rows = awkward + [(100 + i, "x" * (i * 7 % 90) + str(i)) for i in range(3000)]
    table, placed = place(docs(rows))
    placed = written(placed, "placed")
    got = placed.toPandas()
    assert sorted(got.text_crc32) == sorted(zlib.crc32((r[1] or "").encode()) for r in rows)
    assert sorted(got["size"]) == sorted(len((r[1] or "").encode()) + 1 for r in rows)
    for _, s in got.groupby("shard"):
        assert sorted(s.slot) == list(range(len(s)))
    assert (got.groupby(["size", "text_crc32"]).shard.nunique() == 1).all()
    fair = got.groupby("shard")["size"].sum().drop(got.shard[got["size"].idxmax()])
    assert len(fair) == 15 and fair.max() - fair.min() <= 1500
    out = str(tmp_path / "out")
    dirty = S.rewrite_affected(table, placed, out)
    files = table.sparkSession.read.parquet(out)
    assert {r.docloom_shard for r in files.select("docloom_shard").distinct().collect()} == set(dirty)
    have = sorted((zlib.crc32((r.text or "").encode()), r.shard, r.docloom_shard, r.docloom_slot) for r in files.collect())
    assert have == sorted((r.text_crc32, "clash", r.shard, r.slot) for r in got.itertuples() if r.shard in dirty)


def test_few_and_none(docs, place):
    assert place(docs([]))[1].count() == 0
    assert place(docs([(1, "a"), (2, None)]))[1].count() == 2


def test_a_group_above_a_share_is_split(docs, place):
    """A third of all rows are one text; no shard gets more than its share."""
    rows = [(i if i % 2 else None, "same words") for i in range(2000)] + [(5000 + i, f"own words {i}") for i in range(4000)]
    got = place(docs(rows))[1].toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(size) == 16 and size.max() - size.min() <= 0.02 * size.mean()
    assert sorted(got.slot[got["shard"] == 3]) == list(range((got["shard"] == 3).sum()))


def test_moves_the_fewest_bytes(spark):
    rows = spark.createDataFrame([(i, 10, i % 4) for i in range(4000)] + [(9000 + i, 10, 0) for i in range(800)], "doc_id long, size long, old int")
    got = S.reshard(written(rows, "rows"), ["doc_id"], shards=4).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert size.max() - size.min() <= 20
    moved = got[got.old != got.shard]["size"].sum()
    assert abs(moved - 6000) <= 60 and (got[got.old != got.shard].old == 0).all()


def test_blocks_of_a_single_file(docs, place):
    """One file counts as consecutive blocks; a balanced table hardly moves,
    but copies move to the block that holds most of them."""
    rows = [(i, f"text number {i:05d}") for i in range(1600)]
    table, placed = place(docs(rows).coalesce(1), files=1)
    got = placed.toPandas()
    assert sorted(got.old.unique()) == list(range(16)) and (got.old != got.shard).mean() < 0.05


def test_only_changed_shards_are_affected(spark):
    placed = spark.createDataFrame([(0, 0), (0, 1), (1, 1), (2, 2), (2, 2), (3, 3)], "old int, shard int")
    assert S.affected(placed) == [0, 1]
