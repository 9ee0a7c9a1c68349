"""Minimum-cost-flow resharding.

From the sizes of the old shards and the capacities of the new ones a
transportation problem (a unit of flow is a byte; staying is free, moving costs
one) is solved on the driver: its size depends on the number of shards alone.
The flows become blocks: contiguous byte ranges of each old shard, in a seeded
order. What is placed are groups of equal texts, so that copies stay or come
together; a group of more than a shard's share is cut into parts. Groups above
``1/fine`` of a capacity are too coarse for blocks and are placed one by one;
there are at most ``shards * fine`` of them.

Law ``bytes``: the new shards' sizes are as near equal as the largest group
allows. Defined results: a null text has size 1 and the checksum of the empty
one, and is its copy; repeated rows and rows without ``doc_id`` are placed as
all others and come last in their shard; a document larger than a fair share,
however long, has a shard's room to itself; ties are broken by hashes of id,
text and place; extra columns are kept by :func:`rewrite_affected` and otherwise
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import digests, folder, rank_within, text_bytes, written

SHARDS = 16
FINE = 256
SEED = 6
#: Bytes of text to a file of a rewritten shard, about.
FILE_BYTES = 32 << 20


def min_cost_flow(supply: Sequence[int], demand: Sequence[int], cost: Sequence[Sequence[int]]) -> list[list[int]]:
    """The cheapest flows[i][j] that ship all of ``supply`` and fill all of
    ``demand`` (equal sums), by successive shortest paths with potentials."""
    n, m = len(supply), len(demand)
    if sum(supply) != sum(demand):
        raise ValueError("supply and demand differ")
    flow = [[0] * m for _ in range(n)]
    have, want = list(supply), list(demand)
    up = [0] * (n + m)
    while any(have):
        dist, back = [float("inf")] * (n + m), [-1] * (n + m)
        heap = []
        for i in range(n):
            if have[i]:
                dist[i] = 0
                heap.append((0, i))
        heapq.heapify(heap)
        while heap:
            d, u = heapq.heappop(heap)
            if d > dist[u]:
                continue
            edges = ((n + j, cost[u][j]) for j in range(m)) if u < n else ((i, -cost[i][u - n]) for i in range(n) if flow[i][u - n])
            for v, c in edges:
                e = d + c + up[u] - up[v]
                if e < dist[v]:
                    dist[v], back[v] = e, u
                    heapq.heappush(heap, (e, v))
        far = max(x for x in dist if x < float("inf"))
        up = [p + min(d, far) for p, d in zip(up, dist)]
        # every sink at the least true distance that still wants something
        j = min((j for j in range(m) if want[j] and dist[n + j] < float("inf")), key=lambda j: dist[n + j])
        path, v = [], n + j
        while back[v] >= 0:
            path.append((back[v], v))
            v = back[v]
        most = min([have[v], want[j], *(flow[b][a - n] for a, b in path if a >= n)])
        for a, b in path:
            if a < n:
                flow[a][b - n] += most
            else:
                flow[b][a - n] -= most
        have[v] -= most
        want[j] -= most
    return flow


def split_evenly(total: int, taken: Sequence[int]) -> list[int]:
    """Room for ``total`` more on top of what is ``taken``, so that the sums
    are as equal as they can be."""
    order = sorted(range(len(taken)), key=lambda j: (taken[j], j))
    for k in range(len(order), 0, -1):
        level, extra = divmod(total + sum(taken[j] for j in order[:k]), k)
        if level >= taken[order[k - 1]]:
            room = [0] * len(taken)
            for i, j in enumerate(order[:k]):
                room[j] = level - taken[j] + (i < extra)
            return room
    return [0] * len(taken)


def blocks(old_sizes: Sequence[int], room: Sequence[int]) -> list[tuple[int, int, int]]:
    """(old shard, first byte, new shard) of every block, the one that stays
    first."""
    n, m = len(old_sizes), len(room)
    flow = min_cost_flow(old_sizes, room, [[int(i != j) for j in range(m)] for i in range(n)])
    out = []
    for i in range(n):
        at = 0
        for j in sorted(range(m), key=lambda j: (j != i, j)):
            if flow[i][j]:
                out.append((i, at, j))
                at += flow[i][j]
    return out


def reshard(items: DataFrame, ids: Sequence[str], shards: int = SHARDS, fine: int = FINE, seed: int = SEED) -> DataFrame:
    """``items`` (``ids``, size, old shard; written already, as they are read
    several times) with ``shard``."""
    sizes = [0] * shards
    for old, size in items.groupBy("old").agg(F.sum("size")).collect():  # a row per old shard
        sizes[old] = size
    total = sum(sizes)
    coarse = max(1, total // (shards * fine))
    big = items.filter(F.col("size") > coarse).groupBy("old", "size").count().collect()  # at most shards * fine items
    taken, share = [0] * shards, -(-total // shards)
    quota: dict[tuple[int, int], list[int]] = {}
    for old, size, n in sorted(big, key=lambda r: (-r[1], r[0])):
        sizes[old] -= size * n
        for _ in range(n):
            j = old if taken[old] + size <= share else min(range(shards), key=lambda j: (taken[j], j))
            taken[j] += size
            quota.setdefault((old, size), []).append(j)
    plan = blocks(sizes, split_evenly(sum(sizes), taken))
    lanes = items.sparkSession.sparkContext.broadcast((np.array(sorted((i << 54) + at for i, at, _ in plan), np.int64), np.array([j for *_, j in sorted(plan)], np.int32), quota))

    def run(batches):
        starts, to, q = lanes.value
        for b in batches:
            old, size, rank, before = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("lane", "size", "rank", "before"))
            shard = np.zeros(b.num_rows, np.int32)
            small = size <= coarse
            if len(starts):
                at = (old.astype(np.int64) << 54) + before + size // 2
                shard[small] = to[np.maximum(np.searchsorted(starts, at[small], "right") - 1, 0)]
            for i in np.flatnonzero(~small).tolist():
                shard[i] = q[(int(old[i]) - shards) % shards, int(size[i])][int(rank[i])]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(b.num_columns - 3)), pa.array(shard)], schema=pa.schema([*list(b.schema)[:-3], pa.field("shard", pa.int32())]))

    # the coarse items are ranked within old shard and size, the others within their old shard
    lane = items.withColumn("lane", F.when(F.col("size") > coarse, F.col("old") + shards).otherwise(F.col("old")).cast("int"))
    lane = lane.withColumn("kind", F.when(F.col("size") > coarse, F.col("size")).otherwise(F.lit(0)))
    ranked = rank_within(lane, ["lane", "kind"], ids, seed, total="size")
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in items.schema)
    return ranked.select(*items.columns, "lane", "rank", "before").mapInArrow(run, f"{schema}, shard int")


def measures() -> list[Column]:
    size = F.coalesce(F.octet_length("text"), F.lit(0)).cast("long") + 1
    return [size.alias("size"), F.crc32(F.encode(text_bytes(), "UTF-8")).alias("text_crc32")]


def located(docs: DataFrame, shards: int = SHARDS) -> DataFrame:
    """Of a table read from files: doc_id, size, text_crc32, digest k1 and k2,
    ``file`` and ``row`` it is in, and ``old``: its old shard. That is its
    file's place by name, modulo the number of shards; the files of a table of
    fewer files than shards count as several consecutive blocks of rows each."""
    where = [F.col("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("row")]
    rows = written(docs.select(F.col("doc_id").cast("long").alias("doc_id"), *measures(), *digests(), *where), "rows")
    files = rows.groupBy("file").agg(F.count("*").alias("in_file"))
    many = files.count()
    parts = max(1, -(-shards // max(1, many)))
    place = (F.row_number().over(Window.orderBy("file")) - 1) * parts  # a row per file
    files = files.withColumn("place", place)
    old = ((F.col("place") + F.floor(F.col("row") * parts / F.col("in_file"))) % shards).cast("int")
    return written(rows.join(files, "file").withColumn("old", old).drop("place", "in_file"), "located")


def grouped(rows: DataFrame, shards: int = SHARDS, fine: int = FINE) -> tuple[DataFrame, DataFrame]:
    """(rows with ``part``, items): equal texts (k1, k2) are one item, of the
    old shard that holds most of its bytes, so that it is the others that move.
    Groups of more than a shard's share are cut into parts, each at most about
    a quarter of ``1/fine`` of a share, by a hash of id and place."""
    by = rows.groupBy("k1", "k2", "old").agg(F.sum("size").alias("bytes"))
    total, n = written(by, "bytes"), max(1, shards)
    share = F.lit((total.agg(F.coalesce(F.sum("bytes"), F.lit(0))).first()[0]) // n)
    groups = total.groupBy("k1", "k2").agg(F.sum("bytes").alias("b"))
    large = groups.filter(F.col("b") > share).select("k1", "k2", F.ceil(F.col("b") * 4 * fine / F.greatest(share, F.lit(1))).cast("long").alias("parts"))
    large = F.broadcast(written(large, "large"))  # fewer rows than shards
    part = F.coalesce(F.pmod(F.xxhash64("doc_id", "file", "row"), F.col("parts")), F.lit(-1))
    rows = rows.join(large, ["k1", "k2"], "left").withColumn("part", part).drop("parts")
    each = rows.groupBy("k1", "k2", "part", "old").agg(F.sum("size").alias("bytes"))
    home = F.max_by("old", F.struct("bytes", -F.col("old")))
    items = each.groupBy("k1", "k2", "part").agg(F.sum("bytes").alias("size"), home.alias("old"))
    return rows, written(items, "items")


def resharded(docs: DataFrame, shards: int = SHARDS, fine: int = FINE, seed: int = SEED) -> DataFrame:
    """The rows of :func:`located` with ``shard`` and ``slot``."""
    rows, items = grouped(located(docs, shards), shards, fine)
    placed = reshard(items, ["k1", "k2", "part"], shards, fine, seed).select("k1", "k2", "part", "shard")
    # whoever shares a text has the same key: AQE splits what is skewed
    rows = written(rows.join(written(placed, "placed"), ["k1", "k2", "part"]).withColumn("salt", F.monotonically_increasing_id()), "placed_rows")
    return rank_within(rows, ["shard"], ["doc_id", "k1", "file", "row"], seed + 1, salt="salt").withColumnRenamed("rank", "slot")


def affected(placed: DataFrame) -> list[int]:
    """The new shards whose rows aren't exactly those of the old one of that
    number; all others may stay as they are."""
    moved = placed.filter("old <> shard")
    both = moved.select(F.col("old").alias("s")).union(moved.select(F.col("shard").alias("s")))
    return sorted(r[0] for r in both.distinct().collect())  # at most two rows per shard


def rewrite_affected(docs: DataFrame, placed: DataFrame, out: str) -> list[int]:
    """Writes the shards that changed under ``out``, a folder
    ``docloom_shard=n`` of files each, sorted by ``docloom_slot``; returns their numbers. ``docs``: the table
    that ``placed`` (file, row, old, shard, slot) was located in."""
    dirty = affected(placed)
    if not dirty:
        return dirty
    total = placed.filter(F.col("shard").isin(dirty)).agg(F.sum("size")).first()[0]
    tasks = max(docs.sparkSession.sparkContext.defaultParallelism, -(-total // (FILE_BYTES * len(dirty))))
    moves = placed.filter(F.col("shard").isin(dirty)).select(F.col("file").alias("_docloom_file"), F.col("row").alias("_docloom_row"), F.col("shard").alias("_docloom_shard"), F.col("slot").alias("_docloom_slot"))
    texts = docs.select("*", F.col("_metadata.file_path").alias("_docloom_file"), F.col("_metadata.row_index").alias("_docloom_row"))
    # the only shuffle of texts: every task has a file's worth of each shard
    where = ["_docloom_file", "_docloom_row"]
    both = texts.repartition(tasks, *where).join(moves.repartition(tasks, *where), where).drop(*where)
    both.sortWithinPartitions("_docloom_shard", "_docloom_slot").withColumnsRenamed({"_docloom_shard": "docloom_shard", "_docloom_slot": "docloom_slot"}).write.partitionBy("docloom_shard").parquet(out)
    return dirty


def op6_min_cost_flow_resharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From the rewritten files; from the plan for shards that stay as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    placed, out = resharded(docs), folder(spark, "shards")
    placed = written(placed, "plan")
    dirty = rewrite_affected(docs, placed, out)
    rows = placed.filter(~F.col("shard").isin(dirty)).select("doc_id", "size", "text_crc32", "shard", "slot")
    if dirty:
        files = spark.read.parquet(out)
        rows = rows.unionByName(files.select(F.col("doc_id").cast("long").alias("doc_id"), *measures(), F.col("docloom_shard").cast("int").alias("shard"), F.col("docloom_slot").alias("slot")))
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", F.col("slot").cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
