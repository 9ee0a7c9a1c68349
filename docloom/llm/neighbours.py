"""Nearest neighbours by inner product over randomly rotated one-bit codes.

Every vector is padded with zeros to four times its length, rotated (one seeded
orthogonal matrix), reduced to its signs, packed into bits (an eighth of single
precision), and kept with two scalars: its length and the inner product
of its direction with its code's. The product of a query's rotated components
with the unpacked signs, times those scalars, estimates the inner product. The
estimate's error bound decides which vectors are reranked with their original
components: all whose upper bound reaches the query's current threshold.
EPSILON = 3 standard deviations of the rotation's randomness leave about one
neighbour in a thousand unseen.

Rows are taken in pieces of a fixed number of bytes, sorted into cells about
centres that are fitted on a bounded sample (``SAMPLE`` rows); a query meets a
cell only if the triangle bound, its product with the centre plus its length
times the cell's radius, reaches its threshold. That prunes clustered vectors;
of evenly spread ones every cell is met, and the work is queries times rows.

Queries go in blocks of at most ``BLOCK_BYTES``, each broadcast, compared with all
rows in place, and its results written, before the next: no row is shuffled but
each task's best ``k`` per query, and the driver holds one block at a time. The
sample also gives the first thresholds; which rows are indexed doesn't depend
on it.

Defined results: vectors that are null, all zero, of another length than most,
or hold null or non-finite components take no part, nor do rows without
``vec_id``; rows that repeat a query's ``vec_id`` aren't its neighbours, and
its least vector is the query; ties go to the smaller ``vec_id``; fewer than
``k`` candidates are all returned; scores are summed up in double precision
from the first component to the last; extra columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import appended, written

K = 20
EVERY = 20
#: Bytes of queries to a broadcast, which takes three times as much.
BLOCK_BYTES = 8 << 20
#: Rows that centres and first thresholds are fitted on.
SAMPLE = 1 << 13
CELLS = 64
#: Bytes of vectors to a piece.
PIECE = 16 << 20
#: Queries to a product, which has as many rows.
TILE = 2048
EPSILON = 3.0
#: Bits of code per component; the error falls with the root of it.
BITS = 4
SEED = 9


def rotation(dim: int, bits: int = BITS, seed: int = SEED) -> np.ndarray:
    """(dim, dim * bits): turns vectors padded with zeros to ``bits`` times
    their length."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim * bits, dim * bits)))
    return (q * np.sign(np.diag(r)))[:dim]


def encode(x: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(packed codes, length, alignment) of the rows of ``x``."""
    length = np.linalg.norm(x, axis=1)
    o = (x / length[:, None]) @ turn
    return np.packbits(o > 0, axis=1), length, np.abs(o).sum(1) / np.sqrt(turn.shape[1])


def signs(codes: np.ndarray, dim: int) -> np.ndarray:
    return np.unpackbits(codes, axis=1, count=dim).astype(np.float32) * 2 - 1


def estimates(r: np.ndarray, codes: np.ndarray, length: np.ndarray, align: np.ndarray, epsilon: float) -> tuple[np.ndarray, np.ndarray]:
    """Inner products (queries, rows) of rotated queries with coded rows, and
    how far off they are at most, for a query of length 1."""
    dim = r.shape[1]
    scale = length / align
    spread = np.sqrt(np.maximum(1 - align**2, 0) / max(dim - 1, 1))
    value = r.astype(np.float32) @ signs(codes, dim).T
    value *= (scale / np.sqrt(dim)).astype(np.float32)
    # the last term covers single precision
    return value, (scale * epsilon * spread + 1e-5 * length).astype(np.float32)


def centres(x: np.ndarray, cells: int = CELLS, rounds: int = 8, seed: int = SEED) -> np.ndarray:
    """Lloyd's centres of the sample."""
    k = max(1, min(cells, len(x) // 32))
    c = x[np.random.default_rng(seed).choice(len(x), k, replace=False)]
    for _ in range(rounds):
        at = nearest_centre(x, c)
        n = np.bincount(at, minlength=k)
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
    return c


def nearest_centre(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return np.argmin((c**2).sum(1) - 2 * (x @ c.T), axis=1)


def in_order(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of rows, each added up from the first component on."""
    s = np.zeros(len(x))
    for a, b in zip(x.T, y.T):
        s += a * b
    return s


class Queries:
    """A block of queries, ready to be compared with codes."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, turn: np.ndarray, centre: np.ndarray, floor: np.ndarray):
        self.ids, self.x, self.turn, self.centre, self.floor = ids, x, turn, centre, floor
        self.rotated = (x @ turn).astype(np.float32)
        self.length = np.linalg.norm(x, axis=1)

    def best(self, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int, epsilon: float, met: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query number, ids, scores): at least the ``k`` nearest of the rows
        (ids, x) to each query. ``floor``: scores below which nothing matters;
        raised on the way. ``met`` counts pairs: all, met in cells, reranked."""
        cell = nearest_centre(x, self.centre)
        order = np.argsort(cell, kind="stable")
        ids, x, cell = ids[order], x[order], cell[order]
        codes, length, align = encode(x, self.turn)
        first = np.flatnonzero(np.append(True, cell[1:] != cell[:-1]))
        out: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        for a, b in zip(first.tolist(), [*first[1:].tolist(), len(x)]):
            c = x[a:b].mean(0)
            radius = np.linalg.norm(x[a:b] - c, axis=1).max()
            reach = np.flatnonzero(self.x @ c + self.length * radius * (1 + 1e-9) + 1e-300 >= floor)
            for t in range(0, len(reach), TILE):
                for u in range(a, b, TILE):
                    q, r = reach[t : t + TILE], slice(u, min(u + TILE, b))
                    value, apart = estimates(self.rotated[q], codes[r], length[r], align[r], epsilon)
                    value += apart * self.length[q, None].astype(np.float32)
                    i, j = np.nonzero(value >= floor[q, None].astype(np.float32))
                    other = ids[u + j] != self.ids[q[i]]
                    i, j = q[i[other]], u + j[other]
                    if met is not None:
                        met[1] += value.size
                        met[2] += len(i)
                    if len(i):
                        out.append(self._rerank(i, j, ids, x, floor, k))
        if met is not None:
            met[0] += len(self.ids) * len(ids)
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        return tuple(np.concatenate(c) for c in zip(*out))

    def _rerank(self, i: np.ndarray, j: np.ndarray, ids: np.ndarray, x: np.ndarray, floor: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of pairs of queries ``i`` (ascending) and rows ``j`` the best."""
        s = np.empty(len(i))
        for a in range(0, len(i), 1 << 15):
            s[a : a + (1 << 15)] = np.einsum("ij,ij->i", x[j[a : a + (1 << 15)]], self.x[i[a : a + (1 << 15)]])
        near = s >= floor[i] - 1e-9 * np.abs(floor[i]) - 1e-300
        i, j, s = i[near], j[near], s[near]
        order = np.lexsort((ids[j], -s, i))
        i, j, s = i[order], j[order], s[order]
        start = np.flatnonzero(np.append(True, i[1:] != i[:-1])) if len(i) else np.zeros(0, np.int64)
        many = np.diff(np.append(start, len(i)))
        last = start[many >= k] + k - 1
        floor[i[last]] = np.maximum(floor[i[last]], s[last])
        # rounding may tell ties apart that aren't, so all near the last stay
        keep = s >= floor[i] - 1e-9 * np.abs(floor[i]) - 1e-300
        i, j = i[keep], j[keep]
        return i, ids[j], in_order(x[j], self.x[i])


def usable(table: DataFrame, vec: str = "embedding", id_: str = "vec_id") -> tuple[DataFrame, int]:
    t = table.select(F.col(id_).cast("long").alias("vec_id"), F.col(vec).cast("array<double>").alias("v")).filter("vec_id is not null and v is not null")
    common = t.groupBy(F.size("v").alias("d")).count().orderBy(F.desc("count"), "d").first()
    dim = common[0] if common else 0
    fine = F.forall("v", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))) & F.exists("v", lambda c: c != 0)
    return t.filter((F.size("v") == dim) & fine), dim


def matrix(col: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)


def pieces(batches, dim: int, limit: int = PIECE):
    """(ids, vectors) of about ``limit`` bytes."""
    held, n = [], 0
    for b in batches:
        if b.num_rows:
            held.append((b.column(0).to_numpy(), matrix(b.column(1), dim)))
            n += b.num_rows
        if n * dim * 8 >= limit:
            yield tuple(map(np.concatenate, zip(*held)))
            held, n = [], 0
    if held:
        yield tuple(map(np.concatenate, zip(*held)))


def first_floor(ids: np.ndarray, x: np.ndarray, sample_ids: np.ndarray, sample_x: np.ndarray, k: int) -> np.ndarray:
    """For each query about the ``k``-th best score in the sample, if it has so
    many: some ranks below it, so that a miss above it still leaves ``k``."""
    floor, k = np.full(len(ids), -np.inf), k + 3 + k // 5
    for a in range(0, len(ids), 512):
        s = x[a : a + 512] @ sample_x.T
        s[sample_ids[None, :] == ids[a : a + 512, None]] = -np.inf
        if s.shape[1] >= k:
            f = np.partition(s, s.shape[1] - k, axis=1)[:, s.shape[1] - k]
            floor[a : a + 512] = np.where(np.isfinite(f), f - 1e-9 * np.abs(f), f)
    return floor


def nearest(table: DataFrame, queries: DataFrame | None = None, k: int = K, block: int | None = None, epsilon: float = EPSILON, seed: int = SEED) -> DataFrame:
    """query_id, rank, vec_id, score: the ``k`` nearest rows of ``table``
    (vec_id, embedding) to each of ``queries`` (default: to every row whose id
    is divisible by EVERY)."""
    spark = table.sparkSession
    rows, dim = usable(table)
    asked = usable(queries)[0].filter(F.size("v") == dim) if queries is not None else rows.filter(F.col("vec_id") % EVERY == 0)
    asked = asked.groupBy("vec_id").agg(F.min("v").alias("v"))
    found = appended(spark, "neighbours", "query_id long, vec_id long, score double")
    if dim:
        asked, many = _blocks(asked, block or max(1, BLOCK_BYTES // (8 * dim)))
        sample = rows.limit(SAMPLE).toArrow()  # bounded
        sample_ids, sample_x = sample.column("vec_id").to_numpy(), matrix(sample.column("v"), dim)
        turn = rotation(dim, seed=seed)
        centre = centres(sample_x, seed=seed) if len(sample_x) else np.zeros((1, dim))
        for b in range(many):
            part = asked.filter(F.col("block") == b).select("vec_id", "v").toArrow()  # about `block` rows
            if part.num_rows:
                ids, x = part.column("vec_id").to_numpy(), matrix(part.column("v"), dim)
                shared = spark.sparkContext.broadcast(Queries(ids, x, turn, centre, first_floor(ids, x, sample_ids, sample_x, k)))
                found.add(rows.mapInArrow(_scan(shared, dim, k, epsilon), found.schema))
                shared.destroy()
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.read().withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def _blocks(asked: DataFrame, block: int) -> tuple[DataFrame, int]:
    """The queries with the number of their block, and how many there are."""
    asked = written(asked, "queries")
    n = -(-asked.count() * 9 // (block * 8))  # hashing spreads unevenly
    return asked.withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(max(1, n)))), n


def _scan(shared, dim: int, k: int, epsilon: float):
    def run(batches):
        q = shared.value
        floor = q.floor.copy()
        for ids, x in pieces(batches, dim):
            i, v, s = q.best(ids, x, floor, k, epsilon)
            some = s >= floor[i] - 1e-9 * np.abs(floor[i]) - 1e-300
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[i[some]]), pa.array(v[some]), pa.array(s[some])], names=["query_id", "vec_id", "score"])

    return run


def op9_rotated_code_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))


ORACLE = """
WITH v AS (
  SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
), d AS (
  SELECT len(v) AS dim FROM v GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1
), u AS (
  SELECT vec_id, v FROM v, d WHERE len(v) = dim AND len(list_filter(v, lambda c: c IS NULL OR NOT isfinite(c))) = 0 AND len(list_filter(v, lambda c: c <> 0)) > 0
), q AS (
  SELECT vec_id AS query_id, min(v) AS q FROM u WHERE vec_id % 20 = 0 GROUP BY 1
), s AS (
  SELECT query_id, vec_id, list_inner_product(q, v) AS score FROM q JOIN u ON vec_id <> query_id
), r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s
)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""
