"""SimHash near-duplicates, found with vantage-point partitions and trees.

Equal fingerprints are counted first; the rest works on different ones only.
A pair within ``RADIUS`` = 3 differing bits differs in at most one bit on one of
its two 32-bit halves. So fingerprints are partitioned twice, by the Hamming
distances of each half to a few vantage points; one bit changes every such
distance by exactly one. A shard holds the fingerprints at given distances, and
as visitors those of the shards one step away whose first distance is less: no
pair is missed or met twice, and visitors don't meet each other. There are more
vantage points the more fingerprints there are (one for every factor of 10
beyond ``SHARD``, as a tenth of all pairs share a distance), so shards don't
grow with the corpus. (On all 64 bits distances lie within 32 +- 4, and a radius
of 3 reaches half of all fingerprints: README has the figures.)

Inside a shard a vantage-point tree goes on, level by level for all its nodes at
once: its vantage points are fingerprints of the node, and by the triangle
inequality a visitor at distance d meets the branches d - 1 and d + 1 alone.
Where all halves of a node are equal, the other halves are searched the same
way, within the bits that are left. Shards of more than ``BIG_SHARD``
fingerprints, which share a half, are split by vantage points on the other half
first.

A shard returns a count of links for each fingerprint and a spanning forest,
never pairs. Components come from alternating large-star and small-star rounds.

Defined results: null and empty texts have fingerprint zero, linked as any
other; fewer than three words are one shingle; a very long text has as many
shingles as it has; repeated rows count as documents of their own; a null
``doc_id`` is no candidate for ``component_id`` (null if a component has no
other); of a component the row with the least ``doc_id``, or else the least
digest, is kept by :func:`deduplicated`, with all its columns, whatever their
names; an empty table gives an empty result.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import digests, documents, keyed, sized_join, texts, written

RADIUS = 3
#: Fingerprints of a shard that a search meets, about.
SHARD = 1024
#: Shards with more fingerprints than this are split by further vantage points.
BIG_SHARD = 1 << 18
#: The most fingerprints of a tree's leaf.
LEAF = 32
#: Pairs compared at a time.
PAIRS = 1 << 21
HOME, NEXT, SAME = range(3)  # visitors of the half's next shell, of the same half


def fingerprint(text: bytes, seed: int = 42) -> int:
    """Of lower-cased (A-Z) words in shingles of three; signed 64 bits."""
    words = text.lower().split()
    n = len(words)
    if not n:
        return 0
    h64 = xxhash.xxh64_intdigest
    if n < 3:
        h = np.array([h64(b" ".join(words), seed)], np.uint64)
    else:
        line = b" ".join(words)
        ends = np.append(np.flatnonzero(np.frombuffer(line, np.uint8) == 32), len(line)).tolist()
        starts = [0, *(e + 1 for e in ends)]
        h = np.array([h64(line[a:b], seed) for a, b in zip(starts, ends[2:])], np.uint64)
    bits = np.unpackbits(h.view(np.uint8)).reshape(-1, 64).sum(0, dtype=np.int64)
    return int(np.packbits(2 * bits > len(h)).view(np.int64)[0])


def fingerprints(docs: DataFrame, seed: int = 42) -> DataFrame:
    """(doc_id, digest k1 and k2, fp); a map over the text. Copies in a batch
    are hashed once."""

    def run(batches):
        for part, raw in texts(batches):
            known = {t: fingerprint(t, seed) for t in set(raw)}
            yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([known[t] for t in raw], pa.int64())], names=["doc_id", "k1", "k2", "fp"])

    return keyed(docs).mapInArrow(run, "doc_id long, k1 long, k2 long, fp long")


def spanning(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A star for each component of the given edges."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(nodes))
    while True:
        low = np.minimum(label[x], label[y])
        new = label.copy()
        np.minimum.at(new, x, low)
        np.minimum.at(new, y, low)
        np.minimum.at(new, label[x], low)
        np.minimum.at(new, label[y], low)
        new = new[new]
        if (new == label).all():
            break
        label = new
    off = label != np.arange(len(nodes))
    return nodes[label[off]], nodes[off]


class Links:
    """Collects what shards return: link counts and spanning edges."""

    def __init__(self, fp: np.ndarray, weight: np.ndarray, half: np.ndarray):
        self.fp, self.weight, self.second = fp, weight, half == 1
        self.near = np.zeros(len(fp), np.int64)
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        #: Pairs that share a shard, and those that a leaf compared.
        self.met = [0, 0]

    def compare(self, i: np.ndarray, j: np.ndarray) -> None:
        """Links those of the pairs of indices that are within RADIUS."""
        self.met[1] += len(i)
        x = self.fp[i] ^ self.fp[j]
        # a pair is found on the first half unless it differs in more bits of it
        apart = np.bitwise_count(x & np.uint64(0xFFFFFFFF)) > 1
        ok = (np.bitwise_count(x) <= RADIUS) & (apart == self.second[i])
        i, j = i[ok], j[ok]
        if len(i):
            np.add.at(self.near, i, self.weight[j])
            np.add.at(self.near, j, self.weight[i])
            self.edges.append(spanning(i, j))


def crossed(a: np.ndarray, b: np.ndarray, first: np.ndarray, many: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Every entry of ``a`` with its ``many`` entries of ``b`` from ``first``."""
    end = np.cumsum(many)
    at = np.arange(int(end[-1]) if len(end) else 0) - np.repeat(end - many - first, many)
    return np.repeat(a, many), b[at]


def search(links: Links, na: np.ndarray, a: np.ndarray, nb: np.ndarray, b: np.ndarray, stages: list[tuple[np.ndarray, list[int]]], ordered: np.ndarray | None = None) -> None:
    """Compares entries ``a`` (indices) of nodes ``na`` with entries ``b`` of
    the same nodes ``nb``, wherever the tree doesn't rule it out. ``stages``:
    metrics (values by index) and by how much distances to a vantage point may
    differ. ``ordered``: entries of ``a`` that meet only later entries of ``b``,
    as they are on both sides."""
    stage = np.zeros(max(int(na.max()), int(nb.max())) + 1 if len(na) and len(nb) else 0, np.int64)
    by = np.argsort(nb, kind="stable")
    nb, b = nb[by], b[by]
    first_round = True
    while len(a) and len(b):
        start = np.searchsorted(nb, np.arange(len(stage)))
        size = np.diff(np.append(start, len(nb)))
        if first_round:
            links.met[0] += int(size[na].sum())
            first_round = False
        leaf = (size <= LEAF) | (stage == len(stages))
        done = leaf[na]
        _leaves(links, a[done], b, start[na[done]], size[na[done]], ordered)
        na, a = na[~done], a[~done]
        keep = ~leaf[nb]
        nb, b = nb[keep], b[keep]
        if not len(a) or not len(b):
            return
        start = np.searchsorted(nb, np.arange(len(stage)))
        shells, moved_a, moved_b, next_stage = [], [], [], []
        for k, (value, apart) in enumerate(stages):
            here_b, here_a = stage[nb] == k, stage[na] == k
            if not here_b.any() or not here_a.any():
                continue
            bb, nbb, aa, naa = b[here_b], nb[here_b], a[here_a], na[here_a]
            top = value[b[np.minimum(start, len(b) - 1)]]
            db = np.bitwise_count(value[bb] ^ top[nbb]).astype(np.int64)
            da = np.bitwise_count(value[aa] ^ top[naa]).astype(np.int64)
            far = np.zeros(len(stage), np.int64)
            np.maximum.at(far, nbb, db)
            key_b = nbb * 256 + db + 64
            some, at_b = np.unique(key_b, return_inverse=True)
            for by in apart:
                key_a = naa * 256 + da + by + 64
                at = np.minimum(np.searchsorted(some, key_a), len(some) - 1)
                hit = some[at] == key_a
                shells.append((len(next_stage), at[hit], aa[hit]))
            # all values of the node are the same: on with the next metric
            next_stage.append(k + (far[some // 256] == 0))
            moved_b.append((len(next_stage) - 1, at_b, bb))
        base = np.concatenate(([0], np.cumsum([len(x) for x in next_stage]))).astype(np.int64)
        stage = np.concatenate(next_stage)
        na = np.concatenate([base[k] + at for k, at, _ in shells])
        a = np.concatenate([x for *_, x in shells])
        nb = np.concatenate([base[k] + at for k, at, _ in moved_b])
        b = np.concatenate([x for *_, x in moved_b])
        by = np.argsort(nb, kind="stable")
        nb, b = nb[by], b[by]


def _leaves(links: Links, a: np.ndarray, b: np.ndarray, start: np.ndarray, size: np.ndarray, ordered: np.ndarray | None) -> None:
    """Compares in parts of about PAIRS; an entry alone may have as many as
    its shard."""
    some = size > 0
    a, start, size = a[some], start[some], size[some]
    end = np.cumsum(size)
    k = 0
    while k < len(a):
        stop = max(k + 1, int(np.searchsorted(end, (end[k - 1] if k else 0) + PAIRS, "right")))
        i, j = crossed(a[k:stop], b, start[k:stop], size[k:stop])
        if ordered is not None:
            new = ~ordered[i] | (i < j)
            i, j = i[new], j[new]
        links.compare(i, j)
        k = stop


def shard_links(keys: np.ndarray, fp: np.ndarray, weight: np.ndarray, kind: np.ndarray, half: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, Links]:
    """(kind, x, y) of whole shards, sorted by key. Kind 0: fingerprint x has y
    more links; kind 1: x and y are in one component."""
    bits = fp.view(np.uint64)
    links = Links(bits, weight, half)
    low, high = bits & np.uint64(0xFFFFFFFF), bits >> np.uint64(32)
    own, other = np.where(half == 0, low, high), np.where(half == 0, high, low)
    node = np.cumsum(np.append(0, keys[1:] != keys[:-1]))
    home = np.flatnonzero(kind == HOME)
    visitor = np.flatnonzero(kind == NEXT)
    search(links, node[visitor], visitor, node[home], home, [(own, [-1, 1]), (other, list(range(1 - RADIUS, RADIUS)))])
    # the same half: a node is a half of a shard
    both = np.flatnonzero(kind != NEXT)
    order = both[np.lexsort((own[both], node[both]))]
    new = np.append(True, (node[order][1:] != node[order][:-1]) | (own[order][1:] != own[order][:-1]))
    equal = np.empty(len(fp), np.int64)
    equal[order] = np.cumsum(new) - 1
    often = np.bincount(equal[both]) > 1 if len(both) else np.zeros(0, bool)
    a, b = both[often[equal[both]]], home[often[equal[home]]]
    if len(a) and len(b):
        search(links, equal[a], a, equal[b], b, [(other, list(range(-RADIUS, RADIUS + 1)))], kind == HOME)
    some = np.flatnonzero(links.near)
    x, y = [fp[some]], [links.near[some]]
    for a, b in links.edges:
        x.append(fp[a])
        y.append(fp[b])
    out = np.ones(sum(map(len, x)), np.int32)
    out[: len(some)] = 0
    return out, np.concatenate(x), np.concatenate(y), links


def whole_groups(batches: Iterator[pa.RecordBatch], key: str, least: int) -> Iterator[dict[str, np.ndarray]]:
    """Columns of sorted batches, in pieces of ``least`` rows or more that end
    where a group does."""
    held: list[dict[str, np.ndarray]] = []
    count = 0
    for b in batches:
        held.append({n: b.column(i).to_numpy(zero_copy_only=False) for i, n in enumerate(b.schema.names)})
        count += b.num_rows
        if count >= least:
            table = {n: np.concatenate([h[n] for h in held]) for n in held[0]}
            end = int(np.flatnonzero(np.append(True, table[key][1:] != table[key][:-1]))[-1])
            if end:
                yield {n: v[:end] for n, v in table.items()}
            held, count = [{n: v[end:] for n, v in table.items()}], count - end
    if count:
        yield {n: np.concatenate([h[n] for h in held]) for n in held[0]}


def vantage(name: str, level: int) -> int:
    return int.from_bytes(xxhash.xxh32_digest(f"{name} {level}".encode()), "little")


def levels(n: int) -> int:
    """Vantage points of a half for ``n`` fingerprints: halves of 32 random
    bits share a distance with a tenth of all others."""
    return min(9, max(1, math.ceil(math.log10(max(n, 1) / SHARD))))


def sharded(classes: DataFrame, deep: int) -> DataFrame:
    """``classes`` (fp, n) by shard: key, half, kind, fp, n."""
    steps = [1 + sum(s << 6 * (k + 1) for k, s in enumerate(signs)) for signs in itertools.product((-1, 1), repeat=deep - 1)]
    places = []
    for half in (0, 1):
        value = F.shiftrightunsigned("fp", 32 * half).bitwiseAND(0xFFFFFFFF)
        home = F.lit(half << 60)
        for k in range(deep):
            home = home + F.shiftleft(F.bit_count(value.bitwiseXOR(F.lit(vantage(f"half {half}", k)))).cast("long") + 1, 6 * k)
        places += [F.struct((home + s).alias("key"), F.lit(half).alias("half"), F.lit(NEXT if s else HOME).alias("kind")) for s in (0, *steps)]
    return classes.select("fp", "n", F.explode(F.array(*places)).alias("p")).select("p.key", "p.half", "p.kind", "fp", "n")


def split_big(rows: DataFrame, big: int) -> DataFrame:
    """Shards above ``big`` split by one to three vantage points of the other
    half: each part also gets the visitors its triangle bounds admit."""
    sizes = written(rows.groupBy("key").agg(F.count("*").alias("many")).filter(F.col("many") > big), "big")
    if sizes.isEmpty():
        return rows
    rows = sized_join(rows, sizes, "key", "left").withColumn("many", F.coalesce("many", F.lit(0)))
    other = F.shiftrightunsigned("fp", 32).bitwiseAND(0xFFFFFFFF)
    other = F.when(F.col("half") == 0, other).otherwise(F.col("fp").bitwiseAND(0xFFFFFFFF))
    near, far = range(1 - RADIUS, RADIUS), range(-RADIUS, RADIUS + 1)

    def moves(d, pairs):
        return F.array(*(F.struct((d + by).cast("long").alias("at"), F.lit(kind).alias("kind")) for by, kind in pairs))

    for k in range(3):
        d = F.bit_count(other.bitwiseXOR(F.lit(vantage("other", k)))).cast("int") + 8
        to = F.when(F.col("kind") == HOME, moves(d, [(by, SAME if by else HOME) for by in range(RADIUS + 1)]))
        to = to.when(F.col("kind") == NEXT, moves(d, [(by, NEXT) for by in near])).otherwise(moves(d, [(by, SAME) for by in far]))
        stay = F.array(F.struct(F.lit(0).cast("long").alias("at"), F.col("kind").alias("kind")))
        rows = rows.withColumn("_p", F.explode(F.when(F.col("many") > big * 8**k, to).otherwise(stay)))
        rows = rows.withColumn("part", F.shiftleft("part", 6) + F.col("_p.at")).withColumn("kind", F.col("_p.kind")).drop("_p")
    return rows.drop("many")


def near_links(classes: DataFrame, big: int = BIG_SHARD, deep: int | None = None) -> DataFrame:
    """(kind, x, y) over different fingerprints ``classes`` (fp, n; written)."""
    n = classes.count()
    rows = sharded(classes, deep or levels(n)).withColumn("part", F.lit(0).cast("long"))
    if n > big:  # else no shard can be
        rows = split_big(rows, big)
    rows = rows.select("key", "part", "half", "kind", "fp", "n").repartition("key", "part").sortWithinPartitions("key", "part", "fp")
    rows = rows.select(F.xxhash64("key", "part").alias("key"), "half", "kind", "fp", "n")

    def run(batches):
        for t in whole_groups(batches, "key", 1 << 18):
            kind, x, y, _ = shard_links(t["key"], t["fp"], t["n"], t["kind"], t["half"])
            yield pa.RecordBatch.from_arrays([pa.array(kind), pa.array(x), pa.array(y)], names=["kind", "x", "y"])

    return rows.mapInArrow(run, "kind int, x long, y long")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (x, y); root: the least node.
    Large-star and small-star rounds, each written to the shared folder."""
    edges = written(edges.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).filter("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.min("v").alias("m")).withColumn("m", F.least("m", "u"))
        large = both.join(low, "u").filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u")
        small = small.filter("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).union(least.select("u", F.col("m").alias("v")))
        edges = written(small.filter("u <> v").distinct(), "edges")
        now = tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())
        if now == state:
            return edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
        state = now


def near_duplicates(docs: DataFrame, seed: int = 42, big: int = BIG_SHARD, deep: int | None = None) -> DataFrame:
    """doc_id, fingerprint (hex), n_near, component_id of every document."""
    prints, known = _found(docs, seed, big, deep)
    return prints.join(known, "fp").select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "n_near", "component_id")


def _found(docs: DataFrame, seed: int = 42, big: int = BIG_SHARD, deep: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(doc_id, digest k1 and k2, fp) of every document, and what is known of
    every fingerprint: n_near, component_id and the row to keep."""
    prints = written(fingerprints(docs, seed), "prints")
    row = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")
    classes = written(prints.groupBy("fp").agg(F.count("*").alias("n"), F.min(row).alias("first")), "classes")
    links = written(near_links(classes.select("fp", "n"), big, deep), "links")
    near = links.filter("kind = 0").groupBy(F.col("x").alias("fp")).agg(F.sum("y").alias("near"))
    roots = components(links.filter("kind = 1").select("x", "y")).withColumnRenamed("node", "fp")
    full = classes.join(near, "fp", "left").join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp"))
    full = written(full.select("fp", "first", "root", (F.col("n") - 1 + F.coalesce("near", F.lit(0))).alias("n_near")), "full")
    leader = full.groupBy("root").agg(F.min("first").alias("kept"))
    return prints, full.join(leader, "root").select("fp", "n_near", F.col("kept.doc_id").alias("component_id"), "kept")


def deduplicated(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with one document of each component. Rows are known by their id
    and the digest of their text; those that go are looked up, and those that
    stay are only shuffled if the same row comes more than once."""
    prints, known = _found(docs, **how)
    own = F.struct(F.col("doc_id").isNull().alias("nameless"), "doc_id", "k1", "k2")
    found = prints.join(known.select("fp", "kept"), "fp").select("doc_id", "k1", "k2", (own == F.col("kept")).alias("stays"))
    rows = written(found.groupBy("doc_id", "k1", "k2").agg(F.first("stays").alias("stays"), F.count("*").alias("n")).filter("not stays or n > 1"), "rows")
    rows = rows.toDF("_docloom_id", "_docloom_k1", "_docloom_k2", "_docloom_stays", "_docloom_n")
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_docloom_id")) & (F.col("_docloom_a") == F.col("_docloom_k1")) & (F.col("_docloom_b") == F.col("_docloom_k2"))
    both = sized_join(docs.select("*", *digests(("_docloom_a", "_docloom_b"))), rows, on, "left")
    once = both.filter("_docloom_n is null").select(*docs.columns)
    if rows.filter("_docloom_stays").isEmpty():
        return once
    again = both.filter("_docloom_stays").dropDuplicates(["_docloom_id", "_docloom_a", "_docloom_b"])
    return once.unionByName(again.select(*docs.columns))


def op3_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir))
