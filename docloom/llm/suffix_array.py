"""Exact substring dedup by column-wise construction over many documents.

The textbook construction inserts one symbol of every document a round, right
to left, and merges it into the collection's Burrows-Wheeler transform: with
documents of 100,000 bytes that is 100,000 passes over a growing file (README
has the figures). Here the collection is first cut into short, aligned
"documents": the surroundings of content-defined anchors that occur repeatedly
(see repeats.py), trimmed to the windows of which the anchor is the least. All
reads of an anchor are aligned, so the rounds, one symbol of every read each,
update the *positional* transform: the order of the reads by their reversed
prefixes, and the common prefix length of neighbours. After round c two
neighbours whose match began at c - 199 or before share the 200 bytes that end
there. A bucket is read as one sorted sequential file; there are 336 rounds
whatever the documents' lengths.

Defined results: null and empty texts have no bytes and no spans; texts shorter
than a window are kept whole, texts of any length are worked on as a whole;
rows are known by the digest of their text, so null and repeated ids make no
difference; repeated rows and copies remove each other
entirely if long enough; overlaps within one document count; extra columns are
ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, chunks, documents, keyed, texts, written
from .repeats import HOT, SLICE, Repeated, anchors, byte_symbols, with_spans

SPAN = 200
GRAM = 64
PAD = b"\xff"  # never part of UTF-8
READ = "h long, k1 long, k2 long, first int, lead int, copies int, bytes binary"
SPANS = "k1 long, k2 long, s int, e int"


def repeated_windows(groups: np.ndarray, columns: np.ndarray, span: int) -> np.ndarray:
    """Boolean (windows, reads): the windows of aligned reads that another
    read of the group has too. ``columns``: (symbols, reads), PAD outside of a
    read; ``groups``: group numbers, ascending.

    Rounds of the positional Burrows-Wheeler transform: ``order`` sorts the
    reads of each group by their reversed prefixes, ``since`` is where the match
    with the predecessor began."""
    width, n = columns.shape
    out = np.zeros((width - span + 1, n), bool)
    order = np.arange(n)
    head = np.append(True, groups[1:] != groups[:-1])
    since = np.where(head, width + 1, 0).astype(np.int32)
    group = groups.astype(np.int64) << 8
    for c in range(width):
        x = columns[c][order]
        key = group | x
        by = np.argsort(key, kind="stable")
        new_key = key[by]
        same = np.append(False, new_key[1:] == new_key[:-1])
        start = np.full(n, c + 1, np.int32)
        at = np.flatnonzero(same)
        if len(at):
            a, b = by[at - 1] + 1, by[at] + 1
            near = since[by[at]]
            far = np.flatnonzero(b - a > 1)
            if len(far):
                bounds = np.stack((a[far], b[far]), 1).ravel()
                near[far] = np.maximum.reduceat(np.append(since, np.int32(0)), bounds)[::2]
            start[at] = near
        order, since = order[by], start
        if c >= span - 1:
            hit = since <= c - span + 1
            hit[:-1] |= hit[1:]
            out[c - span + 1, order] = hit
    return out


def read_spans(h: list[int], lead: list[int], copies: list[int], raw: list[bytes], span: int = SPAN, gram: int = GRAM) -> list[list[tuple[int, int]]]:
    """For every read (sorted by anchor) its repeated spans, from its start."""
    w = span - gram + 1
    known: dict[tuple, int] = {}
    which, many = [], []
    for x in zip(h, lead, raw):
        k = known.setdefault(x, len(many))
        if k == len(many):
            many.append(0)
        which.append(k)
    for k, c in zip(which, copies):
        many[k] += c
    keys = list(known)
    groups = np.unique(np.array([k[0] for k in keys], np.int64), return_inverse=True)[1]
    # `keys` come in the order of the anchors, as the reads do
    group_of = np.concatenate(([0], np.cumsum(np.diff(groups) != 0))) if len(groups) else groups
    size = np.bincount(group_of)[group_of]
    flags: dict[int, np.ndarray] = {}
    need = np.flatnonzero(size > 1)
    width = w - 1 + span
    if len(need):
        rows = b"".join(PAD * (w - 1 - keys[i][1]) + keys[i][2] + PAD * (width - (w - 1 - keys[i][1]) - len(keys[i][2])) for i in need.tolist())
        m = np.ascontiguousarray(np.frombuffer(rows, np.uint8).reshape(len(need), width).T)
        found = repeated_windows(group_of[need], m, span)
        for col, i in enumerate(need.tolist()):
            a = w - 1 - keys[i][1]
            flags[i] = found[a : a + len(keys[i][2]) - span + 1, col]
    spans = []
    for i, k in enumerate(keys):
        if many[i] > 1:
            spans.append([(0, len(k[2]))])
        elif i in flags and flags[i].any():
            edge = np.flatnonzero(np.diff(np.concatenate(([0], flags[i].view(np.int8), [0]))))
            spans.append([(int(a), int(b) - 1 + span) for a, b in edge.reshape(-1, 2)])
        else:
            spans.append([])
    return [spans[k] for k in which]


def repeated_spans(docs: DataFrame, span: int = SPAN, gram: int = GRAM, limit: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
    """Spans (k1, k2, s, e) of the ``keyed`` documents' bytes that are covered
    by strings of ``span`` bytes which also start elsewhere."""

    def find(data, off):
        at, h, _, _ = anchors(byte_symbols(data), off, span, gram)
        return h, np.searchsorted(off, at, "right") - 1

    repeated = Repeated(docs, find, limit, hot)
    look = repeated.found()

    def reads(batches):
        for part, data, off in chunks(batches, limit=SLICE):
            k1, k2 = (part.column(i).to_numpy() for i in (0, 1))
            # copies within the slice are read once, and marked
            first, which, copies = np.unique(np.stack((k1, k2), 1), axis=0, return_index=True, return_inverse=True, return_counts=True)[1:]
            at, h, lo, hi = anchors(byte_symbols(data), off, span, gram)
            doc = np.searchsorted(off, at, "right") - 1
            again, is_hot = look(part, h)
            use = np.flatnonzero(again & (first[which.ravel()[doc]] == doc))
            use = use[np.argsort(h[use], kind="stable")]
            raw, d = data.tobytes(), doc[use]
            many = copies.ravel()[which.ravel()[d]].astype(np.int32)
            hot_ = is_hot[use]
            cold = ~hot_
            body = [raw[a:b] for a, b in zip(lo[use][cold].tolist(), (hi[use][cold] + span).tolist())]
            cols = [h[use].view(np.int64)[cold], k1[d][cold], k2[d][cold], (lo[use] - off[d]).astype(np.int32)[cold], (at[use] - lo[use]).astype(np.int32)[cold], many[cold]]
            windows: list[list] = [[], [], [], [], [], [], []]
            seen: set[int] = set()  # a window may have several anchors of one hash
            for i in np.flatnonzero(hot_).tolist():
                u = use[i]
                for s in range(int(lo[u]), int(hi[u]) + 1):
                    if s in seen:
                        continue
                    seen.add(s)
                    for col, v in zip(windows, (None, int(k1[d[i]]), int(k2[d[i]]), s - int(off[d[i]]), 0, int(many[i]), xxhash.xxh3_128_digest(raw[s : s + span]))):
                        col.append(v)
            types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(c, t), pa.array(x, t)]) for c, t, x in zip([*cols, body], types, windows)], names=["h", "k1", "k2", "first", "lead", "copies", "bytes"])

    def compare(batches):
        held: dict[str, list] = {}
        for b in batches:
            got = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            held = {n: held.get(n, []) + v for n, v in got.items()}
            if len(held["h"]) < 1 << 13:
                continue
            end = next((i for i in range(len(held["h"]) - 1, 0, -1) if held["h"][i] != held["h"][i - 1]), 0)
            if end:
                yield answer({n: v[:end] for n, v in held.items()})
                held = {n: v[end:] for n, v in held.items()}
        if held and held["h"]:
            yield answer(held)

    def answer(t):
        spans = read_spans(t["h"], t["lead"], t["copies"], t["bytes"], span, gram)
        rows = [(a, b, f + s, f + e) for a, b, f, found in zip(t["k1"], t["k2"], t["first"], spans) for s, e in found]
        cols = list(zip(*rows)) or [()] * 4
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.int32(), pa.int32()))], names=["k1", "k2", "s", "e"])

    cols = ["k1", "k2", "text"] + ([] if repeated.shared is not None else ["again", "hot"])
    got = repeated.docs.select(*cols).mapInArrow(reads, READ)
    if hot_anchors(repeated):
        got = written(got, "reads")
        w = got.filter("h is null").select("bytes", "k1", "k2", F.col("first").alias("s"), "copies")
        twice = w.groupBy("bytes").agg(F.sum("copies").alias("many")).filter("many > 1").select("bytes")
        extra = w.join(twice, "bytes").select("k1", "k2", "s", (F.col("s") + span).cast("int").alias("e"))
        got = got.filter("h is not null")
    else:
        extra = None
    spans = got.repartition("h").sortWithinPartitions("h").mapInArrow(compare, SPANS)
    return spans if extra is None else spans.unionByName(extra)


def hot_anchors(repeated: Repeated) -> bool:
    """Whether any anchor needs the way by digests; known on the driver only
    if the hashes were broadcast."""
    return repeated.shared is None or len(repeated.shared.value[1]) > 0


def without_repeats(docs: DataFrame, span: int = SPAN, gram: int = GRAM, limit: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, spans (array<int>, flattened pairs) and text of all documents."""
    t = keyed(docs)
    return with_spans(t, repeated_spans(t, span, gram, limit, hot), ["k1", "k2"])


def kept(raw: bytes, spans: list[int]) -> bytes:
    edges = [0, *spans, len(raw)]
    return b"".join(raw[a:b] for a, b in zip(edges[::2], edges[1::2]))


def digest(found: DataFrame) -> DataFrame:
    def run(batches):
        for part, raw in texts(batches):
            spans = part.column(2).to_pylist()
            gone = [sum(s[1::2]) - sum(s[::2]) for s in spans]
            sha = [hashlib.sha256(kept(t, s)).hexdigest() for t, s in zip(raw, spans)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(map(len, raw), pa.int64()), pa.array(gone, pa.int64()), pa.array([len(s) // 2 for s in spans], pa.int64()), pa.array(sha, pa.string())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")


def cleaned(found: DataFrame) -> DataFrame:
    """(doc_id, text): the texts without their repeats; a character of which a
    part is removed is replaced."""

    def run(batches):
        for part, raw in texts(batches):
            out = [kept(t, s).decode("utf-8", "replace") for t, s in zip(raw, part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def op8_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(without_repeats(documents(spark, sf_dir)))
