"""Substring dedup by suffix automata and matching statistics.

Windows of 13 words that also start in a document with a smaller ``doc_id`` are
found with suffix automata of reference shards. A shard holds the surroundings
of repeated anchors (see repeats.py) by the anchors' hashes, so documents need
only be streamed through the shards their own anchors name. (An automaton of
the whole corpus has no size bound and can't be broadcast; what is broadcast,
size-checked, is the list of repeated anchors.) Each state of an automaton
carries the smallest ``doc_id`` in which its strings start; the matching
statistics of a read give, for the last 13 words at each position, the state
and with it the first document that has them.

Defined results: a null text has no words; a very long text is streamed in
slices of its anchors, and an anchor that repeats within it counts each time; documents of fewer than 13 words stay
whole; of equal texts that of the least id is kept; rows that repeat one
``doc_id`` don't remove each other; a null ``doc_id`` counts as larger than all
others; extra columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, chunks, documents, keyed, texts, written
from .repeats import HOT, SLICE, Repeated, anchors, byte_symbols, range_hashes, with_spans, words_of
from .suffix_array import hot_anchors

WINDOW = 13
GRAM = 5
LAST = (1 << 63) - 1  # the rank of a null doc_id

READ = "h long, rank long, k1 long, k2 long, first int, words binary"
SPANS = "rank long, k1 long, k2 long, s int, e int"


class SuffixAutomaton:
    """Of several strings (lists of hashable symbols), built online."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.least = [-1], [0], [LAST]

    def add(self, string, rank: int) -> None:
        nxt, link, length, least = self.next, self.link, self.length, self.least
        last = 0
        for c in string:
            q = nxt[last].get(c)
            if q is not None:
                last = q if length[q] == length[last] + 1 else self._clone(last, c, q)
            else:
                new, p = len(nxt), last
                nxt.append({})
                length.append(length[last] + 1)
                link.append(0)
                least.append(LAST)
                while p >= 0 and c not in nxt[p]:
                    nxt[p][c] = new
                    p = link[p]
                if p >= 0:
                    q = nxt[p][c]
                    link[new] = q if length[q] == length[p] + 1 else self._clone(p, c, q)
                last = new
            if rank < least[last]:
                least[last] = rank

    def _clone(self, p: int, c, q: int) -> int:
        nxt, link, length = self.next, self.link, self.length
        new = len(nxt)
        nxt.append(dict(nxt[q]))
        length.append(length[p] + 1)
        link.append(link[q])
        self.least.append(LAST)
        link[q] = new
        while p >= 0 and nxt[p].get(c) == q:
            nxt[p][c] = new
            p = link[p]
        return new

    def finish(self) -> None:
        """Hands the least ranks down to the suffixes of each state's strings."""
        least, link = self.least, self.link
        for v in sorted(range(1, len(link)), key=self.length.__getitem__, reverse=True):
            if least[v] < least[link[v]]:
                least[link[v]] = least[v]

    def firsts(self, string, window: int) -> list[int]:
        """For the window that ends at each position from window - 1 on: the
        least rank of a string that has it, LAST if none."""
        nxt, link, length = self.next, self.link, self.length
        out, v, n = [], 0, 0
        for k, c in enumerate(string):
            while v and c not in nxt[v]:
                v = link[v]
                n = length[v]
            q = nxt[v].get(c)
            v, n = (q, n + 1) if q is not None else (0, 0)
            while v and length[link[v]] >= window:
                v = link[v]
                n = length[v]
            if k >= window - 1:
                out.append(self.least[v] if n >= window else LAST)
        return out


def runs(flags: list[bool]) -> list[tuple[int, int]]:
    edge = np.flatnonzero(np.diff(np.concatenate(([0], np.array(flags, np.int8), [0]))))
    return [(int(a), int(b)) for a, b in edge.reshape(-1, 2)]


def read_spans(h: list[int], rank: list[int], words: list[bytes], window: int = WINDOW) -> list[list[tuple[int, int]]]:
    """For every read (sorted by anchor) the spans, in words from its start,
    that start in a read of smaller rank too."""
    out: list[list[tuple[int, int]]] = []
    i = 0
    while i < len(h):
        j = i + 1
        while j < len(h) and h[j] == h[i]:
            j += 1
        best: dict[bytes, int] = {}
        for r, w in zip(rank[i:j], words[i:j]):
            if r < best.get(w, LAST + 1):
                best[w] = r
        if len(best) == 1:
            ((only, low),) = best.items()
            firsts = {only: [low] * (only.count(b" ") + 2 - window)}
        else:
            sam, split = SuffixAutomaton(), {w: w.split(b" ") for w in best}
            for w, s in split.items():
                sam.add(s, best[w])
            sam.finish()
            firsts = {w: sam.firsts(s, window) for w, s in split.items()}
        for r, w in zip(rank[i:j], words[i:j]):
            flags = [f < r for f in firsts[w]]
            out.append([(a, b - 1 + window) for a, b in runs(flags)] if any(flags) else [])
        i = j
    return out


def joined(raw: bytes) -> bytes:
    return b" ".join(raw.split())


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
    """Spans (rank, k1, k2, s, e) in words of the ``keyed`` documents, ``rank``
    being their ``doc_id``."""

    def word_anchors(data, off):
        starts, ends, bounds = words_of(data, off)
        symbols = range_hashes(byte_symbols(data), starts, ends) if len(starts) else np.zeros(0, np.uint64)
        at, h, lo, hi = anchors(symbols, bounds, window, gram)
        return starts, ends, bounds, at, h, lo, hi, np.searchsorted(bounds, at, "right") - 1

    def find(data, off):
        return word_anchors(data, off)[4::3]

    repeated = Repeated(docs, find, limit, hot, once=True)
    look = repeated.found()

    def reads(batches):
        for part, data, off in chunks(batches, limit=SLICE):
            rank, k1, k2 = (part.column(i).to_numpy() for i in range(3))
            starts, ends, bounds, at, h, lo, hi, doc = word_anchors(data, off)
            again, is_hot = look(part, h)
            # of copies within the slice only the one of least rank is read; the others go entirely
            least = np.lexsort((rank, k2, k1))
            new = np.append(True, (k1[least][1:] != k1[least][:-1]) | (k2[least][1:] != k2[least][:-1]))
            head = np.empty(len(least), np.int64)
            head[least] = least[np.maximum.accumulate(np.where(new, np.arange(len(least)), 0))]
            copy = np.flatnonzero((rank > rank[head]) & (np.diff(bounds) >= window))
            use = np.flatnonzero(again & (head[doc] == doc))
            use = use[np.argsort(h[use], kind="stable")]
            raw, d = data.tobytes(), doc[use]
            cold = ~is_hot[use]
            a, b = starts[lo[use]], ends[hi[use] + window - 1]
            body = [joined(raw[x:y]) for x, y in zip(a[cold].tolist(), b[cold].tolist())]
            first = (lo[use] - bounds[d]).astype(np.int32)
            extra: list[list] = [[], [], [], [], [], []]
            for i in np.flatnonzero(~cold).tolist():
                for s in range(int(lo[use[i]]), int(hi[use[i]]) + 1):
                    g = xxhash.xxh3_128_digest(joined(raw[starts[s] : ends[s + window - 1]]))
                    for col, v in zip(extra, (None, int(rank[d[i]]), int(k1[d[i]]), int(k2[d[i]]), s - int(bounds[d[i]]), g)):
                        col.append(v)
            for i in copy.tolist():  # a span without words: -length
                for col, v in zip(extra, (None, int(rank[i]), int(k1[i]), int(k2[i]), int(bounds[i] - bounds[i + 1]), b"")):
                    col.append(v)
            types = [pa.int64()] * 4 + [pa.int32(), pa.binary()]
            cols = [h[use].view(np.int64)[cold], rank[d][cold], k1[d][cold], k2[d][cold], first[cold], body]
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([pa.array(c, t), pa.array(x, t)]) for c, t, x in zip(cols, types, extra)], names=["h", "rank", "k1", "k2", "first", "words"])

    def compare(batches):
        held: dict[str, list] = {}
        for b in batches:
            got = {n: b.column(i).to_pylist() for i, n in enumerate(b.schema.names)}
            held = {n: held.get(n, []) + v for n, v in got.items()}
            end = next((i for i in range(len(held["h"]) - 1, 0, -1) if held["h"][i] != held["h"][i - 1]), 0)
            if end:
                yield answer({n: v[:end] for n, v in held.items()})
                held = {n: v[end:] for n, v in held.items()}
        if held and held["h"]:
            yield answer(held)

    def answer(t):
        # whole-copy marks and hot windows come first, with a null anchor
        n = sum(x is None for x in t["h"])
        rows = [(r, a, b, 0, -f) for r, a, b, f in zip(t["rank"][:n], t["k1"], t["k2"], t["first"])]
        spans = read_spans(t["h"][n:], t["rank"][n:], t["words"][n:], window)
        rows += [(r, a, b, f + s, f + e) for r, a, b, f, found in zip(t["rank"][n:], t["k1"][n:], t["k2"][n:], t["first"][n:], spans) for s, e in found]
        cols = list(zip(*rows)) or [()] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (*[pa.int64()] * 3, pa.int32(), pa.int32()))], names=["rank", "k1", "k2", "s", "e"])

    cols = ["rank", "k1", "k2", "text"] + ([] if repeated.shared is not None else ["again", "hot"])
    got = written(repeated.docs.select(*cols).mapInArrow(reads, READ), "reads")
    whole = got.filter("h is null and first < 0").select("rank", "k1", "k2", F.lit(0).alias("s"), (-F.col("first")).alias("e"))
    spans = got.filter("h is not null").repartition("h").sortWithinPartitions("h").mapInArrow(compare, SPANS).unionByName(whole)
    if hot_anchors(repeated):
        w = got.filter("h is null and first >= 0").withColumnRenamed("words", "g")
        low = w.groupBy("g").agg(F.min("rank").alias("low"))
        spans = spans.unionByName(w.join(low, "g").filter("low < rank").select("rank", "k1", "k2", F.col("first").alias("s"), (F.col("first") + window).cast("int").alias("e")))
    return spans


def ranked(docs: DataFrame) -> DataFrame:
    return keyed(docs).withColumn("rank", F.coalesce("doc_id", F.lit(LAST)))


def without_known(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = BROADCAST_BYTES, hot: int = HOT) -> DataFrame:
    """doc_id, text and spans (in words; array<int>, flattened pairs)."""
    t = ranked(docs)
    return with_spans(t, repeated_spans(t, window, gram, limit, hot), ["rank", "k1", "k2"])


def kept_words(raw: bytes, spans: list[int]) -> tuple[int, list[bytes]]:
    words = raw.split()
    edges = [0, *spans, len(words)]
    return len(words), [w for a, b in zip(edges[::2], edges[1::2]) for w in words[a:b]]


def digest(found: DataFrame) -> DataFrame:
    def run(batches):
        for part, raw in texts(batches):
            left = [kept_words(t, s) for t, s in zip(raw, part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array([n for n, _ in left], pa.int64()), pa.array([n - len(w) for n, w in left], pa.int64()), pa.array([hashlib.sha256(b" ".join(w)).hexdigest() for _, w in left], pa.string())],
                names=["doc_id", "n_words", "n_removed", "kept_sha256"],
            )

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, n_words long, n_removed long, kept_sha256 string")


def cleaned(found: DataFrame) -> DataFrame:
    """(doc_id, text): the kept words, joined by one space."""

    def run(batches):
        for part, raw in texts(batches):
            out = [b" ".join(kept_words(t, s)[1]).decode("utf-8", "replace") for t, s in zip(raw, part.column(2).to_pylist())]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.string())], names=["doc_id", "text"])

    return found.select("doc_id", "text", "spans").mapInArrow(run, "doc_id long, text string")


def op10_automaton_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(without_known(documents(spark, sf_dir)))


ORACLE = r"""
WITH w AS (
  SELECT doc_id, coalesce(list_filter(string_split_regex(text, '[\x20\x09-\x0D]+'), lambda x: x <> ''), []) AS words FROM documents
), p AS (
  SELECT doc_id, words, unnest(range(1, greatest(len(words) - 11, 1)::BIGINT)) AS s FROM w
), g AS (
  SELECT doc_id, s, list_slice(words, s, s + 12) AS win FROM p
), low AS (
  SELECT win, min(doc_id) AS first FROM g GROUP BY win
), hit AS (
  SELECT DISTINCT doc_id, unnest(range(s, s + 13)) AS k FROM g JOIN low USING (win) WHERE first < doc_id
), gone AS (
  SELECT doc_id, list(k) AS ks FROM hit GROUP BY doc_id
)
SELECT w.doc_id, len(words)::BIGINT AS n_words, coalesce(len(ks), 0)::BIGINT AS n_removed,
  sha256(coalesce(array_to_string(list_filter(words, lambda x, i: ks IS NULL OR NOT list_contains(ks, i)), ' '), '')) AS kept_sha256
FROM w LEFT JOIN gone USING (doc_id)
"""
