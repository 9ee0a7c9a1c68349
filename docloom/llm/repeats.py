"""Where long passages may repeat: content-defined anchors.

Of every window of ``span`` symbols (bytes, words) the ``k``-gram with the
least hash is an anchor. Equal windows have equal anchors at equal offsets, so a
window repeats only if its anchor does, and whatever repeats is found by
comparing the surroundings of equal anchors. One in about ``(span - k) / 2``
symbols is an anchor; only their hashes are counted over the corpus.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, chunks, sized_join, table_bytes, written

#: An anchor with more occurrences than this isn't gathered in one task: its
#: windows are compared by 128-bit digests, which Spark aggregates map-side.
HOT = 1 << 16
#: Bytes of text at a time: hashes and minima take some 100 times as much.
SLICE = 1 << 19
#: Symbols of one text at a time, for the same reason.
PART = 1 << 20

_BASE = 0xD6E8FEB86659FD93
_INVERSE = pow(_BASE, -1, 1 << 64)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
SPACE = np.zeros(256, bool)
SPACE[[32, *range(9, 14)]] = True
_powers: list[np.ndarray] = []


def _tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or len(_powers[0]) < n:
        m = 1 << max(20, int(n - 1).bit_length())
        _powers[:] = [np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(m - 1, b, np.uint64)))) for b in (_BASE, _INVERSE)]
    return _powers[0][:n], _powers[1][:n]


def _mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def range_hashes(symbols: np.ndarray, start: np.ndarray | slice, end: np.ndarray | slice) -> np.ndarray:
    """Polynomial hashes of symbols[start:end], for arrays of ascending bounds.
    Those of a very long text are worked on in parts, as hashes don't depend on
    where a range lies."""
    if not isinstance(start, slice) and len(symbols) > 2 * PART and len(start) > 1:
        out, i = [], 0
        while i < len(start):
            j = max(i + 1, int(np.searchsorted(end, start[i] + PART, "right")))
            a = int(start[i])
            out.append(range_hashes(symbols[a : int(end[j - 1])], start[i:j] - a, end[i:j] - a))
            i = j
        return np.concatenate(out)
    up, down = _tables(len(symbols) + 1)
    total = np.zeros(len(symbols) + 1, np.uint64)
    np.cumsum(symbols * up[:-1], out=total[1:])
    return _mix((total[end] - total[start]) * down[start])


def gram_hashes(symbols: np.ndarray, k: int) -> np.ndarray:
    return range_hashes(symbols, slice(0, len(symbols) - k + 1), slice(k, len(symbols) + 1))


def byte_symbols(data: np.ndarray) -> np.ndarray:
    return _BYTE[data]


def words_of(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (bytes), and the documents' bounds in words."""
    inside = ~SPACE[data]
    before = np.append(False, inside[:-1])
    cut = off[(off > 0) & (off < len(data))]
    before[cut] = False
    after = np.append(inside[1:], False)
    after[cut - 1] = False
    starts, ends = np.flatnonzero(inside & ~before), np.flatnonzero(inside & ~after) + 1
    return starts, ends, np.searchsorted(starts, off)


def slide(a: np.ndarray, w: int, f) -> np.ndarray:
    """``f`` (minimum, maximum) over every ``w`` neighbours."""
    n = 1
    while 2 * n <= w:
        a = f(a[:-n], a[n:])
        n *= 2
    return f(a[: len(a) - (w - n)], a[w - n :]) if n < w else a


def anchors(symbols: np.ndarray, off: np.ndarray, span: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(position, hash, first, last): every anchor, and the first and the last
    window (by start) of which it is one. ``off``: documents' bounds."""
    none = np.zeros(0, np.int64)
    n, w = len(symbols), span - k + 1
    if n > 2 * PART:  # windows by their starts; parts overlap by a window
        found = []
        for a in range(0, n, PART):
            b = min(a + PART + span - 1, n)
            inner = off[(off > a) & (off < b)]
            found.append([x + a if i != 1 else x for i, x in enumerate(anchors(symbols[a:b], np.concatenate(([0], inner - a, [b - a])), span, k))])
        return tuple(np.concatenate(c) for c in zip(*found))
    fits = off[1:] - off[:-1] >= span
    if n < span or not fits.any():
        return none, none.astype(np.uint64), none, none
    h = gram_hashes(symbols, k) | np.uint64(1)
    least = slide(h, w, np.minimum)
    edge = np.zeros(len(least) + 1, np.int32)
    np.add.at(edge, off[:-1][fits], 1)
    np.add.at(edge, off[1:][fits] - span + 1, -1)
    least = np.where(np.cumsum(edge[:-1]) > 0, least, np.uint64(0))  # 0: the window crosses documents
    pad = np.zeros(w - 1, np.uint64)
    at = np.flatnonzero(slide(np.concatenate((pad, least, pad)), w, np.maximum) == h)
    # runs of windows with the same least hash; an anchor's windows are part of one
    run = np.flatnonzero(np.append(True, least[1:] != least[:-1]))
    end = np.append(run[1:], len(least)) - 1
    r = np.searchsorted(run, np.maximum(at - w + 1, 0), "right") - 1
    open_ = np.arange(len(at))
    while len(open_):
        open_ = open_[least[run[r[open_]]] != h[at[open_]]]
        r[open_] += 1
    return at, h[at], np.maximum(run[r], at - w + 1), np.minimum(end[r], at)


def is_in(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    if not len(table):
        return np.zeros(len(values), bool)
    return table[np.minimum(np.searchsorted(table, values), len(table) - 1)] == values


class Repeated:
    """The anchors that occur more than once in a corpus.

    ``found(hashes)`` -> (repeated, hot) inside a task. If their hashes are few
    enough to broadcast, they are; otherwise each document gets its own by a
    shuffled join (columns ``again`` and ``hot``)."""

    def __init__(self, docs: DataFrame, find, limit: int = BROADCAST_BYTES, hot: int = HOT, once: bool = False):
        """``find(data, off)`` -> anchors of a chunk and their documents.
        ``once``: an anchor repeats only if it is in several documents; whether
        it is hot depends on all its occurrences in any case."""

        def count(batches):
            for _, data, off in chunks(batches, limit=SLICE):
                h, doc = find(data, off)
                u, n = np.unique(h, return_counts=True)
                cols = [pa.array(u.view(np.int64)), pa.array(n.astype(np.int32))]
                if once:
                    order = np.lexsort((doc, h))
                    x, d = h[order], doc[order]
                    new = np.append(True, (x[1:] != x[:-1]) | (d[1:] != d[:-1])) if len(x) else np.zeros(0, bool)
                    cols.append(pa.array(np.diff(np.append(np.flatnonzero(np.append(True, x[new][1:] != x[new][:-1])), new.sum())).astype(np.int32) if len(x) else np.zeros(0, np.int32)))
                yield pa.RecordBatch.from_arrays(cols, names=["h", "n", "m"][: len(cols)])

        t = docs.select("text")
        rep = t.mapInArrow(count, "h long, n int" + ", m int" * once).groupBy("h").agg(F.sum("n").alias("n"), F.sum("m" if once else "n").alias("m"))
        rep = rep.filter("m > 1").select("h", (F.col("n") > hot).alias("hot"))
        rep = written(rep, "repeated")
        self.docs, self.shared = docs, None
        if rep.count() * 9 <= limit:
            got = rep.toArrow()
            h, is_hot = got.column("h").to_numpy(), got.column("hot").to_numpy()
            self.shared = docs.sparkSession.sparkContext.broadcast((np.sort(h.view(np.uint64)), np.sort(h[is_hot.astype(bool)].view(np.uint64))))
            return

        def where(batches):
            for part, data, off in chunks(batches, limit=SLICE):
                h, doc = find(data, off)
                pair = np.unique(np.stack((doc.astype(np.int64), h.view(np.int64))), axis=1) if len(h) else np.zeros((2, 0), np.int64)
                d = pa.array(pair[0])
                yield pa.RecordBatch.from_arrays([part.column(1).take(d), part.column(2).take(d), pa.array(pair[1])], names=["k1", "k2", "h"])

        own = docs.select("text", "k1", "k2").mapInArrow(where, "k1 long, k2 long, h long").join(rep, "h")
        own = own.groupBy("k1", "k2").agg(F.collect_set("h").alias("again"), F.collect_set(F.when(F.col("hot"), F.col("h"))).alias("hot"))
        self.docs = docs.join(own, ["k1", "k2"])

    def found(self):
        """A function of a slice and its anchors' hashes, for use in tasks."""
        shared = self.shared

        def look(part: pa.RecordBatch, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            if shared is not None:
                again, hot = shared.value
            else:
                again, hot = (np.unique(part.column(part.schema.get_field_index(c)).flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)) for c in ("again", "hot"))
            return is_in(h, again), is_in(h, hot)

        return look


def merged_spans(spans: DataFrame, key: list[str]) -> DataFrame:
    """Spans (key, s, e) united per key: ``spans`` array<int> s0, e0, s1, e1..."""
    lists = spans.distinct().groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("s", "e"))).alias("spans"))
    step = lambda acc, x: F.when(
        F.element_at(acc, -1) >= x["s"],
        F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.greatest(F.element_at(acc, -1), x["e"]))),
    ).otherwise(F.concat(acc, F.array(x["s"], x["e"])))
    first = F.array(F.col("spans")[0]["s"], F.col("spans")[0]["e"])
    return lists.withColumn("spans", F.aggregate("spans", first, step))


def with_spans(docs: DataFrame, spans: DataFrame, key: list[str]) -> DataFrame:
    """``docs`` with the united spans of each, empty for most."""
    spans = written(merged_spans(spans, key), "spans")
    return sized_join(docs, spans, key, "left").withColumn("spans", F.coalesce("spans", F.array().cast("array<int>")))
