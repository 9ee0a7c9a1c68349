"""Best-fit packing of tokenised documents into sequences of fixed length.

Pieces longer than a third of the capacity are matched greedily, at most two
to a sequence; all others go, longest first, into the fullest sequence that
still holds them. Both steps work on the *counts* of pieces by length, of which
there are at most ``capacity``: the plan's size doesn't depend on the corpus,
and the pieces themselves are only numbered within their length (in hashed
blocks) and looked up in the plan. The text is read once and never shuffled.

Defined results: a null text counts as empty (one piece, the end id alone); a
text of any length is cut only if it has more than ``capacity`` ids; repeated
rows are packed each for itself; an empty table gives an empty result; further
columns are ignored; a null ``doc_id`` is kept, and its pieces come last of their
length; equally long pieces are told apart by a hash of id, piece and ids; the literal ``<|endoftext|>`` in
a text is that token, as in the vocabulary's tokenizer file.
"""

from __future__ import annotations

import base64
import bisect
import zlib
from collections.abc import Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import documents, rank_within, text_bytes, texts, written

CAPACITY = 2048
END_ID = 0
SPECIAL = "<|endoftext|>"
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = PIECES + ", sequence_id long, offset long"


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file installed on driver and executors."""
    import public_tokenizers

    return str(public_tokenizers.path(name))


_encoders: dict = {}


def encoder(path: str, special: bool = False):
    """``encode(text) -> list of ids`` for a rank file (.tiktoken) or a
    tokenizer file (.json); strings of special tokens are ordinary text, or with
    ``special`` those tokens (in a rank file, ``SPECIAL`` follows the ranks)."""
    key = path, special
    if key not in _encoders:
        if path.endswith(".json"):
            from tokenizers import Tokenizer

            t = Tokenizer.from_file(path)
            t.encode_special_tokens = not special
            _encoders[key] = lambda s: t.encode(s, add_special_tokens=False).ids
        else:
            import public_tokenizers
            import tiktoken

            with open(path, "rb") as f:
                ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
            e = tiktoken.Encoding("public", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={SPECIAL: max(ranks.values()) + 1} if special else {})
            _encoders[key] = (lambda s: e.encode(s, allowed_special="all") if SPECIAL in s else e.encode_ordinary(s)) if special else e.encode_ordinary
    return _encoders[key]


def cut(n: int, capacity: int) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``n`` ids; only the first is short."""
    first = n % capacity or capacity
    return [(0, first), *((s, capacity) for s in range(first, n, capacity))]


def token_pieces(docs: DataFrame, vocab: str, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """One row per piece, with a checksum of its ids; a map over the text."""

    def run(batches):
        encode = encoder(vocab, special=True)
        for part, raw in texts(batches):
            ids_of = part.column(0).to_pylist()
            rows: list[list] = [[], [], [], [], []]
            for doc_id, text in zip(ids_of, raw):
                ids = encode(text.decode("utf-8", "replace"))
                ids.append(end_id)
                packed = np.asarray(ids, "<u4").tobytes()
                for k, (start, length) in enumerate(cut(len(ids), capacity)):
                    for col, v in zip(rows, (doc_id, k, start, length, zlib.crc32(packed[4 * start : 4 * (start + length)]))):
                        col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(rows[0], pa.int64()), pa.array(rows[1], pa.int32()), *(pa.array(c, pa.int64()) for c in rows[2:])], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_bytes().alias("text")).mapInArrow(run, PIECES)


def plan_packing(counts: Mapping[int, int], capacity: int = CAPACITY) -> np.ndarray:
    """Where the pieces of each length go, from their counts alone.

    Rows (length, first rank, ranks, first sequence, offset): of the pieces of
    that length, those ranked from ``first rank`` on go to sequences from
    ``first sequence`` on, one each, at ``offset``. Sequences with the same
    contents are kept as one group, so the plan has a bounded size."""
    left = {int(k): int(v) for k, v in counts.items() if v > 0}
    used = dict.fromkeys(left, 0)
    by_gap: dict[int, list] = {}  # gap -> groups [how many sequences, slots [(length, first rank, offset)]]
    gaps: list[int] = []

    def put(gap: int, many: int, slots: list) -> None:
        if gap not in by_gap:
            by_gap[gap] = []
            bisect.insort(gaps, gap)
        by_gap[gap].append([many, slots])

    def take(length: int, many: int) -> int:
        first = used[length]
        used[length] += many
        left[length] -= many
        return first

    large = sorted((x for x in left if 3 * x > capacity), reverse=True)
    ascending = large[::-1]
    for a in large:
        while left[a]:
            k = bisect.bisect_right(ascending, min(a, capacity - a)) - 1
            while k >= 0 and not left[ascending[k]]:
                ascending.pop(k)
                k -= 1
            b = ascending[k] if k >= 0 else 0
            if b == a and left[a] == 1:
                b = next((x for x in reversed(ascending[:k]) if left[x]), 0)
            if not b:
                many = left[a]
                put(capacity - a, many, [(a, take(a, many), 0)])
            elif b == a:
                many = left[a] // 2
                first = take(a, 2 * many)
                put(capacity - 2 * a, many, [(a, first, 0), (a, first + many, a)])
            else:
                many = min(left[a], left[b])
                put(capacity - a - b, many, [(a, take(a, many), 0), (b, take(b, many), a)])
    for x in sorted((x for x in left if 3 * x <= capacity), reverse=True):
        while left[x]:
            k = bisect.bisect_left(gaps, x)
            if k == len(gaps):
                each = min(capacity // x, left[x])
                many = left[x] // each
                first = take(x, each * many)
                put(capacity - each * x, many, [(x, first + i * many, i * x) for i in range(each)])
                continue
            gap = gaps[k]
            groups = by_gap[gap]
            many, slots = groups[-1]
            here = min(many, left[x])
            placed = [*slots, (x, take(x, here), capacity - gap)]
            if here == many:
                groups.pop()
                if not groups:
                    del by_gap[gap]
                    gaps.pop(k)
            else:
                groups[-1] = [many - here, [(ln, r + here, o) for ln, r, o in slots]]
            put(gap - x, here, placed)
    rows, sequence = [], 0
    for gap in gaps:
        for many, slots in by_gap[gap]:
            rows += [(ln, first, many, sequence, off) for ln, first, off in slots]
            sequence += many
    return np.array(sorted(rows), np.int64).reshape(-1, 5)


def place(ranked: DataFrame, plan: np.ndarray) -> DataFrame:
    """Looks the pieces, numbered by ``rank`` within their length, up."""
    shared = ranked.sparkSession.sparkContext.broadcast(plan)

    def run(batches):
        p = shared.value
        where = p[:, 0] << 44 | p[:, 1]
        for b in batches:
            length, rank = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "rank"))
            k = np.searchsorted(where, length << 44 | rank, "right") - 1
            cols = [b.column(i) for i in range(5)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(p[k, 3] + rank - p[k, 1]), pa.array(p[k, 4])], names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"])

    return ranked.select("doc_id", "piece", "start", "length", "ids_crc32", "rank").mapInArrow(run, PACKED)


def pack(docs: DataFrame, vocab: str | None = None, capacity: int = CAPACITY, end_id: int = END_ID) -> DataFrame:
    """All of ``docs`` (doc_id, text) packed; see the module's text."""
    pieces = token_pieces(docs, vocab or vocabulary("byte_bpe_50k.tiktoken"), capacity, end_id)
    pieces = written(pieces.withColumn("salt", F.monotonically_increasing_id()), "pieces")
    counts = {r[0]: r[1] for r in pieces.groupBy("length").count().collect()}  # at most `capacity` rows
    return place(rank_within(pieces, ["length"], ["doc_id", "piece", "ids_crc32"], salt="salt"), plan_packing(counts, capacity))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))
