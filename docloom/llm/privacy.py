"""Personal data: fixed patterns, and terms that give protected entities away.

The entities are the e-mail addresses, IP addresses, card and phone numbers the
patterns find. How strongly a term t reveals an entity e follows from corpus
co-occurrence: PMI(t, e) = log2 p(t, e) / (p(t) p(e)), as a share of what there
is to reveal, IC(e) = -log2 p(e). p(t) and p(e) count the different texts of the
whole corpus, p(t, e) those in which t stands near e; t is taken to be in SMOOTH
texts more than it was seen in. A term at or above ``DISCLOSURE`` is removed
(generalised to its kind) in every document that mentions e. Different texts
are counted, not rows, so that copies of one text don't make its words revealing.

Defined results: null and empty texts have no spans; a very long text is
searched as a whole; positions are code points; repeated rows, and rows that
share a null ``doc_id``, are treated by their texts; spans of one kind don't
overlap; a share of exactly ``DISCLOSURE`` is enough; extra columns are ignored
by the spans and kept by :func:`sanitised`; an empty table gives an empty result.
"""

from __future__ import annotations

import bisect
import hashlib
import re
from collections import Counter

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, digests, documents, keyed, sized_join, table_bytes, texts, written

KINDS = ("email", "ip", "card", "phone")
#: Terms within so many words of a mention are its context.
NEAR = 6
DISCLOSURE = 0.8
#: Documents that each term is taken to be in besides those it was seen in.
SMOOTH = 2.0
REVEALS = "_docloom_reveals"

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)+")
# a match can only begin where a run of digits does
_IP = re.compile(r"(?<![0-9])[0-9]++((?:\.[0-9]++){3})")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_TERM = re.compile(r"[^\W\d_]{3,}")
_DIGIT = re.compile(r"[^0-9]+")
_DOUBLE = [sum(divmod(2 * d, 10)) for d in range(10)]


def luhn(digits: str) -> bool:
    d = [ord(c) - 48 for c in reversed(digits)]
    return (sum(d[::2]) + sum(_DOUBLE[x] for x in d[1::2])) % 10 == 0


def emails(t: str) -> list[tuple[int, int]]:
    out, end, p = [], 0, t.find("@")
    while p >= 0:
        s = p
        while s > end and t[s - 1] in _LOCAL:
            s -= 1
        m = _DOMAIN.match(t, p + 1) if s < p else None
        if m:
            out.append((s, m.end()))
            end = m.end()
        p = t.find("@", max(p + 1, end))
    return out


def base_spans(t: str) -> list[list[tuple[int, int]]]:
    """Spans by kind, in the order of KINDS."""
    found: list[list[tuple[int, int]]] = [emails(t) if "@" in t else [], [], [], []]
    for m in _IP.finditer(t):
        if all(len(x := part.lstrip("0")) <= 3 and int(x or 0) <= 255 for part in m.group().split(".")):
            found[1].append(m.span())
    for m in _CARD.finditer(t):
        if m.end() - m.start() >= 16:
            digits = _DIGIT.sub("", m.group())
            if 16 <= len(digits) <= 19 and luhn(digits):
                found[2].append(m.span())
    if "+" in t:
        for m in _PHONE.finditer(t):
            if 8 <= len(_DIGIT.sub("", m.group())) <= 15:
                found[3].append(m.span())
    return found


def normal(kind: int, value: str) -> str:
    return value.lower() if kind == 0 else value if kind == 1 else _DIGIT.sub("", value)


def terms(t: str, spans: list[list[tuple[int, int]]]) -> list[tuple[int, int, str]]:
    """Words outside of all spans: (start, end, lower case)."""
    hidden = sorted(s for kind in spans for s in kind)
    out, k = [], 0
    for m in _TERM.finditer(t):
        while k < len(hidden) and hidden[k][1] <= m.start():
            k += 1
        if not any(a < m.end() and m.start() < b for a, b in hidden[k : k + 4]):
            out.append((m.start(), m.end(), m.group().lower()))
    return out


def mentions(t: str) -> list[tuple[int, str]]:
    """(entity, term) for the terms near each mention, and an empty term for
    the mention itself; entities as 64-bit hashes."""
    spans = base_spans(t)
    if not any(spans):
        return []
    words = terms(t, spans)
    starts = [w[0] for w in words]
    out = []
    for kind, found in enumerate(spans):
        for a, b in found:
            entity = hash64(f"{kind}:{normal(kind, t[a:b])}")
            at = bisect.bisect_left(starts, a)
            near = words[max(0, at - NEAR) : at + NEAR]
            out.append((entity, ""))
            out += [(entity, w) for w in {w for *_, w in near}]
    return out


def hash64(s: str) -> int:
    return int.from_bytes(xxhash.xxh64_digest(s.encode()), "little", signed=True)


def disclosing(docs: DataFrame, near: DataFrame, disclosure: float = DISCLOSURE, smooth: float = SMOOTH, limit: int = BROADCAST_BYTES) -> DataFrame:
    """(entity, term) above the threshold. ``docs``: text, k1, k2. ``near``:
    k1, k2, entity, term of all mentions; an empty term stands for the mention
    itself."""
    pairs = written(near.groupBy("entity", "term").agg(F.count("*").alias("together")), "pairs")
    wanted = written(pairs.filter("term <> ''").select("term").distinct(), "terms")
    small = table_bytes(wanted) <= limit
    chosen = docs.sparkSession.sparkContext.broadcast(frozenset(r[0] for r in wanted.collect()) if small else None)
    copies = written(docs.groupBy("k1", "k2").agg(F.count("*").alias("copies")), "copies")
    repeated = written(copies.filter("copies > 1"), "repeated")

    def count(batches):
        for part, raw in texts(batches):
            pick, n = chosen.value, Counter()
            for t, c in zip(raw, part.column(1).to_pylist()):
                w = {x.lower() for x in set(_TERM.findall(t.decode("utf-8", "replace")))}
                for x in w if pick is None else w & pick:
                    n[x] += 1 / c
            yield pa.RecordBatch.from_arrays([pa.array(list(n), pa.string()), pa.array(list(n.values()), pa.float64())], names=["term", "n"])

    # each of c copies counts 1/c, which rounding the sum makes whole again, so texts needn't be shuffled
    weighed = sized_join(docs, repeated, ["k1", "k2"], "left").select("text", F.coalesce("copies", F.lit(1)).alias("copies"))
    spread = weighed.mapInArrow(count, "term string, n double").groupBy("term").agg(F.round(F.sum("n")).alias("n")).join(wanted, "term", "left_semi")
    own = pairs.filter("term = ''").select("entity", F.col("together").alias("mentions"))
    got = pairs.filter("term <> ''").join(spread, "term").join(own, "entity")
    total = F.lit(float(max(2, copies.count())))
    # a term counts at least as often as it was seen near the entity
    apart = F.greatest(F.col("n"), F.col("together")).cast("double")
    pmi = F.log2(F.col("together") * total / ((apart + smooth) * F.col("mentions")))
    content = F.log2(total / F.col("mentions"))
    return got.filter((content > 0) & (pmi >= disclosure * content)).select("entity", "term")


def found_spans(docs: DataFrame, disclosure: float = DISCLOSURE, smooth: float = SMOOTH, limit: int = BROADCAST_BYTES) -> DataFrame:
    """``docs`` (as it is) with a last column, the terms to remove."""
    t = keyed(docs)

    def mention(batches):
        for part, raw in texts(batches):
            k1, k2 = part.column(0).to_pylist(), part.column(1).to_pylist()
            rows = [(a, b, *m) for a, b, t in zip(k1, k2, raw) for m in mentions(t.decode("utf-8", "replace"))]
            cols = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, (pa.int64(), pa.int64(), pa.int64(), pa.string()))], names=["k1", "k2", "entity", "term"])

    near = written(t.select("k1", "k2", "text").mapInArrow(mention, "k1 long, k2 long, entity long, term string").distinct(), "mentions")
    open_ = written(disclosing(t, near, disclosure, smooth, limit), "disclosing")
    own = near.filter("term = ''").select("k1", "k2", "entity").distinct().join(open_, "entity")
    per = written(own.groupBy("k1", "k2").agg(F.collect_set("term").alias("reveals")), "reveals")
    per = per.toDF("_docloom_k1", "_docloom_k2", "_docloom_reveals")
    key = docs.select("*", *digests(("_docloom_k1", "_docloom_k2")))
    return sized_join(key, per, ["_docloom_k1", "_docloom_k2"], "left").select(*docs.columns, F.col("_docloom_reveals").alias(REVEALS))


def all_spans(t: str, reveals) -> tuple[list[list[tuple[int, int]]], list[tuple[int, int]]]:
    spans = base_spans(t)
    if not reveals:
        return spans, []
    gone = set(reveals)
    return spans, [(a, b) for a, b, w in terms(t, spans) if w in gone]


def digest(found: DataFrame) -> DataFrame:
    def run(batches):
        for part, raw in texts(batches):
            rows = []
            for doc_id, t, reveals in zip(part.column(0).to_pylist(), raw, part.column(2).to_pylist()):
                spans, extra = all_spans(t.decode("utf-8", "replace"), reveals)
                base = [f"{k}:{a}:{b}" for k, s in zip(KINDS, spans) for a, b in s]
                both = ",".join(base + [f"term:{a}:{b}" for a, b in extra])
                rows.append((doc_id, *map(len, spans), hashlib.sha256(",".join(base).encode()).hexdigest(), both))
            cols = list(zip(*rows))
            yield pa.RecordBatch.from_arrays([pa.array(c, x) for c, x in zip(cols, [pa.int64()] * 5 + [pa.string()] * 2)], names=["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"])

    some = found.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"), REVEALS)
    return some.mapInArrow(run, "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


def redact(t: str, reveals=()) -> str:
    """Every span replaced by its kind; of overlapping ones the first."""
    spans, extra = all_spans(t, reveals)
    marks = sorted((a, b, k) for k, s in zip((*KINDS, "term"), (*spans, extra)) for a, b in s)
    out, at = [], 0
    for a, b, k in marks:
        if a >= at:
            out += [t[at:a], f"[{k.upper()}]"]
        at = max(at, b)
    return "".join([*out, t[at:]])


def sanitised(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with personal data and revealing terms replaced in ``text``;
    null texts stay null."""
    found = found_spans(docs, **how)
    at = docs.columns.index("text")

    def run(batches):
        for part, raw in texts(batches):
            new = [redact(t.decode("utf-8", "replace"), r) if ok else None for t, r, ok in zip(raw, part.column(part.num_columns - 1).to_pylist(), part.column(at).is_valid().to_pylist())]
            cols = [pa.array(new, pa.string()) if i == at else part.column(i) for i in range(part.num_columns - 1)]
            yield pa.RecordBatch.from_arrays(cols, names=part.schema.names[:-1])

    return found.mapInArrow(run, docs.schema)


def op4_information_theoretic_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(found_spans(documents(spark, sf_dir)))
