"""SQL that states whole results of operators, for DuckDB."""

from __future__ import annotations

P1, P2, P3, P4, P5 = 0x9E3779B185EBCA87, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0x85EBCA77C2B2AE63, 0x27D4EB2F165667C5
TWO64 = f"{1 << 64}::UHUGEINT"
WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _u(n: int) -> str:
    return f"{n}::UHUGEINT"


def _mul(a: str, n: int) -> str:
    return f"(({a}) * {_u(n)} % {TWO64})"


def _add(a: str, b: str) -> str:
    return f"(({a}) + ({b})) % {TWO64}"


def _with(value: str, name: str, body: str) -> str:
    """``body`` with a name for ``value``, which is computed once."""
    return f"list_transform([{value}], lambda {name}: {body})[1]"


def _turn(a: str, n: int, name: str) -> str:
    return _with(a, name, f"({name} * {_u(1 << n)} % {TWO64} + {name} // {_u(1 << 64 - n)})")


def _xor(a: str, b: str) -> str:
    return f"xor(({a})::UBIGINT, ({b})::UBIGINT)::UHUGEINT"


def _round(acc: str, lane: str, name: str) -> str:
    return _mul(_turn(_add(acc, _mul(lane, P2)), 31, name), P1)


def _fold(first: str, items: str, step: str) -> str:
    """``step`` of acc and lane over a list of UHUGEINT."""
    return f"list_reduce(list_prepend(({first})::UHUGEINT, {items}), lambda acc, lane: ({step})::UHUGEINT)"


def _number(at: str, many: int) -> str:
    """Little-endian bytes of the hexadecimal ``x`` from byte ``at`` on."""
    return "('0x' || " + " || ".join(f"substr(x, 2 * ({at}) + {2 * k + 1}, 2)" for k in reversed(range(many))) + ")::UBIGINT::UHUGEINT"


def xxh64(seed: int) -> str:
    """Common table expressions that make ``hashed`` (sh, h) of ``shingles``
    (sh): XXH64 of the UTF-8 bytes, in steps."""
    lanes = f"list_transform(range(0, n // 8), lambda i: {_number('8 * i', 8)})"
    start = [(seed + P1 + P2) % 2**64, (seed + P2) % 2**64, seed, (seed - P1) % 2**64]
    v = [_fold(_u(s), f"list_transform(range(0, n // 32), lambda j: lanes[4 * j + {k + 1}])", _round("acc", "lane", "r")) for k, s in enumerate(start)]
    merged = _add(_add(_turn("v1", 1, "a"), _turn("v2", 7, "b")), _add(_turn("v3", 12, "c"), _turn("v4", 18, "d")))
    each = _add(_mul(_xor("acc", _round(_u(0), "lane", "r")), P1), _u(P4))
    eight = _add(_mul(_turn(_xor("acc", _round(_u(0), "lane", "r")), 27, "t"), P1), _u(P4))
    four = _add(_mul(_turn(_xor("h", _mul(_number("n // 8 * 8", 4), P1)), 23, "t"), P2), _u(P3))
    one = _mul(_turn(_xor("acc", _mul("lane", P5)), 11, "t"), P1)
    rest = f"list_transform(range(n // 4 * 4, n), lambda i: {_number('i', 1)})"
    shift = lambda n: _xor("h", f"h // {_u(1 << n)}")
    return f"""
x0 AS (SELECT DISTINCT sh, lower(hex(encode(sh))) AS x, octet_length(encode(sh)) AS n FROM shingles),
x1 AS (SELECT *, {lanes} AS lanes FROM x0),
x2 AS (SELECT *, {", ".join(f"{e} AS v{k}" for k, e in enumerate(v, 1))} FROM x1),
x3 AS (SELECT *, CASE WHEN n >= 32 THEN {_fold(merged, "[v1, v2, v3, v4]", each)} ELSE {_u((seed + P5) % 2**64)} END AS h FROM x2),
x4 AS (SELECT * REPLACE ({_add("h", "n::UHUGEINT")} AS h) FROM x3),
x5 AS (SELECT * REPLACE ({_fold("h", "lanes[4 * (n // 32) + 1 :]", eight)} AS h) FROM x4),
x6 AS (SELECT * REPLACE (CASE WHEN n % 8 >= 4 THEN {four} ELSE h END AS h) FROM x5),
x7 AS (SELECT * REPLACE ({_fold("h", rest, one)} AS h) FROM x6),
x8 AS (SELECT * REPLACE ({_mul(shift(33), P2)} AS h) FROM x7),
x9 AS (SELECT * REPLACE ({_mul(shift(29), P3)} AS h) FROM x8),
hashed AS (SELECT sh, ({shift(32)})::UBIGINT AS h FROM x9)"""


NEAR_DEDUP = f"""
WITH RECURSIVE d AS (
  SELECT row_number() OVER () AS rn, doc_id, {WORDS.format("translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} AS w FROM documents
), s AS (
  SELECT rn, unnest(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS sh FROM d
), shingles AS (SELECT sh FROM s), {xxh64(42)},
bits AS (
  SELECT rn, b, count(*) AS n, sum(h // (1::UBIGINT << b) % 2) AS ones FROM s JOIN hashed USING (sh), (SELECT unnest(range(64))::UBIGINT AS b) GROUP BY rn, b
), prints AS (
  SELECT rn, doc_id, coalesce(fp, 0)::UBIGINT AS fp FROM d LEFT JOIN (SELECT rn, bit_or(CASE WHEN 2 * ones > n THEN 1::UBIGINT << b ELSE 0::UBIGINT END) AS fp FROM bits GROUP BY rn) USING (rn)
), classes AS (
  SELECT fp, count(*) AS n, min(doc_id) AS first FROM prints GROUP BY fp
), near AS (
  SELECT a.fp, b.fp AS other, b.n FROM classes a JOIN classes b ON bit_count(xor(a.fp, b.fp)::BIT) <= 3
), reach AS (
  SELECT fp, fp AS other FROM classes UNION SELECT reach.fp, near.other FROM reach JOIN near ON reach.other = near.fp
), known AS (
  SELECT reach.fp, min(first) AS component_id FROM reach JOIN classes ON other = classes.fp GROUP BY reach.fp
), many AS (
  SELECT fp, sum(n) - 1 AS n_near FROM near GROUP BY fp
)
SELECT doc_id, lpad(lower(to_hex(fp)), 16, '0') AS fingerprint, n_near::BIGINT AS n_near, component_id FROM prints JOIN known USING (fp) JOIN many USING (fp)
"""

REPEATS = """
WITH d AS (
  SELECT row_number() OVER () AS rn, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents
), blocks AS (
  SELECT rn, h, unnest(range(0, length(h) // 2 - 199, 500)) AS s FROM d WHERE length(h) >= 400
), pieces AS (
  SELECT rn, s, substr(h, 2 * s + 1, 1398) AS x FROM blocks
), p AS (
  SELECT rn, s, x, unnest(range(0, length(x) // 2 - 199)) AS o FROM pieces
), w AS (
  SELECT rn, s + o AS s, md5(substr(x, 2 * o + 1, 400)) AS g FROM p
), hit AS (
  SELECT rn, s FROM w WHERE g IN (SELECT g FROM w GROUP BY g HAVING count(*) > 1)
), edges AS (
  SELECT rn, s, lag(s) OVER (PARTITION BY rn ORDER BY s) AS b FROM hit
), runs AS (
  SELECT rn, s, sum(CASE WHEN b IS NULL OR s > b + 200 THEN 1 ELSE 0 END) OVER (PARTITION BY rn ORDER BY s) AS k FROM edges
), spans AS (
  SELECT rn, min(s) AS a, max(s) + 200 AS e FROM runs GROUP BY rn, k
), before AS (
  SELECT *, coalesce(lag(e) OVER (PARTITION BY rn ORDER BY a), 0) AS f FROM spans
), heads AS (
  SELECT rn, count(*) AS n_spans, sum(e - a) AS n_removed, max(e) AS last, string_agg(substr(h, 2 * f + 1, 2 * (a - f)), '' ORDER BY a) AS head FROM before JOIN d USING (rn) GROUP BY rn
)
SELECT doc_id, (length(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans,
  sha256(unhex(coalesce(head, '') || substr(h, 2 * coalesce(last, 0) + 1))) AS kept_sha256
FROM d LEFT JOIN heads USING (rn)
"""
