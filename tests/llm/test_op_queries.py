"""Registered queries over whole tables."""

import duckdb
import pytest

from docloom.llm.queries import ORACLES, QUERIES

SF = "/root/testdata/sf0.001"


def test_one_query_per_operator():
    assert [int(n[2:].split("_")[0]) for n in QUERIES] == list(range(1, 11))


@pytest.fixture(scope="module")
def tables():
    c = duckdb.connect()
    for name in ("documents", "embeddings"):
        c.sql(f"CREATE VIEW {name} AS SELECT * FROM '{SF}/{name}.parquet'")
    return c


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, tables, name):
    df = QUERIES[name](spark, SF)
    cols = sorted(df.columns)
    want = tables.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.select(*cols).collect())) == sorted(want)


def column(spark, prefix, *cols):
    (name,) = (n for n in QUERIES if n.startswith(prefix))
    return sorted(map(tuple, QUERIES[name](spark, SF).select(*cols).collect()))


SIZE = r"len(list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> ''))"


def test_sizes_and_targets_by_sql(spark, tables):
    """Of op5: water-filling by sorting sources by what fills them."""
    want = tables.sql(f"""WITH d AS (SELECT doc_id, source, {SIZE}::BIGINT AS size FROM documents),
      s AS (SELECT source, sum(size)::BIGINT AS source_size, [5, 2, 1][1 + (row_number() OVER (ORDER BY source) - 1) % 3] AS weight FROM d GROUP BY source),
      o AS (SELECT *, 2 * source_size / weight AS fills, (1.5 * sum(source_size) OVER () - coalesce(sum(2 * source_size) OVER earlier, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER earlier, 0)) AS level
        FROM s WINDOW earlier AS (ORDER BY 2 * source_size / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
      t AS (SELECT source, source_size, least(2 * source_size, weight * coalesce((SELECT arg_min(level, fills) FROM o WHERE fills > level), 'inf'::DOUBLE)) AS target FROM o)
      SELECT doc_id, size, source_size, round(target, 6) FROM d JOIN t USING (source)""").fetchall()
    got = column(spark, "op5_", "doc_id", "size", "source_size", "target")
    assert [(*r[:3], round(r[3], 6)) for r in got] == sorted(want)


def test_sizes_and_slots_by_sql(spark, tables):
    """Of op6: sizes, and slots gapless in shards near equal; equal texts together."""
    want = tables.sql("SELECT doc_id, octet_length(encode(coalesce(text, ''))) + 1 FROM documents").fetchall()
    rows = column(spark, "op6_", "doc_id", "size", "text_crc32", "shard", "slot")
    assert [r[:2] for r in rows] == sorted(want)
    shards, texts = {}, {}
    for _, size, crc, shard, slot in rows:
        shards.setdefault(shard, []).append((slot, size))
        texts.setdefault((size, crc), set()).add(shard)
    assert len(shards) == 16 and all(sorted(s for s, _ in v) == list(range(len(v))) for v in shards.values())
    assert all(len(v) == 1 for v in texts.values())


def test_base_columns_by_sql(spark, tables):
    """Of op7."""
    words = SIZE[4:-1]
    want = tables.sql(f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {words} AS w FROM documents),
      p AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 1, 1)::BIGINT)) AS k, w FROM d),
      g AS (SELECT doc_id, k, w[k : k + 2] AS g FROM p),
      twice AS (SELECT doc_id, g FROM g GROUP BY ALL HAVING count(*) > 1),
      covered AS (SELECT doc_id, count(DISTINCT place) AS n FROM (SELECT doc_id, unnest([k, k + 1, k + 2]) AS place FROM g JOIN twice USING (doc_id, g)) GROUP BY doc_id),
      lines AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d),
      dup AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY doc_id)
      SELECT doc_id, len(w), list_sum(list_transform(w, lambda x: length(x)))::BIGINT, len(regexp_extract_all(t, '[#*$%&|<>]')), coalesce(dup.n, 0), coalesce(covered.n, 0),
        len(w) < 50 OR 100 * coalesce(covered.n, 0) > 50 * len(w) FROM d LEFT JOIN dup USING (doc_id) LEFT JOIN covered USING (doc_id)""").fetchall()
    assert column(spark, "op7_", "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed") == sorted(want)


def test_whole_sequences(spark):
    """Of op1: no gaps, no overlap, and close to the fewest sequences."""
    rows = column(spark, "op1_", "sequence_id", "offset", "length")
    at = {}
    for s, offset, length in rows:
        assert offset == at.get(s, 0)
        at[s] = offset + length
    assert max(at.values()) <= 2048 and len(at) <= 1.02 * sum(r[2] for r in rows) / 2048 + 1


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_schema(spark, name):
    """Results have the agreed leading columns and types."""
    want = {
        1: "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint",
        2: "doc_id bigint, held_out boolean, score double, predicted int",
        3: "doc_id bigint, fingerprint string, n_near bigint, component_id bigint",
        4: "doc_id bigint, n_email bigint, n_ip bigint, n_card bigint, n_phone bigint, base_sha256 string, spans string",
        5: "doc_id bigint, size bigint, source_size bigint, target double, taken bigint",
        6: "doc_id bigint, size bigint, text_crc32 bigint, law string, shard int, slot bigint, grown_shard int",
        7: "doc_id bigint, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint, n_repeat_words bigint, base_failed boolean, kept boolean",
        8: "doc_id bigint, n_bytes bigint, n_removed bigint, n_spans bigint, kept_sha256 string",
        9: "query_id bigint, rank int, vec_id bigint, score double",
        10: "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string",
    }[int(name[2:].split("_")[0])]
    df = QUERIES[name](spark, SF)
    have = ", ".join(f"{n} {t}" for n, t in df.dtypes)
    assert have.startswith(want)
    table = "embeddings" if name.startswith("op9_") else "documents"
    rows = spark.read.parquet(f"{SF}/{table}.parquet").count()
    assert df.count() == rows or name.startswith(("op1_", "op9_"))
