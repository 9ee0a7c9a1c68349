"""The engine's registered queries, each with the SQL that states its result.

``docl`` stands for documents LEFT JOIN labels: the driver's tables hold no
nulls, so that is where nullable fields come from."""

from __future__ import annotations

from collections.abc import Callable
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.text import STOP_WORDS, TextConfig
from .operators import access, changes, migrations
from .operators.collection import Collection, count_where, exists_where, find
from .operators.keyindex import KeyIndex
from .operators.textindex import TextIndex
from .operators.transactions import Isolation, Transactions
from .plans import predicates as P
from .plans.builder import Where
from .sources.scratch import fresh_folder
from .sources.snapshots import Snapshots
from .sources.spread import spread
from .sources.store import Store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def docl(spark: SparkSession, sf_dir: str) -> DataFrame:
    """documents LEFT JOIN labels, without the text."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars")
    return d.join(table(spark, sf_dir, "labels"), "doc_id", "left")


DOCL = "(SELECT d.doc_id, d.lang, d.source, d.n_chars, l.quality, l.toxic FROM documents d LEFT JOIN labels l USING (doc_id))"


def register(name: str, sql: str | None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql:
            ORACLES[name] = sql
        return f

    return add


def predicate(name: str, source: str, columns: str, p: P.Predicate | Where, where: str) -> None:
    """A finder over a table, or over docl."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        df = docl(spark, sf_dir) if source == "docl" else table(spark, sf_dir, source)
        return find(df, p).select(*columns.split(", "))

    register(name, f"SELECT {columns} FROM {DOCL if source == 'docl' else source} WHERE {where}")(run)


EVENT, ORDER, PART, NULLABLE = "event_id, event_type, value", "o_orderkey, o_orderstatus, o_totalprice", "p_partkey, p_name, p_type, p_size", "doc_id, lang, quality, toxic"

# boolean
predicate("find_and", "events", EVENT, Where().equals("event_type", "purchase").greater("value", 50.0), "event_type = 'purchase' AND value > 50")
predicate("find_or", "orders", ORDER, Where().equals("o_orderstatus", "F").or_(P.Greater("o_totalprice", 400000.0)), "o_orderstatus = 'F' OR o_totalprice > 400000")
predicate("find_or_all", "orders", ORDER, Where().or_all([P.Equals("o_orderstatus", "P"), P.Less("o_totalprice", 5000.0), P.Greater("o_totalprice", 450000.0)]), "o_orderstatus = 'P' OR o_totalprice < 5000 OR o_totalprice > 450000")
predicate("find_builder_precedence", "orders", ORDER, Where().equals("o_orderstatus", "F").or_(P.Equals("o_orderstatus", "P")).greater("o_totalprice", 300000.0), "(o_orderstatus = 'F' OR o_orderstatus = 'P') AND o_totalprice > 300000")
predicate("find_all", "nation", "n_nationkey, n_name, n_regionkey", P.All(), "true")
predicate("not_and", "docl", NULLABLE, ~(P.Equals("quality", 1) & P.Equals("lang", "en")), "NOT coalesce(quality = 1 AND lang = 'en', false)")
predicate("not_or", "docl", NULLABLE, ~(P.Equals("quality", 1) | P.Equals("toxic", 1)), "NOT (coalesce(quality = 1, false) OR coalesce(toxic = 1, false))")
predicate("not_not", "docl", NULLABLE, ~~P.Equals("quality", 1), "quality = 1")

# comparison
predicate("eq", "part", PART, P.Equals("p_type", "PROMO"), "p_type = 'PROMO'")
predicate("neq", "part", PART, P.NotEquals("p_type", "PROMO"), "p_type IS DISTINCT FROM 'PROMO'")
predicate("neq_null", "docl", NULLABLE, P.NotEquals("quality", 1), "quality IS DISTINCT FROM 1")
predicate("eq_null", "docl", NULLABLE, P.Equals("quality", None), "quality IS NULL")
predicate("gt", "orders", ORDER, P.Greater("o_totalprice", 250000.0), "o_totalprice > 250000")
predicate("gte", "part", PART, P.GreaterOrEqual("p_size", 40), "p_size >= 40")
predicate("lt", "orders", ORDER, P.Less("o_totalprice", 20000.0), "o_totalprice < 20000")
predicate("lte", "part", PART, P.LessOrEqual("p_size", 10), "p_size <= 10")
predicate("not_gt_null", "docl", NULLABLE, ~P.Greater("quality", 0), "quality IS NULL OR quality <= 0")
predicate("ts_range", "lineitem", "l_orderkey, l_linenumber, l_shipdate", Where().at_least("l_shipdate", datetime(1997, 1, 1)).less("l_shipdate", datetime(1997, 3, 1)), "l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1997-03-01'")
for _n, _a, _b, _w in (("ii", True, True, "p_size >= 10 AND p_size <= 20"), ("ie", True, False, "p_size >= 10 AND p_size < 20"), ("ei", False, True, "p_size > 10 AND p_size <= 20"), ("ee", False, False, "p_size > 10 AND p_size < 20")):
    predicate(f"between_{_n}", "part", PART, P.Between("p_size", 10, 20, _a, _b), _w)
predicate("not_between", "docl", NULLABLE, ~P.Between("quality", 1, 2), "quality IS NULL OR NOT (quality BETWEEN 1 AND 2)")
predicate("type_mismatch", "part", PART, P.Equals("p_type", "PROMO") & ~P.Greater("p_type", 5), "p_type = 'PROMO'")

# membership and null
predicate("in", "part", PART, P.In("p_type", ("PROMO", "SMALL", "SMALL")), "p_type IN ('PROMO', 'SMALL')")
predicate("not_in", "part", PART, P.NotIn("p_type", ("PROMO", "SMALL")), "p_type NOT IN ('PROMO', 'SMALL')")
predicate("in_null", "docl", NULLABLE, P.In("quality", (0, None)), "quality = 0 OR quality IS NULL")
predicate("not_in_null", "docl", NULLABLE, P.NotIn("quality", (1,)), "quality IS NULL OR quality NOT IN (1)")
predicate("not_in_listed_null", "docl", NULLABLE, P.NotIn("quality", (1, None)), "quality IS NOT NULL AND quality NOT IN (1)")
predicate("in_empty", "part", PART, P.In("p_type", ()), "false")
predicate("is_null", "docl", NULLABLE, P.IsNull("quality"), "quality IS NULL")
predicate("is_not_null", "docl", NULLABLE, P.IsNotNull("quality"), "quality IS NOT NULL")
predicate("missing_field", "part", PART, P.IsNull("nowhere") & P.Equals("p_type", "PROMO"), "p_type = 'PROMO'")


@register("exists", "SELECT event_id, props FROM events WHERE json_exists(props, '$.k')")
def exists(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("doc", F.try_parse_json("props"))
    return find(e, P.Exists("doc.k")).select("event_id", "props")


@register("exists_missing", "SELECT event_id FROM events WHERE NOT json_exists(props, '$.absent') AND event_type = 'signup'")
def exists_missing(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("doc", F.try_parse_json("props"))
    return find(e, ~P.Exists("doc.absent") & P.Equals("event_type", "signup")).select("event_id")


@register("nested_eq", "SELECT event_id, props FROM events WHERE CAST(json_extract(props, '$.k') AS INT) = 69")
def nested_eq(spark, sf_dir):
    e = table(spark, sf_dir, "events").withColumn("doc", F.try_parse_json("props"))
    return find(e, P.Equals("doc.k", 69)).select("event_id", "props")


@register("nested_struct", "SELECT c_custkey, c_name FROM customer WHERE c_mktsegment = 'BUILDING' AND c_nationkey < 10")
def nested_struct(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_name", F.struct("c_nationkey", "c_mktsegment").alias("profile"))
    return find(c, Where().equals("profile.c_mktsegment", "BUILDING").less("profile.c_nationkey", 10)).select("c_custkey", "c_name")


# strings
predicate("contains_str", "part", PART, P.Contains("p_name", "re"), "contains(p_name, 're')")
predicate("contains_ci", "part", PART, P.Contains("p_name", "RE", False), "contains(lower(p_name), 're')")
predicate("not_contains", "part", PART, ~P.Contains("p_name", "a"), "p_name IS NULL OR NOT contains(p_name, 'a')")
predicate("starts_with", "customer", "c_custkey, c_name", P.StartsWith("c_name", "Customer#00000001"), "starts_with(c_name, 'Customer#00000001')")
predicate("starts_with_ci", "part", PART, P.StartsWith("p_type", "sta", False), "starts_with(lower(p_type), 'sta')")
predicate("ends_with", "part", PART, P.EndsWith("p_type", "ARD"), "ends_with(p_type, 'ARD')")
predicate("ends_with_ci", "part", PART, P.EndsWith("p_type", "omy", False), "ends_with(lower(p_type), 'omy')")
predicate("regex", "pages", "page_id, url", P.Matches("url", "[0-9]+$"), "regexp_matches(url, '[0-9]+$')")
predicate("regex_ci", "part", PART, P.Matches("p_type", "^(pro|eco)", False), "regexp_matches(p_type, '^(pro|eco)', 'i')")


@register("contains_list", "SELECT p_partkey, p_name FROM part WHERE list_contains(string_split(p_name, ' '), split_part((SELECT min(p_name) FROM part), ' ', 1))")
def contains_list(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    word = p.agg(F.min("p_name")).first()[0].split(" ")[0]
    return find(p.withColumn("tags", F.split("p_name", " ")), P.Contains("tags", word)).select("p_partkey", "p_name")


# full text by scan
TEXT = "doc_id, lang"
predicate("ft_scan_all", "documents", TEXT, P.TextAll("text", "The, that!"), "contains(lower(text), 'the') AND contains(lower(text), 'that')")
predicate("ft_scan_any", "documents", TEXT, P.TextAny("text", ("quees", "that")), "contains(lower(text), 'quees') OR contains(lower(text), 'that')")
predicate("ft_scan_phrase", "documents", TEXT, P.TextPhrase("text", "of the"), "contains(lower(text), 'of the')")
predicate("ft_scan_prefix", "documents", TEXT, P.TextPrefix("text", "chzu"), r"len(list_filter(string_split_regex(lower(text), '[\s\p{P}]+'), lambda t: starts_with(t, 'chzu'))) > 0")
predicate("ft_scan_not_any", "documents", TEXT, ~P.TextAny("text", ("the", "de")), "text IS NULL OR NOT (contains(lower(text), 'the') OR contains(lower(text), 'de'))")

_NEAR = r"""
WITH t AS (SELECT doc_id, lang, string_split_regex(lower(text), '[\s\p{P}]+') AS tk FROM documents),
p AS (SELECT doc_id, lang, unnest(tk) AS term, unnest(range(len(tk))) AS pos FROM t),
h AS (SELECT * FROM p WHERE term IN ('the', 'of', 'and'))
SELECT DISTINCT a.doc_id, a.lang FROM h a, h b, h c WHERE a.doc_id = b.doc_id AND a.doc_id = c.doc_id
  AND a.term = 'the' AND b.term = 'of' AND c.term = 'and' AND greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) <= 4"""


@register("ft_scan_proximity", _NEAR)
def ft_scan_proximity(spark, sf_dir):
    return find(spread(table(spark, sf_dir, "documents").select("doc_id", "lang", "text")), P.TextNear("text", ("the", "of", "and"), 4)).select("doc_id", "lang")


# the inverted index
def text_index(spark: SparkSession, sf_dir: str, config: TextConfig | None = None) -> TextIndex:
    return TextIndex.build(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "text", "doc_id", config)


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
POSTINGS = rf"""
tk AS (SELECT doc_id, list_filter(string_split_regex(lower(text), '[\s\p{{P}}]+'), lambda t: len(t) BETWEEN 2 AND 100 AND t NOT IN ({_STOP})) AS ts FROM documents),
postings AS (SELECT doc_id AS id, unnest(ts) AS term, unnest(range(len(ts))) AS pos FROM tk)"""

register("ft_index_df", f"WITH {POSTINGS} SELECT term, count(DISTINCT id) AS df, count(*) AS cf FROM postings GROUP BY term")(lambda s, d: text_index(s, d).frequencies())
register("ft_index_stats", f"WITH {POSTINGS} SELECT count(DISTINCT term) AS terms, count(*) AS entries, count(DISTINCT id) AS documents FROM postings")(lambda s, d: text_index(s, d).statistics())
register("ft_index_search", f"WITH {POSTINGS} SELECT DISTINCT id FROM postings WHERE term = 'tion'")(lambda s, d: text_index(s, d).search("the TION, of"))
register("ft_index_all", f"WITH {POSTINGS} SELECT id FROM postings WHERE term IN ('er', 'tion') GROUP BY id HAVING count(DISTINCT term) = 2")(lambda s, d: text_index(s, d).search("Tion. er"))
register("ft_index_any", f"WITH {POSTINGS} SELECT DISTINCT id FROM postings WHERE term IN ('ing', 'der')")(lambda s, d: text_index(s, d).search_any(["ing", "DER"]))
register("ft_index_phrase", f"WITH {POSTINGS} SELECT DISTINCT a.id FROM postings a JOIN postings b ON a.id = b.id AND b.pos = a.pos + 1 WHERE a.term = 'thanedble' AND b.term = 'anea'")(lambda s, d: text_index(s, d).search_phrase("thanedble the anea"))
register("ft_index_phrase_repeated", f"WITH {POSTINGS} SELECT DISTINCT a.id FROM postings a JOIN postings b ON a.id = b.id AND b.pos = a.pos + 1 JOIN postings c ON a.id = c.id AND c.pos = a.pos + 2 WHERE a.term = 'de' AND b.term = 'la' AND c.term = 'de'")(
    lambda s, d: text_index(s, d).search_phrase("de la de")
)
register("ft_index_proximity", f"WITH {POSTINGS} SELECT DISTINCT a.id FROM postings a JOIN postings b ON a.id = b.id JOIN postings c ON a.id = c.id WHERE a.term = 'en' AND b.term = 'er' AND c.term = 're' AND greatest(a.pos, b.pos, c.pos) - least(a.pos, b.pos, c.pos) <= 20")(
    lambda s, d: text_index(s, d).search_near(["er", "en", "re"], 20)
)
register("ft_index_prefix", f"WITH {POSTINGS} SELECT DISTINCT id FROM postings WHERE starts_with(term, 'chzu')")(lambda s, d: text_index(s, d).search_prefix("chzu"))

_RANKED = f"""WITH {POSTINGS},
q AS (SELECT * FROM (VALUES ('tion', 2), ('en', 1), ('der', 1)) AS v(term, times)),
n AS (SELECT count(DISTINCT id) AS total FROM postings),
tf AS (SELECT term, id, count(*) AS tf FROM postings WHERE term IN ('tion', 'en', 'der') GROUP BY ALL),
df AS (SELECT term, count(*) AS df FROM tf GROUP BY term)
SELECT id, round(sum(times * (1 + log2(tf)) * greatest(0, least(100, log2(total / df)))), 6) AS score
FROM tf JOIN df USING (term) JOIN q USING (term), n GROUP BY id"""
register("ft_index_ranked", _RANKED)(lambda s, d: text_index(s, d).ranked("tion en der the tion").select("id", F.round("score", 6).alias("score")))
register("ft_index_exact", r"""WITH p AS (SELECT doc_id AS id, unnest(list_filter(string_split_regex(text, '[\s\p{P}]+'), lambda t: len(t) BETWEEN 1 AND 100)) AS term FROM documents)
SELECT DISTINCT id FROM p WHERE term = 'The'""")(lambda s, d: text_index(s, d, TextConfig.exact()).search_all(["The"]))

# counts, existence, key indexes
register("count_where", "SELECT count(*) AS n FROM lineitem WHERE l_quantity > 25 AND l_returnflag = 'R'")(lambda s, d: count_where(table(s, d, "lineitem"), Where().greater("l_quantity", 25.0).equals("l_returnflag", "R")))
register("count_all", "SELECT count(*) AS n FROM lineitem")(lambda s, d: count_where(table(s, d, "lineitem")))
register("exists_where", "SELECT count(*) > 0 AS found FROM lineitem WHERE l_quantity > 49")(lambda s, d: exists_where(table(s, d, "lineitem"), P.Greater("l_quantity", 49.0)))
register("exists_nowhere", "SELECT count(*) > 0 AS found FROM lineitem WHERE l_quantity > 4900")(lambda s, d: exists_where(table(s, d, "lineitem"), P.Greater("l_quantity", 4900.0)))


def key_index(spark, sf_dir, field, kind="btree", name="orders", id_="o_orderkey") -> KeyIndex:
    return KeyIndex.build(table(spark, sf_dir, name), field, kind, id_)


register(
    "index_stats",
    """SELECT 'o_orderstatus' AS field, 'hash' AS index_type, count(DISTINCT o_orderstatus) AS cardinality, count(o_orderstatus) AS total_entries,
  1.0::DOUBLE / count(DISTINCT o_orderstatus) AS selectivity, count(o_orderstatus)::DOUBLE / count(DISTINCT o_orderstatus) AS entries_per_key FROM orders""",
)(lambda s, d: key_index(s, d, "o_orderstatus", "hash").statistics())
register("index_min_max", "SELECT min(o_totalprice) AS min_key, max(o_totalprice) AS max_key FROM orders")(lambda s, d: key_index(s, d, "o_totalprice").bounds())
register("index_equals", "SELECT o_orderkey AS id FROM orders WHERE o_orderpriority = '1-URGENT'")(lambda s, d: key_index(s, d, "o_orderpriority", "hash").search("1-URGENT"))
register("index_range", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")(lambda s, d: key_index(s, d, "o_totalprice").range_search(100000.0, 150000.0))
register("index_greater", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice > 400000")(lambda s, d: key_index(s, d, "o_totalprice").greater(400000.0))
register("index_at_most", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice <= 10000")(lambda s, d: key_index(s, d, "o_totalprice").at_most(10000.0))
register("index_in_union", "SELECT p_partkey AS id FROM part WHERE p_type = 'PROMO' UNION SELECT p_partkey FROM part WHERE p_type = 'SMALL'")(lambda s, d: key_index(s, d, "p_type", "hash", "part", "p_partkey").search_in(["PROMO", "SMALL", "PROMO"]))


@register("index_intersect", "SELECT p_partkey AS id FROM part WHERE p_type = 'PROMO' INTERSECT SELECT p_partkey FROM part WHERE p_size > 25")
def index_intersect(spark, sf_dir):
    a = key_index(spark, sf_dir, "p_type", "hash", "part", "p_partkey").search("PROMO")
    return a.intersect(key_index(spark, sf_dir, "p_size", "btree", "part", "p_partkey").greater(25))


@register("index_count_range", "SELECT count(*) FILTER (p_size BETWEEN 5 AND 9) AS inside, count(*) FILTER (p_size > 40) AS above, count(*) FILTER (p_size = 7) AS equal FROM part")
def index_count_range(spark, sf_dir):
    i = key_index(spark, sf_dir, "p_size", "btree", "part", "p_partkey")
    return i.table.agg(F.count_if(i.range_condition(5, 9, True, True)).alias("inside"), F.count_if(i.range_condition(40, None, False)).alias("above"), F.count_if(F.col("key") == 7).alias("equal"))


@register("get_many", "SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_totalprice > 400000)")
def get_many(spark, sf_dir):
    ids = find(table(spark, sf_dir, "orders"), P.Greater("o_totalprice", 400000.0)).select("o_custkey")
    return Collection(table(spark, sf_dir, "customer"), "c_custkey").get_many(ids).select("c_custkey", "c_name")


register("get_one", "SELECT c_custkey, c_name, c_acctbal FROM customer WHERE c_custkey = 7")(lambda s, d: find(table(s, d, "customer"), P.Equals("c_custkey", 7)).limit(1).select("c_custkey", "c_name", "c_acctbal"))


# changes
def customers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name", "c_acctbal", F.lit(1).cast("long").alias("__version"))


def edited(spark, sf_dir) -> DataFrame:
    """New balances for some, and some new customers."""
    c = table(spark, sf_dir, "customer")
    bumped = c.filter("c_custkey % 10 = 0").select(F.col("c_custkey").alias("id"), "c_name", (F.col("c_acctbal") + 100).alias("c_acctbal"))
    new = c.filter("c_custkey % 50 = 1").select((F.col("c_custkey") + 10000000).alias("id"), F.concat(F.lit("New "), "c_name").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return bumped.unionByName(new)


_EDITS = """(SELECT c_custkey AS id, c_name, c_acctbal + 100 AS c_acctbal FROM customer WHERE c_custkey % 10 = 0
  UNION ALL SELECT c_custkey + 10000000, 'New ' || c_name, 0.0 FROM customer WHERE c_custkey % 50 = 1)"""


@register("dml_upsert", f"""SELECT coalesce(e.id, c.c_custkey) AS id, CASE WHEN e.id IS NULL THEN c.c_name ELSE e.c_name END AS c_name,
  round(CASE WHEN e.id IS NULL THEN c.c_acctbal ELSE e.c_acctbal END, 2) AS c_acctbal, (CASE WHEN e.id IS NOT NULL AND c.c_custkey IS NOT NULL THEN 2 ELSE 1 END)::BIGINT AS __version
  FROM customer c FULL OUTER JOIN {_EDITS} e ON c.c_custkey = e.id""")
def dml_upsert(spark, sf_dir):
    return changes.merged(customers(spark, sf_dir), edited(spark, sf_dir), "id", "__version").withColumn("c_acctbal", F.round("c_acctbal", 2))


register("dml_delete", f"SELECT c_custkey AS id, c_name FROM customer WHERE c_custkey NOT IN (SELECT id FROM {_EDITS})")(lambda s, d: changes.without(customers(s, d), edited(s, d), "id").select("id", "c_name"))


@register("dml_update_version", "SELECT c_custkey AS id, round(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END, 2) AS c_acctbal, (CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END)::BIGINT AS __version FROM customer")
def dml_update_version(spark, sf_dir):
    changed = changes.assigned(customers(spark, sf_dir), F.col("c_acctbal") < 0, {"c_acctbal": F.lit(0.0)}, "__version")
    return changed.select("id", F.round("c_acctbal", 2).alias("c_acctbal"), "__version")


@register("txn_snapshot_view", f"""WITH ops AS (SELECT 1 AS seq, 'upsert' AS op, * FROM {_EDITS} UNION ALL SELECT 2, 'delete', id, NULL, NULL FROM {_EDITS} WHERE id % 20 = 0),
last AS (SELECT * FROM ops QUALIFY row_number() OVER (PARTITION BY id ORDER BY seq DESC) = 1)
SELECT c_custkey AS id, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT id FROM last)
UNION ALL SELECT id, c_name, round(c_acctbal, 2) FROM last WHERE op <> 'delete'""")
def txn_snapshot_view(spark, sf_dir):
    e = edited(spark, sf_dir)
    ops = e.select(F.lit(1).alias("seq"), F.lit("upsert").alias("op"), "*")
    ops = ops.unionByName(e.filter("id % 20 = 0").select(F.lit(2).alias("seq"), F.lit("delete").alias("op"), "id", F.lit(None).cast("string").alias("c_name"), F.lit(None).cast("double").alias("c_acctbal")))
    return changes.overlay(customers(spark, sf_dir).drop("__version"), ops).withColumn("c_acctbal", F.round("c_acctbal", 2))


def base_orders(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), "o_orderstatus", "o_totalprice")


def step(df: DataFrame, drop: int, bump: int, by: float) -> DataFrame:
    return df.filter(F.col("id") % drop != 0).withColumn("o_totalprice", F.when(F.col("id") % bump == 0, F.col("o_totalprice") + by).otherwise(F.col("o_totalprice")))


_BASE = "(SELECT o_orderkey AS id, o_orderstatus, o_totalprice FROM orders)"
_S1 = f"(SELECT id, o_orderstatus, CASE WHEN id % 89 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice FROM {_BASE} WHERE id % 97 <> 0)"
_S2 = f"(SELECT id, o_orderstatus, CASE WHEN id % 61 = 0 THEN o_totalprice + 2 ELSE o_totalprice END AS o_totalprice FROM {_S1} WHERE id % 53 <> 0)"


@register("txn_conflicts", f"SELECT a.id FROM {_BASE} a LEFT JOIN {_S1} b USING (id) WHERE a.id % 5 = 0 AND (a.o_totalprice, a.o_orderstatus) IS DISTINCT FROM (b.o_totalprice, b.o_orderstatus)")
def txn_conflicts(spark, sf_dir):
    old = base_orders(spark, sf_dir)
    return changes.conflicts(old, step(old, 97, 89, 1.0), old.filter("id % 5 = 0").select("id"))


@register("diff_changes", f"""SELECT CASE WHEN b.id IS NULL THEN 'deleted' ELSE 'changed' END AS op, coalesce(b.id, a.id) AS id, b.o_orderstatus, round(b.o_totalprice, 2) AS o_totalprice
  FROM {_BASE} a FULL OUTER JOIN {_S1} b ON a.id = b.id WHERE b.id IS NULL OR a.id IS NULL OR a.o_totalprice <> b.o_totalprice""")
def diff_changes(spark, sf_dir):
    old = base_orders(spark, sf_dir)
    return changes.changes(old, step(old, 97, 89, 1.0)).withColumn("o_totalprice", F.round("o_totalprice", 2))


@register("restore_chain", f"SELECT id, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM {_S2}")
def restore_chain(spark, sf_dir):
    full = base_orders(spark, sf_dir)
    one = step(full, 97, 89, 1.0)
    two = step(one, 53, 61, 2.0)
    return changes.replay(full, [changes.changes(full, one), changes.changes(one, two)]).withColumn("o_totalprice", F.round("o_totalprice", 2))


# stores, saved indexes, snapshots
def stored(spark, sf_dir, **how) -> Collection:
    """A collection over a new store of all customers."""
    c = customers(spark, sf_dir).drop("__version").withColumn("id", F.col("id").cast("string"))
    kept = Collection(Store(spark, fresh_folder(spark, "customers"), c.schema, **how))
    kept.insert(c)
    return kept


def named(df: DataFrame) -> DataFrame:
    return df.withColumn("id", F.col("id").cast("string"))


_CUSTOMERS = "(SELECT c_custkey::VARCHAR AS id, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer)"


@register("store_upsert", f"""SELECT coalesce(e.id, c.c_custkey)::VARCHAR AS id, CASE WHEN e.id IS NULL THEN c.c_name ELSE e.c_name END AS c_name,
  round(CASE WHEN e.id IS NULL THEN c.c_acctbal ELSE e.c_acctbal END, 2) AS c_acctbal, (CASE WHEN e.id IS NOT NULL AND c.c_custkey IS NOT NULL THEN 2 ELSE 1 END)::BIGINT AS __version
  FROM customer c FULL OUTER JOIN {_EDITS} e ON c.c_custkey = e.id""")
def store_upsert(spark, sf_dir):
    """Insert and upsert as two commits of a store that outgrows its buckets."""
    c = stored(spark, sf_dir, buckets=2, bucket_rows=1000)
    c.upsert(named(edited(spark, sf_dir)))
    return c.df.withColumn("c_acctbal", F.round("c_acctbal", 2))


@register("store_update", "SELECT c_custkey::VARCHAR AS id, CASE WHEN c_custkey % 10 = 0 THEN upper(c_name) ELSE c_name END AS c_name, (CASE WHEN c_custkey % 10 = 0 THEN 2 ELSE 1 END)::BIGINT AS __version FROM customer")
def store_update(spark, sf_dir):
    """With the version that was read: nobody may have written since."""
    c = stored(spark, sf_dir)
    c.update(c.df.filter("cast(id as long) % 10 = 0").withColumn("c_name", F.upper("c_name")))
    return c.df.select("id", "c_name", "__version")


@register("store_update_where", "SELECT c_custkey::VARCHAR AS id, round(CASE WHEN c_acctbal < 0 THEN 0 ELSE c_acctbal END, 2) AS c_acctbal, (CASE WHEN c_acctbal < 0 THEN 2 ELSE 1 END)::BIGINT AS __version FROM customer")
def store_update_where(spark, sf_dir):
    c = stored(spark, sf_dir)
    c.update_where(P.Less("c_acctbal", 0.0), {"c_acctbal": F.lit(0.0)})
    return c.df.select("id", F.round("c_acctbal", 2).alias("c_acctbal"), "__version")


@register("store_delete", f"SELECT id, c_name FROM {_CUSTOMERS} WHERE id::BIGINT NOT IN (SELECT id FROM {_EDITS})")
def store_delete(spark, sf_dir):
    c = stored(spark, sf_dir)
    c._store().delete(named(edited(spark, sf_dir)).select("id"))
    return c.df.select("id", "c_name")


register("store_delete_where", f"SELECT id FROM {_CUSTOMERS} WHERE c_acctbal >= 0")(lambda s, d: _deleted_where(stored(s, d)))


def _deleted_where(c: Collection) -> DataFrame:
    c.delete_where(P.Less("c_acctbal", 0.0))
    return c.df.select("id")


@register("store_get", "SELECT c_custkey::VARCHAR AS id, c_name, round(c_acctbal, 2) AS c_acctbal FROM customer WHERE c_custkey = 7")
def store_get(spark, sf_dir):
    """From the files of one bucket."""
    return stored(spark, sf_dir).source.get("7").select("id", "c_name", F.round("c_acctbal", 2).alias("c_acctbal"))


@register("store_counts", "SELECT count(*) AS n, count(*) FILTER (c_acctbal > 5000) AS rich, count(*) FILTER (c_custkey = 7) > 0 AS found, count(*) FILTER (c_acctbal > 1e12) > 0 AS beyond FROM customer")
def store_counts(spark, sf_dir):
    """The manifest's count, and counts and existence by an index."""
    c = stored(spark, sf_dir)
    c.create_index("c_acctbal")
    row = (len(c), c.count_where(P.Greater("c_acctbal", 5000.0)), c.exists("7"), c.exists_where(P.Greater("c_acctbal", 1e12)))
    return spark.createDataFrame([row], "n long, rich long, found boolean, beyond boolean")


@register("store_versions", "SELECT c_custkey::VARCHAR AS id FROM customer")
def store_versions(spark, sf_dir):
    """An old version, restored after everything was deleted."""
    c = stored(spark, sf_dir)
    before = c.version
    c.delete_all()
    c.source.restore(before)
    return c.df.select("id")


@register("txn_commit", f"""SELECT id, CASE WHEN id = '1' THEN 'First' ELSE c_name END AS c_name, (CASE WHEN id = '1' THEN 2 ELSE 1 END)::BIGINT AS __version FROM {_CUSTOMERS} WHERE id <> '2'
  UNION ALL SELECT 'new', 'Newcomer', 1::BIGINT""")
def txn_commit(spark, sf_dir):
    c = stored(spark, sf_dir)
    with Transactions(c.source).scope(Isolation.SERIALIZABLE) as t:
        t.update("1", {"c_name": "First", "c_acctbal": 1.0})
        t.delete("2")
        t.insert("new", {"c_name": "Newcomer", "c_acctbal": 0.0})
    return c.df.select("id", "c_name", "__version")


@register("snapshot_chain", f"SELECT id, o_orderstatus, round(o_totalprice, 2) AS o_totalprice FROM {_S2}")
def snapshot_chain(spark, sf_dir):
    """A full snapshot and two incremental ones, written, verified, replayed."""
    full = base_orders(spark, sf_dir)
    one = step(full, 97, 89, 1.0)
    kept = Snapshots(spark, fresh_folder(spark, "snapshots"))
    first = kept.full(full)["name"]
    second = kept.incremental(one, first)["name"]
    third = kept.incremental(step(one, 53, 61, 2.0), second)["name"]
    assert all(map(kept.verify, (first, second, third)))
    return kept.restore([first, second, third]).withColumn("o_totalprice", F.round("o_totalprice", 2))


@register("index_saved_range", "SELECT o_orderkey AS id FROM orders WHERE o_totalprice >= 100000 AND o_totalprice < 150000")
def index_saved_range(spark, sf_dir):
    """From a saved index: files in key order, whose limits prune."""
    path = fresh_folder(spark, "index")
    key_index(spark, sf_dir, "o_totalprice").save(path)
    return KeyIndex.load(spark, path, "o_totalprice", "btree").range_search(100000.0, 150000.0)


_saved: dict[tuple[str, str, TextConfig], str] = {}


def saved_text_index(spark, sf_dir, config: TextConfig | None = None) -> TextIndex:
    """Built and saved once a session."""
    key = spark.sparkContext.applicationId, sf_dir, config or TextConfig()
    if key not in _saved:
        _saved[key] = fresh_folder(spark, "postings")
        TextIndex.build(table(spark, sf_dir, "documents"), "text", "doc_id", config).save(_saved[key])
    return TextIndex.load(spark, _saved[key], "text")


register("ft_saved_ranked", _RANKED)(lambda s, d: saved_text_index(s, d).ranked("tion en der the tion").select("id", F.round("score", 6).alias("score")))
register("ft_saved_phrase", ORACLES["ft_index_phrase"])(lambda s, d: saved_text_index(s, d).search_phrase("thanedble the anea"))
register("ft_saved_exact", ORACLES["ft_index_exact"])(lambda s, d: saved_text_index(s, d, TextConfig.exact()).search_all(["The"]))


@register("store_migrate", f"SELECT id, c_name AS title, c_acctbal, 'none' AS email FROM {_CUSTOMERS}")
def store_migrate(spark, sf_dir):
    """Two steps as one commit."""
    c = stored(spark, sf_dir)
    steps = [migrations.rename("c_name", "title", "1.0.0", "1.1.0"), migrations.add_default("email", "none", "1.1.0", "1.2.0")]
    c.source.replace(c.df, {"schema_version": "1.0.0"})
    migrations.Migrator(c.source, steps).migrate("1.2.0")
    return c.df.select("id", "title", F.round("c_acctbal", 2).alias("c_acctbal"), "email")


# migrations
def suppliers(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("id"), "s_name", F.when(F.col("s_acctbal") > 0, F.col("s_acctbal")).alias("balance"))


register("migrate_add_default", "SELECT s_suppkey AS id, s_name, CASE WHEN s_acctbal > 0 THEN s_acctbal ELSE 0.0 END AS balance, 'none' AS email FROM supplier")(
    lambda s, d: migrations.add_default("email", "none", "1.0.0", "1.1.0").up(migrations.add_default("balance", 0.0, "1.1.0", "1.2.0").up(suppliers(s, d)))
)
register("migrate_rename", "SELECT s_suppkey AS id, s_name AS title, CASE WHEN s_acctbal > 0 THEN s_acctbal END AS balance FROM supplier")(lambda s, d: migrations.rename("s_name", "title", "1.0.0", "1.1.0").up(suppliers(s, d)))


@register("migrate_peers", "SELECT s_suppkey AS id, s_name, count(*) OVER () - 1 AS peers FROM supplier")
def migrate_peers(spark, sf_dir):
    """A count over all documents as a scalar subquery: no single-task window."""
    s = suppliers(spark, sf_dir).select("id", "s_name")
    return s.withColumn("peers", s.agg(F.count("*") - 1).scalar())


# access
@register("rbac_closure", """WITH RECURSIVE r(name, parent) AS (VALUES ('admin', 'user'), ('transaction_manager', 'user'), ('user', 'guest')),
names(n) AS (VALUES ('super_admin'), ('admin'), ('transaction_manager'), ('user'), ('guest')),
c(role, reaches) AS (SELECT n, n FROM names UNION SELECT c.role, r.parent FROM c JOIN r ON c.reaches = r.name)
SELECT role, reaches FROM c""")
def rbac_closure(spark, sf_dir):
    return access.closure(spark.createDataFrame(access.seed_roles(), access.ROLE_SCHEMA))


@register("rbac_checks", """SELECT * FROM (VALUES ('ann', 'entity:delete', true), ('ann', 'user:delete', true), ('ann', 'system:read', false), ('bob', 'entity:create', true),
  ('bob', 'entity:admin', false), ('bob', 'collection:read', true), ('eve', 'entity:read', false)) AS v("user", permission, granted)""")
def rbac_checks(spark, sf_dir):
    roles = spark.createDataFrame(access.seed_roles(), access.ROLE_SCHEMA)
    users = spark.createDataFrame([("ann", "admin"), ("bob", "user")], "user string, role string")
    asked = [("ann", "entity:delete"), ("ann", "user:delete"), ("ann", "system:read"), ("bob", "entity:create"), ("bob", "entity:admin"), ("bob", "collection:read"), ("eve", "entity:read")]
    return access.checked(users, roles, spark.createDataFrame(asked, "user string, permission string"))


# beyond the document model
register("ext_topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")(lambda s, d: table(s, d, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20).select("o_orderkey", "o_totalprice"))
register("ext_project", "SELECT o_orderkey, round(o_totalprice * 2, 2) AS doubled FROM orders WHERE o_orderstatus = 'P'")(lambda s, d: find(table(s, d, "orders"), P.Equals("o_orderstatus", "P")).select("o_orderkey", F.round(F.col("o_totalprice") * 2, 2).alias("doubled")))
register("ext_group", "SELECT l_returnflag, count(*) AS n, round(sum(l_quantity), 2) AS quantity FROM lineitem WHERE l_discount > 0.05 GROUP BY l_returnflag")(
    lambda s, d: find(table(s, d, "lineitem"), P.Greater("l_discount", 0.05)).groupBy("l_returnflag").agg(F.count("*").alias("n"), F.round(F.sum("l_quantity"), 2).alias("quantity"))
)
