import pytest
from pyspark.sql import functions as F

from docloom.errors import IndexExists, IndexMissing, UnsupportedIndexType
from docloom.functions.text import TextConfig
from docloom.operators import access
from docloom.operators.indexes import Indexes
from docloom.operators.keyindex import KeyIndex
from docloom.operators.textindex import TextIndex


def ids(df):
    return sorted(r["id"] for r in df.select("id").collect())


@pytest.fixture(scope="module")
def ages(spark):
    return KeyIndex.build(spark.createDataFrame([(f"e{i}", 10 * i) for i in range(1, 11)] + [("n", None)], "id string, age long"), "age")


def test_ranges(ages):
    n = lambda *a, **k: ages.range_search(*a, **k).count()
    assert (n(30, 80), n(30, 60), n(30, 60, True, True), n(30, 60, False, True), n(None, 40), n(80), n(200, 300)) == (5, 3, 4, 3, 3, 3, 0)
    assert ages.count_range(30, 80) == 5 and ages.count_equals(30) == 1
    assert (ages.min_key(), ages.max_key(), ages.key_count(), ages.entry_count()) == (10, 100, 10, 10)
    assert ages.exists_greater(99) and not ages.exists_less(10) and ages.exists_equals(20)
    assert ids(ages.search_in([10, 10, None, 30])) == ["e1", "e3"] and ages.search(None).isEmpty()
    s = ages.statistics().first()
    assert (s["cardinality"], s["selectivity"], s["entries_per_key"]) == (10, 0.1, 1.0)


def test_hash_has_no_order(ages):
    h = KeyIndex("age", "hash", ages.table)
    assert h.search(10).count() == 1
    with pytest.raises(UnsupportedIndexType):
        h.range_search(1, 2)


def text(spark, *texts, **how):
    df = spark.createDataFrame([(str(i), t) for i, t in enumerate(texts, 1)], "id string, body string")
    return TextIndex.build(df, "body", **how)


def test_terms(spark):
    i = text(spark, "The quick brown fox jumps", "A lazy brown dog sleeps", "Fast red rabbit runs", None, "")
    assert ids(i.search("brown")) == ["1", "2"] and ids(i.search("brown fox")) == ["1"] and ids(i.search("BROWN")) == ["1", "2"]
    assert i.search("the").isEmpty() and i.search("").isEmpty() and ids(i.search_any(["Fox", "red"])) == ["1", "3"]
    assert ids(i.search_all(["brown", "dog"])) == ["2"] and i.search_all([]).isEmpty()
    assert i.statistics().first()["documents"] == 3


def test_phrases(spark):
    i = text(spark, "the quick brown fox", "brown quick fox", "quick red fox", "very very good", "very good very bad")
    assert ids(i.search_phrase("quick brown")) == ["1"] and ids(i.search_phrase("brown quick")) == ["2"] and len(ids(i.search_phrase("quick"))) == 3
    assert i.search_phrase("lazy dog").isEmpty() and ids(i.search_phrase("very very good")) == ["4"] and ids(i.search_phrase("quick the brown")) == ["1"]


def test_proximity(spark):
    i = text(spark, "quick brown fox", "quick lazy brown sleepy fox")
    assert [ids(i.search_near(["quick", "fox"], d)) for d in (2, 5, 1)] == [["1"], ["1", "2"], []]
    assert ids(i.search_near(["fox", "quick", "brown"], 2)) == ["1"] and ids(i.search_near(["fox"], 0)) == ["1", "2"]


def test_prefix_and_rank(spark):
    i = text(spark, "quicksand quickly quote", "slow steady")
    assert ids(i.search_prefix("qui")) == ["1"] and i.search_prefix("xyz").isEmpty() and i.search_prefix("").isEmpty()
    r = text(spark, "quick brown fox", "brown brown brown dog", "red blue green").ranked("brown").collect()
    assert [x["id"] for x in r] == ["2", "1"] and r[0]["score"] > r[1]["score"]
    assert text(spark, "a b", config=TextConfig.exact()).search_all(["a"]).count() == 1


def test_manager(spark, tmp_path):
    df = spark.createDataFrame([("1", 5, "red fox"), ("2", 7, "blue fox")], "id string, n long, t string")
    m = Indexes()
    m.create(df, "n", "btree")
    m.create(df, "t", "fulltext")
    with pytest.raises(IndexExists):
        m.create(df, "n")
    with pytest.raises(IndexMissing):
        m.get("x")
    with pytest.raises(UnsupportedIndexType):
        m.text("n")
    with pytest.raises(UnsupportedIndexType):
        m.key("t")
    m.save(str(tmp_path))
    again = Indexes()
    assert ids(again.load(spark, str(tmp_path), "t", "fulltext").search("fox")) == ["1", "2"]
    assert again.load(spark, str(tmp_path), "n", "btree").max_key() == 7
    exact = TextIndex.build(df, "t", config=TextConfig.exact())
    exact.save(str(tmp_path / "exact"))
    kept = TextIndex.load(spark, str(tmp_path / "exact"), "t")
    assert kept.config == TextConfig.exact() and kept.documents == 2 and kept.search_all(["Fox"]).isEmpty()
    assert kept.ranked("fox red").collect() == exact.ranked("fox red").collect()
    m.remove("n")
    assert m.fields == ["t"] and m.kind("t") == "fulltext" and not m.has("n")


def test_saved_in_segments(spark, tmp_path):
    """Saving reads every text once, spreads those of one file over the cores,
    and writes each part in the order of terms; nothing else differs."""
    import pyarrow.parquet as pq

    rows = [(f"d{i % 70}", f"red w{i % 7} Fox w{i % 11}, very very w{i % 13}") for i in range(80)] + [(None, "red owl"), ("e", None), ("f", "")]
    spark.createDataFrame(rows, "id string, body string").coalesce(1).write.parquet(str(tmp_path / "texts"))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        read.add(1)
        return t

    built = TextIndex.build(spark.read.parquet(str(tmp_path / "texts")).select("id", counted("body").alias("body")), "body")
    built.save(str(tmp_path / "saved"))
    assert read.value == len(rows)
    parts = [pq.ParquetFile(p).read()["term"].to_pylist() for p in (tmp_path / "saved" / "postings").glob("*.parquet")]
    assert len(parts) >= spark.sparkContext.defaultParallelism and all(p == sorted(p) for p in parts)
    kept = TextIndex.load(spark, str(tmp_path / "saved"), "body")
    plain = lambda df: sorted(map(repr, df.collect()))
    assert plain(kept.postings) == plain(built.postings) and kept.ranked("w3 red").collect() == built.ranked("w3 red").collect()
    assert kept.documents == built.statistics().first()["documents"] == 70
    kept.save(str(tmp_path / "again"))
    again = TextIndex.load(spark, str(tmp_path / "again"), "body")
    assert plain(again.postings) == plain(kept.postings) and again.documents == 70


def test_saved_exact(spark, tmp_path):
    """Documents are counted by their first tokens, whatever stands before
    them; those without tokens, and copies of an id, don't count."""
    rows = [("a", "... The end"), ("b", "the"), ("c", " ?! "), ("a", "The The"), ("d", "-The"), (None, "The"), ("e", None)]
    spark.createDataFrame(rows, "id string, body string").coalesce(1).write.parquet(str(tmp_path / "texts"))
    read = spark.sparkContext.accumulator(0)

    @F.udf("string")
    def counted(t):
        read.add(1)
        return t

    built = TextIndex.build(spark.read.parquet(str(tmp_path / "texts")).select("id", counted("body").alias("body")), "body", config=TextConfig.exact())
    built.save(str(tmp_path / "saved"))
    assert read.value == len(rows)
    kept = TextIndex.load(spark, str(tmp_path / "saved"), "body")
    assert kept.documents == built.statistics().first()["documents"] == 3
    assert {r["id"] for r in kept.search_all(["The"]).collect()} == {"a", "d", None} and ids(kept.search_all(["the"])) == ["b"]


def test_access(spark):
    P = access.Permission.parse
    assert P("entity:write").implies(P("entity:delete")) and not P("entity:write").implies(P("entity:read"))
    assert P("*:*").implies(P("x:y:own")) and P("entity:read:group").implies(P("entity:read:own")) and not P("entity:read:own").implies(P("entity:read:group"))
    with pytest.raises(ValueError):
        P("entity")
    roles = spark.createDataFrame([*access.seed_roles(), ("loop1", ["a:b"], ["loop2"], False, True, 1), ("loop2", [], ["loop1", "off"], False, True, 1), ("off", ["x:y"], [], False, False, 1)], access.ROLE_SCHEMA)
    got = {(r[0], r[1]) for r in access.closure(roles).collect()}
    assert ("admin", "guest") in got and ("loop1", "loop1") in got and ("loop2", "loop1") in got and not any("off" in x for x in got)
    assert access.roles_granting(roles, P("entity:create")) == ["admin", "super_admin", "transaction_manager", "user"]
    assert access.has_cycle(roles) and not access.has_cycle(roles.filter("not startswith(name, 'loop')"))


def test_checks(spark):
    """Implication on columns is that of single permissions; unknown users have
    none."""
    P = access.Permission.parse
    names = ["*:*", "*:read", "entity:*", "entity:admin", "entity:write", "entity:create", "entity:read", "entity:read:own", "entity:read:group", "entity:write:organization", "user:read"]
    pairs = spark.createDataFrame([(a, b) for a in names for b in names], "a string, b string")
    got = {(r.a, r.b): r.ok for r in pairs.select("a", "b", access.implied(F.col("a"), F.col("b")).alias("ok")).collect()}
    assert got == {(a, b): P(a).implies(P(b)) for a in names for b in names}
    roles = spark.createDataFrame(access.seed_roles(), access.ROLE_SCHEMA)
    users = spark.createDataFrame([("ann", "admin"), ("bob", "guest"), ("bob", "gone")], "user string, role string")
    assert access.check_permission(users, roles, "ann", P("entity:delete")) and not access.check_permission(users, roles, "bob", P("entity:delete"))
    assert not access.check_permission(users, roles, "eve", P("entity:read"))
    assert access.check_permissions(users, roles, "bob", [P("entity:read"), P("collection:read")]) and not access.check_permissions(users, roles, "bob", [P("entity:read"), P("user:read")])


def test_permission_sets():
    P = access.Permission.parse
    a, b = access.PermissionSet({P("entity:write"), P("user:read")}), access.PermissionSet({P("entity:create"), P("*:read:own")})
    assert (a | b).grants_all([P("entity:delete"), P("x:read:own")]) and isinstance(a | b, access.PermissionSet)
    assert a & b == {P("entity:create")} and (a - {P("user:read")}).grants(P("entity:update")) and not (a - {P("user:read")}).grants(P("user:read"))
