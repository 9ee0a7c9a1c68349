import pytest
from pyspark.sql import functions as F

from docloom.database import Database, valid_field, valid_id, valid_name
from docloom.errors import DocumentExists, DocumentNotFound, MigrationError, StorageError, TransactionConflict, TransactionError, TypeMismatch, VersionConflict
from docloom.operators import migrations as M
from docloom.operators.collection import Collection, CollectionConfig, count_where, exists_where
from docloom.operators.transactions import Isolation, Transaction, Transactions
from docloom.plans import predicates as P
from docloom.plans.cache import ResultCache
from docloom.sources.snapshots import Snapshots, statistics
from docloom.sources.store import Store

SCHEMA = "id string, name string, price double"


def rows(spark, *r):
    return spark.createDataFrame(list(r), SCHEMA)


@pytest.fixture
def store(spark, tmp_path):
    s = Store(spark, str(tmp_path / "s"), spark.createDataFrame([], SCHEMA).schema, 4)
    s.insert(rows(spark, ("a", "A", 1.0), ("b", "B", 2.0), ("c", "C", 3.0)))
    return s


def state(df):
    return {r["id"]: (r["name"], r["price"]) for r in df.collect()}


def test_writes(spark, store):
    assert store.count() == 3 and state(store.read())["b"] == ("B", 2.0)
    assert store.read().filter("id = 'a'").first()["__version"] == 1
    with pytest.raises(DocumentExists):
        store.insert(rows(spark, ("a", "x", 0.0), ("z", "z", 0.0)))
    with pytest.raises(DocumentNotFound):
        store.update(rows(spark, ("q", "x", 0.0)))
    v = store.update(rows(spark, ("a", "A2", 9.0)))
    got = store.get("a").first()
    assert (got["name"], got["__version"]) == ("A2", 2)
    stale = rows(spark, ("a", "A3", 9.0)).withColumn("__version", F.lit(1).cast("long"))
    with pytest.raises(VersionConflict):
        store.update(stale)
    store.upsert(rows(spark, ("a", "A4", 1.0), ("d", "D", 4.0)))
    assert store.count() == 4 and store.get("a").first()["__version"] == 3 and store.get("d").first()["__version"] == 1
    assert store.delete(rows(spark, ("b", None, None), ("nobody", None, None)).select("id"))[1] == 1
    assert state(store.read(v))["b"] == ("B", 2.0)  # old versions stay
    store.update_where(F.col("price") > 2, {"price": F.col("price") * 2})
    assert state(store.read())["d"] == ("D", 8.0) and state(store.read())["a"] == ("A4", 1.0)
    store.delete_all()
    assert store.count() == 0 and store.read().count() == 0
    store.restore(v)
    assert state(store.read())["a"] == ("A2", 9.0)


def test_batches_and_ids(spark, store):
    store.upsert(rows(spark, ("k", "first", 1.0), ("k", "last", 2.0)).coalesce(1))
    assert state(store.read())["k"] == ("last", 2.0)
    store.insert(rows(spark, (None, "n1", 1.0), (None, "n2", 1.0)))
    assert store.count() == 6 and store.read().filter("id is null").count() == 0


def test_commits_exclude_each_other(spark, store):
    base = store.latest()
    store.upsert(rows(spark, ("a", "won", 1.0)), base)
    with pytest.raises(VersionConflict):
        store.upsert(rows(spark, ("a", "lost", 1.0)), base)
    assert state(store.read())["a"][0] == "won"


def test_only_touched_buckets_are_rewritten(spark, store):
    before = store.manifest()["files"]
    store.upsert(rows(spark, ("a", "x", 1.0)))
    after = store.manifest()["files"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert store.vacuum(keep=1) >= 1 and store.count() == 3 and store.read().count() == 3


def test_transactions(spark, store):
    t = Transaction(store, Isolation.REPEATABLE_READ)
    t.insert("n", {"name": "N", "price": 5.0})
    t.update("a", {"name": "AA", "price": 1.5})
    t.delete("b")
    t.upsert("n", {"name": "N2", "price": 6.0})
    assert t.get("n")["name"] == "N2" and not t.exists("b") and store.count() == 3
    assert Transaction(store).get("n") is None
    t.commit()
    assert state(store.read()) == {"a": ("AA", 1.5), "c": ("C", 3.0), "n": ("N2", 6.0)}
    assert store.get("a").first()["__version"] == 2
    with pytest.raises(TransactionError):
        t.commit()
    r = Transaction(store)
    r.delete("a")
    assert r.exists("a")  # read committed ignores its own operations
    r.rollback()
    assert r.state == "rolled back" and store.count() == 3


def test_conflicts(spark, store):
    t = Transaction(store, Isolation.SERIALIZABLE)
    assert t.get("a")["name"] == "A"
    t.update("c", {"name": "CC", "price": 1.0})
    store.upsert(rows(spark, ("a", "moved", 1.0)))
    with pytest.raises(TransactionConflict) as e:
        t.commit()
    assert e.value.ids == ["a"] and t.state == "failed"
    bad = Transaction(store)
    bad.update("nobody", {"name": "x", "price": 1.0})
    with pytest.raises(DocumentNotFound):
        bad.commit()


def test_manager(store):
    m = Transactions(store)
    with m.scope() as t:
        t.delete("a")
        with pytest.raises(TransactionError):
            m.begin()
    assert store.count() == 2
    with pytest.raises(ZeroDivisionError), m.scope() as t:
        t.delete("b")
        raise ZeroDivisionError
    assert store.count() == 2


def test_snapshots(spark, tmp_path):
    s = Snapshots(spark, str(tmp_path / "snap"))
    one = rows(spark, ("a", "A", 1.0), ("b", "B", 2.0), ("c", "C", None))
    two = rows(spark, ("a", "A", 1.5), ("b", "B", 2.0), ("d", "D", 4.0))
    three = rows(spark, ("b", "B", 2.0), ("d", "D", 5.0))
    full = s.full(one)["name"]
    diff = s.differential(two, full)
    assert {(r["op"], r["id"]) for r in s.data(diff["name"]).collect()} == {("changed", "a"), ("changed", "d"), ("deleted", "c")}
    inc = s.incremental(three, diff["name"])
    assert {(r["op"], r["id"]) for r in s.data(inc["name"]).collect()} == {("changed", "d"), ("deleted", "a")}
    assert state(s.state(inc["name"])) == state(three) and state(s.state(diff["name"])) == state(two)
    assert state(s.restore([full, diff["name"], inc["name"]])) == state(three)
    assert all(s.verify(c["name"]) for c in s.list()) and s.latest("full")["name"] == full
    assert s.retain(most=1) == [] and len(s.list()) == 3  # a kept difference needs its chain
    other = s.full(three)["name"]
    assert len(s.retain(most=1)) == 3 and s.list()[0]["name"] == other
    assert statistics(one)["rows"] == 3


def test_migrations(spark, store):
    steps = [M.add_default("email", "none", "0.0.0", "1.0.0"), M.rename("name", "title", "1.0.0", "1.1.0"), M.Migration("1.1.0", "2.0.0", up=lambda df: df.withColumn("peers", F.lit(2)), down=lambda df: df.drop("peers"))]
    m = M.Migrator(store, steps)
    assert m.version == "0.0.0" and "title" in m.migrate("1.1.0", dry_run=True).columns and m.version == "0.0.0"
    df = m.migrate("2.0.0")
    assert set(df.columns) == {"id", "title", "price", "email", "peers", "__version"} and m.version == "2.0.0" and df.count() == 3
    assert "name" in m.migrate("0.0.0").columns and [x["to"] for x in m.log()] == ["2.0.0", "0.0.0"]
    with pytest.raises(MigrationError):
        m.migrate("9.0.0")
    before = store.latest()
    with pytest.raises(MigrationError):
        M.Migrator(store, [M.Migration("0.0.0", "3.0.0", up=lambda df: df.drop("id"))]).migrate("3.0.0")
    assert store.manifest()["files"] == store.manifest(before)["files"]  # the log alone has moved on


def test_database(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"), 2)
    c = db.collection("people", SCHEMA, cache=True)
    c.source.insert(rows(spark, ("a", "A", 1.0)))
    p = P.Equals("name", "A")
    assert c.find(p).count() == 1 and c.find(p).count() == 1 and c.cache.statistics.hits == 1
    c.source.insert(rows(spark, ("b", "A", 1.0)))
    assert c.find(p).count() == 2  # another version, another key
    assert db.names() == ["people"] and db.statistics()["people"]["documents"] == 2
    with pytest.raises(TypeMismatch):
        db.collection("people", "id string, other long")
    with pytest.raises(StorageError):
        db.collection("1bad", SCHEMA)
    assert valid_id("a-1_B") and not valid_id("a b") and not valid_name("x" * 65) and not valid_field("$x")
    db.drop("people")
    assert db.names() == []


def test_collection_writes(spark, tmp_path):
    c = Database(spark, str(tmp_path / "db"), 2).collection("things", SCHEMA)
    c.insert([{"id": "a", "name": "A", "price": 1.0}, {"id": "b", "name": "B"}, {"name": "no id"}])
    assert len(c) == 3 and c.get("b")["price"] is None
    c.update({"id": "a", "name": "A2", "price": 3.0})
    c.update_where(P.IsNull("price"), {"price": F.lit(7.0)})
    assert c.get("a")["name"] == "A2" and c.count_where(P.Equals("price", 7)) == 2
    assert c.delete("a", "nobody") == 1 and c.delete_where(P.Equals("name", "B")) == 1
    with pytest.raises(DocumentNotFound):
        c.delete_or_raise("a")
    c.upsert({"id": "z", "name": "Z", "price": 0.0})
    assert c.delete_all() == 2 and len(c) == 0
    c.dispose()


def test_cache(spark):
    now = [0.0]
    c = ResultCache(most=2, seconds=10, clock=lambda: now[0])
    ps = [P.Equals("a", 1), P.Equals("b", 1), P.All()]
    df = spark.range(3)
    for p in ps:
        c.put(p, df)
    assert len(c) == 2 and c.statistics.evictions == 1 and ps[0] not in c
    assert c.get(ps[1]) is not None and c.get(ps[0]) is None
    assert c.invalidate_fields("a") == 1  # what reads no field goes with any
    now[0] = 11
    assert c.get(ps[1]) is None and c.statistics.expirations == 1
    assert c.statistics.hit_ratio == pytest.approx(1 / 3)


def test_a_manifest_is_whole_or_absent(spark, tmp_path):
    """Of two writers of one name the second gets nothing, and no reader ever
    sees a part of a file or a draft."""
    from docloom.sources.files import Files

    files, path = Files(spark), str(tmp_path / "manifest" / "1.json")
    assert files.create(path, "first") and not files.create(path, "second")
    assert files.read(path) == "first" and [n for n in files.names(str(tmp_path / "manifest")) if not n.endswith(".crc")] == ["1.json"]


def test_buckets_grow_with_the_table(spark, tmp_path):
    many = spark.range(500).selectExpr("cast(id as string) as id", "concat('n', id) as name", "cast(id as double) as price")
    s = Store(spark, str(tmp_path / "g"), spark.createDataFrame([], SCHEMA).schema, 2, bucket_rows=50)
    s.insert(many.filter("price < 90"))
    assert s.manifest()["buckets"] == 2
    s.upsert(many)
    assert s.manifest()["buckets"] == 16 and s.count() == 500 == s.read().count()
    assert s.get("7").first()["__version"] == 2 and s.get("400").first()["__version"] == 1
    assert s.delete(many.filter("price >= 100").select("id"))[1] == 400 and s.get("450").first() is None


def test_new_ids_are_drawn_once(spark, store):
    v = store.insert(rows(spark, *[(None, f"n{i}", 1.0) for i in range(40)]))
    assert store.read(v).select("id").distinct().count() == 43
    assert not store.files.names(f"{store.root}/incoming")


def test_counts_of_variants(spark):
    df = spark.sql("select cast(id as string) as id, parse_json(concat('{\"a\": ', id, '}')) as doc from range(7)")
    c = Collection(df, variant="doc")
    p = P.Greater("a", 4)
    assert c.find(p).count() == c.count_where(p) == 2 and c.exists_where(p) and not c.exists_where(P.Greater("a", 9))
    assert count_where(df, p, "doc").first()[0] == 2 and exists_where(df, p, "doc").first()[0]


def test_collections_share_a_cache(spark, store):
    cache = ResultCache()
    a, b, c = Collection(spark.range(5), cache=cache), Collection(spark.range(50), cache=cache), Collection(store, cache=cache)
    p = P.Greater("id", 1)
    assert a.find(p).count() == 3 and b.find(p).count() == 48 and a.find(p).count() == 3
    assert cache.statistics.hits == 1
    c.find(P.All())
    assert a.clear_cache() == 1 and len(cache) == 2
    b.disable_cache()
    assert len(cache) == 1 and b.find(p).count() == 48 and len(cache) == 1
    b.enable_cache()
    assert b.find(p).count() == 48 and len(cache) == 2 and b.prune_cache() == 0


def test_indexes_follow_writes(spark, store, tmp_path):
    c = Collection(store)
    c.create_index("price")
    c.create_index("name", "hash")
    assert c.count_where(P.Greater("price", 1.5)) == 2 and c._keys(P.Greater("price", 1.5)) is not None
    assert c._keys(P.Greater("name", "A")) is None and c._keys(P.Equals("price", None)) is None and c._keys(P.NotEquals("price", 1.0)) is None
    saved = str(tmp_path / "indexes")
    assert c.save_indexes(saved) == ["name", "price"]
    again = Collection(store)
    assert again.load_indexes(saved) == ["name", "price"] and again.count_where(P.Equals("name", "A")) == 1
    c.insert({"id": "z", "name": "A", "price": 50.0})
    assert c.count_where(P.Greater("price", 1.5)) == 3 and c.exists_where(P.Between("price", 40.0, 60.0)) and c.count_where(P.In("name", ("A", "B"))) == 3
    assert {r.id for r in c.by_index(c.indexes.key("name").search("A")).collect()} == {"a", "z"}
    store.vacuum(1)
    assert c.count_where(P.Greater("price", 1.5)) == 3
    assert Collection(store).load_indexes(saved) == []  # of an older version


def test_documents_as_objects(spark, store):
    from dataclasses import dataclass
    from datetime import timedelta

    @dataclass
    class Item:
        id: str
        price: timedelta

    c = Collection(store.read().withColumn("price", F.col("price").cast("long")))
    got = {o.id: o.price for o in c.objects(Item, kinds={"price": "duration"})}
    assert got == {"a": timedelta(microseconds=1), "b": timedelta(microseconds=2), "c": timedelta(microseconds=3)}


def test_failed_migrations_are_logged(spark, store):
    bad = M.Migration("0.0.0", "1.0.0", lambda df: df.drop("id"), note="lose")
    m = M.Migrator(store, [bad])
    with pytest.raises(MigrationError):
        m.migrate("1.0.0")
    assert m.version == "0.0.0" and store.count() == 3 and [(e["status"], e["steps"]) for e in m.log()] == [("failed", ["lose"])]
    each = M.per_document(lambda d: d | {"name": d["name"] * 2}, "0.0.0", "1.0.0", lambda d: d | {"name": d["name"][: len(d["name"]) // 2]})
    m = M.Migrator(store, [each])
    assert state(m.migrate("1.0.0"))["a"] == ("AA", 1.0) and state(m.migrate("0.0.0"))["a"] == ("A", 1.0)
    assert [e["status"] for e in m.log()] == ["failed", "success", "success"]


def test_config(spark, tmp_path):
    db = Database(spark, str(tmp_path / "db"))
    c = db.collection("things", SCHEMA, config=CollectionConfig(cached=2, buckets=3, compression="gzip"))
    c.insert({"id": "a", "name": "x", "price": 1.0})
    assert c.cache.most == 2 and c.source.manifest()["buckets"] == 3 and c.source.compression == "gzip"


def test_encryption(spark, tmp_path):
    key, root = b"0123456789abcdef", str(tmp_path / "secret")
    df = spark.sql("select '1' as id, 'Ann' as name, 1.5D as price, timestamp'2024-05-01 10:11:12.123456' as at, timestamp_ntz'2024-05-01 10:11:12.123456' as plain, array('x', null) as tags")
    s = Store(spark, root, df.schema, 2, key=key)
    s.insert(df)
    s.upsert(df.withColumn("name", F.lit("Bea")))
    assert s.read().drop("__version").collect() == df.withColumn("name", F.lit("Bea")).collect() and s.get("1").first()["__version"] == 2
    part = next(iter(s.manifest()["files"].values()))
    assert spark.read.parquet(f"{root}/data/{part}").columns == ["id", "_sealed", "__version"]
    with pytest.raises(StorageError):
        Store(spark, root).read()
    with pytest.raises(Exception):
        Store(spark, root, key=b"fedcba9876543210").read().collect()
