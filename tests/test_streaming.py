from docloom.plans import predicates as P
from docloom.sources.formats import decrypted, encrypted, read_documents
from docloom.sources.store import Store
from docloom.streaming.changes import find_stream, upsert_stream, windowed_counts
from pyspark.sql import functions as F


def test_stream_upserts(spark, tmp_path):
    src = tmp_path / "in"
    df = spark.createDataFrame([("a", "x", 1.0), ("b", "y", 2.0), ("c", "x", 3.0)], "id string, name string, price double")
    df.coalesce(1).write.parquet(str(src))
    store = Store(spark, str(tmp_path / "s"), df.schema, 2)
    stream = find_stream(spark.readStream.schema(df.schema).parquet(str(src)), P.Equals("name", "x"))
    q = upsert_stream(stream, store, str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert store.count() == 2 and store.meta()["batch"] == 0
    assert store.latest() == 1  # the batch and its number are one commit


def test_windows(spark, tmp_path):
    df = spark.createDataFrame([(1, "2024-01-01 00:00:10"), (2, "2024-01-01 00:00:50"), (3, "2024-01-01 00:01:10")], "id long, t string").withColumn("t", F.to_timestamp("t"))
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    s = windowed_counts(spark.readStream.schema(df.schema).parquet(str(tmp_path / "in")), "t", "1 minute", "1 minute")
    q = s.writeStream.format("memory").queryName("counts").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sorted(r["n"] for r in spark.table("counts").collect()) == [1, 2]


def test_formats(spark, tmp_path):
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "one.json").write_text('{"a": 1,\n "b": [2]}')
    r = read_documents(spark, str(tmp_path / "d")).select("id", F.try_variant_get("doc", "$.a", "int").alias("a")).first()
    assert (r["id"], r["a"]) == ("one", 1)
    key, other = F.lit(b"0123456789abcdef"), F.lit(b"fedcba9876543210")
    df = spark.createDataFrame([(b"secret",)], "x binary").withColumn("e", encrypted(F.col("x"), key))
    got = df.select(decrypted(F.col("e"), key).alias("ok"), decrypted(F.col("e"), other).alias("bad")).first()
    assert bytes(got["ok"]) == b"secret" and got["bad"] is None
