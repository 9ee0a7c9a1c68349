import pytest

LONG = " ".join(f"word{i % 977}x{i % 31}" for i in range(30000))


@pytest.fixture
def docs(spark):
    """Documents with extra columns whose names the operators use themselves."""

    def make(rows, schema="doc_id long, text string, lang string, source string"):
        df = spark.createDataFrame([(r + (None, None))[:4] if isinstance(r, tuple) else r for r in rows], schema)
        from pyspark.sql import functions as F

        for c in ("k1", "spans", "rank", "fp", "size", "key", "h", "f", "shard", "band", "n", "old"):
            df = df.withColumn(c, F.lit("clash"))
        return df

    return make


@pytest.fixture
def awkward():
    """Nulls, empties, blanks, one huge text, copies, a repeated row."""
    base = "the quick brown fox jumps over the lazy dog and runs far away from the big bad wolf " * 4
    return [(1, None), (2, ""), (3, " \t\n"), (4, base), (5, base), (6, base + "x"), (7, LONG), (8, "é" * 300), (8, "é" * 300), (9, "one two"), (None, base), (10, "aaaa" * 500)]
