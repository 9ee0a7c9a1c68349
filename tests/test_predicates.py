"""Compiled predicates against a row-by-row restatement of their meaning."""

import random
import re
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from docloom.operators.collection import Collection, find
from docloom.plans import predicates as P
from docloom.plans.builder import Where
from docloom.plans.compiler import compile_predicate

ROWS = [
    (1, "Red Widget", 10.5, 3, True, ["a", "b"], datetime(2024, 1, 1)),
    (2, "blue gadget", None, 5, False, ["b", None], datetime(2024, 2, 1)),
    (3, None, 20.0, None, None, None, None),
    (4, "", 0.0, 0, True, [], datetime(2024, 3, 1)),
    (5, "the quick brown fox. Fox!", -1.0, 3, False, ["c"], datetime(2023, 1, 1)),
    (6, "quick, lazy brown sleepy fox", 20.0, 7, None, ["a"], datetime(2024, 1, 1)),
]
SCHEMA = "id long, name string, price double, size long, live boolean, tags array<string>, at timestamp"
NAMES = [c.split()[0] for c in SCHEMA.split(", ")]


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame(ROWS, SCHEMA).coalesce(1).cache()


def number(x):
    return isinstance(x, (int, float)) and not isinstance(x, bool)


def alike(a, b):
    return (number(a) and number(b)) or type(a) is type(b)


def holds(p, d):
    """What a predicate means for one document."""
    v = d.get(getattr(p, "field", None))
    match p:
        case P.All():
            return True
        case P.Not():
            return not holds(p.inner, d)
        case P.And():
            return all(holds(x, d) for x in p.parts)
        case P.Or():
            return any(holds(x, d) for x in p.parts)
        case P.Equals():
            return v is None if p.value is None else v is not None and alike(v, p.value) and v == p.value
        case P.NotEquals():
            return not holds(P.Equals(p.field, p.value), d)
        case P.In():
            return any(holds(P.Equals(p.field, x), d) for x in p.values)
        case P.NotIn():
            return not holds(P.In(p.field, p.values), d)
        case P.IsNull():
            return v is None
        case P.IsNotNull() | P.Exists():
            return v is not None
        case P.Greater() | P.GreaterOrEqual() | P.Less() | P.LessOrEqual():
            if v is None or isinstance(v, bool) or not alike(v, p.value) or isinstance(p.value, bool):
                return False
            return {P.Greater: v > p.value, P.GreaterOrEqual: v >= p.value, P.Less: v < p.value, P.LessOrEqual: v <= p.value}[type(p)]
        case P.Between():
            return holds((P.GreaterOrEqual if p.with_low else P.Greater)(p.field, p.low), d) and holds((P.LessOrEqual if p.with_high else P.Less)(p.field, p.high), d)
    if isinstance(p, P.Contains) and isinstance(v, list):
        return p.value in v
    if not isinstance(v, str):
        return False
    case = getattr(p, "case", True)
    fold = (lambda s: s) if case else str.lower
    match p:
        case P.Contains():
            return isinstance(p.value, str) and fold(p.value) in fold(v)
        case P.StartsWith():
            return fold(v).startswith(fold(p.prefix))
        case P.EndsWith():
            return fold(v).endswith(fold(p.suffix))
        case P.Matches():
            return bool(re.search(p.pattern, v, 0 if case else re.I))
        case P.TextAll():
            return all(t in fold(v) for t in re.split(r"[\s\W]+", fold(p.text)) if len(t) >= 2)
        case P.TextPhrase():
            return fold(p.phrase) in fold(v)
        case P.TextAny():
            return not p.terms or any(fold(t) in fold(v) for t in p.terms)
        case P.TextPrefix():
            return not p.prefix or any(t.startswith(fold(p.prefix)) for t in re.split(r"[\s\W]+", fold(v)))
        case P.TextNear():
            if len(p.terms) < 2:
                return all(fold(t) in fold(v) for t in p.terms)
            tk = re.split(r"[\s\W]+", fold(v))
            at = [[i for i, t in enumerate(tk) if t == fold(x)] for x in p.terms]
            starts = [i for a in at for i in a]
            return any(all(any(s <= i <= s + p.distance for i in a) for a in at) for s in starts)
    raise AssertionError(p)


LEAVES = [
    P.All(),
    P.Equals("name", "Red Widget"),
    P.Equals("price", 20),
    P.Equals("size", 3.0),
    P.Equals("size", None),
    P.Equals("size", "3"),
    P.Equals("live", True),
    P.Equals("live", 1),
    P.Equals("tags", ["a", "b"]),
    P.Equals("at", datetime(2024, 1, 1)),
    P.Equals("nowhere", None),
    P.Equals("nowhere", 1),
    P.NotEquals("size", 3),
    P.NotEquals("size", None),
    P.Greater("price", 10),
    P.Greater("name", 5),
    P.Greater("live", False),
    P.GreaterOrEqual("size", 3),
    P.Less("at", datetime(2024, 1, 15)),
    P.LessOrEqual("price", 0.0),
    P.Between("size", 3, 5),
    P.Between("size", 3, 5, False, True),
    P.Between("size", 3, 5, True, False),
    P.Between("size", 3, 5, False, False),
    P.In("size", (3, 7, 3)),
    P.In("size", (3, None)),
    P.In("size", ()),
    P.In("size", ("x", 5)),
    P.NotIn("size", (3,)),
    P.NotIn("size", (3, None)),
    P.In("at", (datetime(2024, 1, 1),)),
    P.IsNull("name"),
    P.IsNotNull("tags"),
    P.Exists("price"),
    P.Exists("nowhere"),
    P.Contains("name", "g"),
    P.Contains("name", "RED", False),
    P.Contains("name", ""),
    P.Contains("tags", "b"),
    P.Contains("tags", None),
    P.Contains("tags", 4),
    P.Contains("size", "3"),
    P.StartsWith("name", "Red"),
    P.StartsWith("name", "BLUE", False),
    P.EndsWith("name", "fox"),
    P.EndsWith("name", "GET", False),
    P.Matches("name", r"^[a-z]+ "),
    P.Matches("name", r"WIDGET$", False),
    P.TextAll("name", "fox, quick"),
    P.TextAll("name", "a !"),
    P.TextPhrase("name", "Quick Brown"),
    P.TextAny("name", ("gadget", "fox")),
    P.TextAny("name", ()),
    P.TextPrefix("name", "sle"),
    P.TextPrefix("name", ""),
    P.TextNear("name", ("quick", "fox"), 2),
    P.TextNear("name", ("quick", "fox"), 4),
    P.TextNear("name", ("quick", "fox"), 1),
    P.TextNear("name", ("quick",), 1),
]


def docs():
    return [dict(zip(NAMES, r)) for r in ROWS]


def check(df, preds):
    """All predicates in one job: positive and negated form."""
    cols = [compile_predicate(p, df).alias(f"p{i}") for i, p in enumerate(preds)]
    neg = [compile_predicate(~p, df).alias(f"n{i}") for i, p in enumerate(preds)]
    got = {r["id"]: r for r in df.select("id", *cols, *neg).collect()}
    for d in docs():
        for i, p in enumerate(preds):
            want = holds(p, d)
            assert got[d["id"]][f"p{i}"] in ((True,) if want else (False, None)), (p, d)
            # a filter drops nulls, so a negation must never be null when it holds
            assert bool(got[d["id"]][f"n{i}"]) is (not want), ("not", p, d)


def test_leaves(df):
    check(df, LEAVES)


def test_random_trees(df):
    rng = random.Random(7)

    def tree(depth):
        if depth == 0 or rng.random() < 0.3:
            return rng.choice(LEAVES)
        kind = rng.choice("aon")
        if kind == "n":
            return ~tree(depth - 1)
        return (P.And if kind == "a" else P.Or)(tuple(tree(depth - 1) for _ in range(rng.randint(1, 3))))

    check(df, [tree(3) for _ in range(60)])


def test_wire_format():
    for p in [*LEAVES[:9], *LEAVES[10:18], *LEAVES[19:30], *LEAVES[31:], ~(LEAVES[1] & LEAVES[2]), LEAVES[3] | LEAVES[4]]:
        again = P.Predicate.from_dict(p.to_dict())
        assert again.to_dict() == p.to_dict() and type(again) is type(p)
    assert P.Between("a", 1, 2).to_dict() == {"type": "BetweenQuery", "field": "a", "lowerBound": 1, "upperBound": 2, "includeLower": True, "includeUpper": True}
    with pytest.raises(ValueError):
        P.Predicate.from_dict({"type": "Nothing"})
    with pytest.raises(ValueError):
        P.And(())
    with pytest.raises(ValueError):
        P.Between("a", None, 1)
    assert P.Equals("a", 1).key() != P.Equals("a", "1").key() != P.Equals("a", True).key()


def test_builder():
    a, b, c = P.Equals("x", 1), P.Equals("y", 2), P.Equals("z", 3)
    w = Where().equals("x", 1).equals("y", 2).equals("z", 3)
    assert w.build() == P.And((P.And((a, b)), c))
    assert Where().equals("x", 1).or_(b).equals("z", 3).build() == P.And((P.Or((a, b)), c))
    assert Where().or_all([]).build_or_all() == P.All() and Where().or_all([a, b, c]).build() == P.Or((a, b, c))
    assert not Where().has_conditions and not w.reset().has_conditions
    with pytest.raises(ValueError):
        Where().build()


def test_pushed_filters(spark, sf_dir):
    part = spark.read.parquet(f"{sf_dir}/part.parquet")
    for p, shown in [
        (P.Greater("p_size", 5), "GreaterThan(p_size,5)"),
        (~P.Greater("p_size", 5), "Or(IsNull(p_size),LessThanOrEqual(p_size,5))"),
        (P.In("p_type", ("PROMO", "SMALL")), "In(p_type"),
        (P.StartsWith("p_type", "PRO"), "StringStartsWith(p_type,PRO)"),
        (~P.Equals("p_type", "PROMO"), "Or(IsNull(p_type),Not(EqualTo(p_type,PROMO)))"),
    ]:
        plan = find(part, p)._jdf.queryExecution().toString()
        assert shown in plan, plan


def test_maps_variants_presence(spark):
    d = spark.createDataFrame([(1, {"a": 1, "b": 2}, '{"a": {"b": 5}, "n": null}', ["m"]), (2, {"a": 3}, '{"a": {"b": "x"}}', []), (3, None, None, None)], "id long, m map<string,long>, j string, __present array<string>")
    d = d.withColumn("doc", F.try_parse_json("j"))
    ids = lambda p: sorted(r.id for r in find(d, p).collect())
    assert ids(P.Equals("m", {"b": 2, "a": 1})) == [1] and ids(~P.Equals("m", {"a": 3})) == [1, 3]
    assert ids(P.Greater("m.a", 1)) == [2] and ids(P.IsNull("m.b")) == [2, 3]
    assert ids(P.Equals("doc.a.b", 5)) == [1] and ids(P.Equals("doc.a.b", "x")) == [2] and ids(P.NotEquals("doc.a.b", 5)) == [2, 3]
    assert ids(P.IsNull("doc.n")) == [1, 2, 3]
    assert ids(P.Exists("m")) == [1]
    plain = d.drop("__present")
    assert sorted(r.id for r in find(plain, P.Exists("doc.n")).collect()) == [1]
    assert sorted(r.id for r in find(plain.drop("m"), P.Equals("a.b", 5), variant="doc").collect()) == [1]


def test_collection(df):
    c = Collection(df)
    assert c.get(2).name == "blue gadget" and c.get(99) is None and c.exists(1)
    assert [r.id for r in c.get_many([5, 99, 1]).collect()] == [5, 1]
    assert c.count_where() == 6 and c.count_where(P.Equals("size", 3)) == 2
    assert c.exists_where(P.IsNull("name")) and not c.exists_where(P.Equals("size", 77))
    assert c.find_one(P.Equals("size", 3)).id == 1
    assert len(list(c.stream())) == 6
    c.create_index("size", "btree")
    assert sorted(r.id for r in c.by_index(c.indexes.key("size").greater(3)).collect()) == [2, 6]
    assert "Equals" in c.explain(P.Equals("size", 3))["tree"] and c.explain(P.Equals("size", 3))["indexed"] == ["size"]
