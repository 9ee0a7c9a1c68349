"""Differences between snapshots, and their replay.

A difference is a DataFrame (op, id, payload columns): ``changed`` rows carry
the new state, ``deleted`` rows nulls. All joins are on the id; comparisons are
null-safe over the whole payload."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _comparable(name: str, kind: T.DataType):
    c = F.col(name)
    return F.array_sort(F.map_entries(c)) if isinstance(kind, T.MapType) else c


def _packed(df: DataFrame, id_: str, names: Sequence[str], label: str) -> DataFrame:
    kinds = {f.name: f.dataType for f in df.schema}
    return df.select(F.col(id_).alias("id"), F.struct(*names).alias(label), F.struct(*(_comparable(n, kinds[n]).alias(n) for n in names)).alias(label + "_key"))


def changes(base: DataFrame, current: DataFrame, id_: str = "id") -> DataFrame:
    """What turns ``base`` into ``current``: one full outer join on the id."""
    names = [c for c in current.columns if c != id_]
    a, b = _packed(base, id_, names, "old"), _packed(current, id_, names, "new")
    both = a.join(b, "id", "full_outer")
    op = F.when(F.col("new").isNull(), "deleted").when(F.col("old").isNull() | ~F.col("old_key").eqNullSafe(F.col("new_key")), "changed")
    return both.select(op.alias("op"), F.col("id").alias(id_), *(F.col("new")[n].alias(n) for n in names)).filter("op is not null")


def replay(full: DataFrame, diffs: Sequence[DataFrame], id_: str = "id") -> DataFrame:
    """The state after all ``diffs`` in order: the last word on each id wins.
    One aggregation over everything, not a join per difference."""
    names = [c for c in full.columns if c != id_]
    parts = full.select(F.lit("changed").alias("op"), id_, *names, F.lit(0).alias("_step"))
    for k, d in enumerate(diffs, 1):
        parts = parts.unionByName(d.select("op", id_, *names, F.lit(k).alias("_step")))
    last = F.max_by(F.struct("op", *names), "_step").alias("last")
    state = parts.groupBy(id_).agg(last).filter("last.op <> 'deleted'")
    return state.select(id_, *(F.col("last")[n].alias(n) for n in names))


def merged(old: DataFrame, new: DataFrame, id_: str, version: str) -> DataFrame:
    """``old`` with the rows of ``new`` (one an id) put in: one full outer join.
    A row that is put in has the next version, or the first."""
    names = [c for c in old.columns if c not in (id_, version)]
    both = old.select(id_, F.col(version).alias("_v"), F.struct(*names).alias("_old")).join(new.select(id_, F.struct(*names).alias("_new")), id_, "full_outer")
    put = F.col("_new").isNotNull()
    row = F.when(put, F.col("_new")).otherwise(F.col("_old"))
    count = F.when(put, F.coalesce("_v", F.lit(0).cast("long")) + 1).otherwise(F.col("_v"))
    return both.select(id_, *(row[c].alias(c) for c in names), count.alias(version))


def without(old: DataFrame, ids: DataFrame, id_: str) -> DataFrame:
    return old.join(ids.select(id_).distinct(), id_, "left_anti")


def assigned(old: DataFrame, condition: Column, assignments: dict[str, Column], version: str) -> DataFrame:
    """Columns set to expressions of the row where ``condition`` holds."""
    hit = F.coalesce(condition, F.lit(False))
    return old.withColumns({c: F.when(hit, e).otherwise(F.col(c)) for c, e in (assignments | {version: F.col(version) + 1}).items()})


def last_operations(ops: DataFrame, id_: str = "id") -> DataFrame:
    """Of queued operations (seq, op, id, ...) the last on each id."""
    w = Window.partitionBy(id_).orderBy(F.desc("seq"))
    return ops.withColumn("_n", F.row_number().over(w)).filter("_n = 1").drop("_n")


def overlay(state: DataFrame, ops: DataFrame, id_: str = "id") -> DataFrame:
    """``state`` as a transaction with these operations sees it."""
    names = [c for c in state.columns if c != id_]
    last = last_operations(ops, id_)
    untouched = state.join(last.select(id_), id_, "left_anti")
    return untouched.unionByName(last.filter("op <> 'delete'").select(id_, *names))


def conflicts(snapshot: DataFrame, current: DataFrame, ids: DataFrame, id_: str = "id") -> DataFrame:
    """Of the ids read, those whose state differs between two versions."""
    names = [c for c in snapshot.columns if c != id_]
    read = ids.select(id_).distinct()
    a = _packed(snapshot.join(read, id_, "left_semi"), id_, names, "old")
    b = _packed(current.join(read, id_, "left_semi"), id_, names, "new")
    both = a.join(b, "id", "full_outer")
    return both.filter(~F.col("old_key").eqNullSafe(F.col("new_key"))).select(F.col("id").alias(id_))


def digest(df: DataFrame, id_: str = "id") -> tuple[int, str]:
    """(rows, checksum) of a state, whatever its order and partitions."""
    names = sorted(df.columns)
    h = F.conv(F.substring(F.sha2(F.to_json(F.struct(*names), {"ignoreNullFields": "false"}), 256), 1, 15), 16, 10).cast("decimal(38,0)")
    n, s = df.agg(F.count("*"), F.coalesce(F.sum(h), F.lit(0))).first()
    return n, f"{int(s) & (1 << 64) - 1:016x}"
