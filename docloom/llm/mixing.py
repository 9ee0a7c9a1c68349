"""Mixing sources to target weights by fitting subset sums.

Every source gets a word budget; documents are counted by exact size, a
proportional share of every size is taken, and bounded-knapsack dynamic
programming over all sizes spends what is left of the budget: the words taken
are the sum nearest to the target that whole documents can make. Which documents
of a size are meant is then a matter of a seeded rank.

Defined results: a null text has size 0; a null source is a source of its own,
sorted last; documents of size 0 are never taken (``taken`` 0 in any case); a
very long text is one document of its size, however large; repeated rows are
documents of their own; ties are broken by a seeded hash of ``doc_id`` and text,
rows without ``doc_id`` coming last; extra columns are kept by
:func:`mixed_documents` and otherwise ignored; an empty table gives an empty
result.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import digests, documents, rank_within, sized_join, text_bytes, written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
CEILING = 2
SEED = 42


def word_count(c: str = "text"):
    return F.size(F.filter(F.split(text_bytes(c), r"[\x20\x09-\x0D]+"), lambda w: w != "")).cast("long")


def source_key(c: str = "source"):
    return F.coalesce(F.concat(F.lit("s"), F.col(c)), F.lit("~"))  # 's' sorts before '~', so null is last


def source_targets(sizes: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: float = CEILING) -> DataFrame:
    """(key, source_size, target) by source, with the excess over the ceiling
    reshared by weight. One row per source is all that meets in one task."""
    src = sizes.groupBy("key").agg(F.sum("size").alias("source_size"))
    nth = (F.row_number().over(Window.orderBy("key")) - 1) % len(weights)
    src = src.withColumn("weight", F.element_at(F.array(*map(F.lit, map(float, weights))), (nth + 1).cast("int")))
    everything = Window.partitionBy(F.lit(0))
    before = Window.partitionBy(F.lit(0)).orderBy("full", "key").rowsBetween(Window.unboundedPreceding, -1)
    src = (
        src.withColumn("full", ceiling * F.col("source_size") / F.col("weight"))
        .withColumn("money", share * F.sum("source_size").over(everything) - F.coalesce(F.sum(ceiling * F.col("source_size")).over(before), F.lit(0)))
        .withColumn("rest", F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
        .withColumn("level", F.col("money") / F.col("rest"))
    )
    # sources in the order in which they fill up: the first that doesn't sets the level for it and all after it
    level = F.min_by(F.when(F.col("full") > F.col("level"), F.col("level")), F.when(F.col("full") > F.col("level"), F.col("full"))).over(everything)
    return src.withColumn("target", F.least(ceiling * F.col("source_size").cast("double"), F.coalesce(level, F.lit(float("inf"))) * F.col("weight"))).select("key", "source_size", "target")


def reachable(moves: list[tuple[int, int, int]], width: int, target: list[int]) -> tuple[int, int] | None:
    """(at, steps): after how many of ``moves`` (index, unit, shift) a sum of
    ``target``, in order of preference, is reached for the first time."""
    reach, mask = 1 << width, (1 << 2 * width + 1) - 1
    for n in range(len(moves) + 1):
        if n:
            reach = moved(reach, moves[n - 1], mask)
        for at in target:
            if 0 <= at + width <= 2 * width and reach >> (at + width) & 1:
                return at, n
    return None


def moved(reach: int, move: tuple[int, int, int], mask: int) -> int:
    shift = move[2]
    return reach | (reach << shift & mask if shift > 0 else reach >> -shift)


def traced(moves: list[tuple[int, int, int]], start: int, at: int, mask: int, out: dict[int, int], held: int = 64) -> int:
    """Which moves lead from ``start`` to the sum at bit ``at``, added to
    ``out``; the bit before them. Keeps at most ``held`` sets at a time, and
    halves the moves beyond that."""
    if len(moves) > held:
        half = len(moves) // 2
        middle = start
        for m in moves[:half]:
            middle = moved(middle, m, mask)
        at = traced(moves[half:], middle, at, mask, out, held)
        return traced(moves[:half], start, at, mask, out, held)
    sets = [start]
    for m in moves:
        sets.append(moved(sets[-1], m, mask))
    for m, before in zip(reversed(moves), reversed(sets[:-1])):
        if not before >> at & 1:
            out[m[0]] = out.get(m[0], 0) + m[1]
            at -= m[2]
    return at


def fit_budget(sizes: np.ndarray, counts: np.ndarray, budget: int, seed: int = SEED) -> np.ndarray:
    """How many of each size to take so that the sum comes nearest to
    ``budget``: a proportional share of every size, one more of some, then
    dynamic programming over changes, both more and fewer, of all sizes.

    The sums reached are bits of an integer that spans a window about the
    budget. It grows until the best sum that the sizes' common divisor allows is
    reached, or until it holds all sums that can matter: with ``w`` the largest
    size, steps from any start to the nearest sum can be put in an order in
    which they stay within ``w`` of the way, and no sum comes twice, so at most
    ``2 w + 2`` of them are needed. So the result is the nearest sum there is."""
    counts = counts.astype(np.int64)
    total = int((sizes * counts).sum())
    budget = max(0, min(int(budget), total))
    if budget == total:
        return counts.copy()
    unit = int(np.gcd.reduce(sizes))
    size = (sizes // unit).astype(np.int64)
    goal, over = divmod(budget, unit)  # sums are multiples of the divisor
    whole = total // unit
    taken = np.array([int(c) * budget // total for c in counts.tolist()], np.int64)
    left = goal - int((size * taken).sum())
    order = np.random.default_rng(seed).permutation(len(size)).tolist()
    for many in (1, None):
        for i in order:
            x = min(int(counts[i] - taken[i]), left // int(size[i]), many or left)
            taken[i] += x
            left -= x * int(size[i])
    largest = int(size.max())
    enough = min(whole, (2 * largest + 2) * largest) + largest
    width = min(enough, max(1 << 12, 2 * left))
    above = bool(over) and goal < whole  # the goal lies between two multiples
    best = [left, left + 1] if above and 2 * over <= unit else [left + 1, left] if above else [left]
    by_size = np.argsort(size, kind="stable").tolist()
    while True:
        moves = []
        for i in by_size:
            for sign, spare in ((1, int(counts[i] - taken[i])), (-1, int(taken[i]))):
                spare, k = min(spare, 2 * width // int(size[i])), 1
                while spare > 0:
                    k = min(k, spare)
                    moves.append((i, sign * k, sign * k * int(size[i])))
                    spare -= k
                    k *= 2
        found = reachable(moves, width, best[:1])
        if found is None and width >= enough:
            found = _nearest(moves, width, left, over, unit)
        if found is not None:
            at, steps = found
            change: dict[int, int] = {}
            traced(moves[:steps], 1 << width, at + width, (1 << 2 * width + 1) - 1, change, max(8, min(64, (1 << 31) // width)))
            for i, k in change.items():
                taken[i] += k
            return taken
        width = min(enough, 4 * width)


def _nearest(moves: list[tuple[int, int, int]], width: int, left: int, over: int, unit: int) -> tuple[int, int]:
    """The sum nearest to the budget, ``left`` units and ``over`` beyond."""
    reach, mask = 1 << width, (1 << 2 * width + 1) - 1
    for m in moves:
        reach = moved(reach, m, mask)
    at = left + width
    low = (reach & ((1 << at + 1) - 1)).bit_length() - 1
    high = reach >> at + 1
    up = at + (high & -high).bit_length() if high else None
    if up is None or low >= 0 and (at - low) * unit + over <= (up - at) * unit - over:
        return low - width, len(moves)
    return up - width, len(moves)


def mix(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """doc_id, size, source_size, target, taken for every document."""
    return _mixed(docs, weights, share, ceiling, seed).select("doc_id", "size", "source_size", "target", (F.col("times") * F.col("size")).cast("long").alias("taken"))


def _mixed(docs: DataFrame, weights: Sequence[float] = WEIGHTS, share: float = SHARE, ceiling: int = CEILING, seed: int = SEED) -> DataFrame:
    """doc_id, digest k1 and k2, size, source_size, target, times.

    A source whose target is its whole size or more takes every document once
    and fits the rest with second copies; hence no document is taken more than
    ``ceiling`` (2) times."""
    assert ceiling == 2, "documents are taken at most twice"
    sizes = docs.select(F.col("doc_id").cast("long").alias("doc_id"), source_key().alias("key"), word_count().alias("size"), *digests())
    sizes = written(sizes.withColumn("salt", F.monotonically_increasing_id()), "sizes")
    targets = written(source_targets(sizes, weights, share, ceiling), "targets")

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        target, whole = float(pdf["target"].iloc[0]), int(pdf["source_size"].iloc[0])
        once = int(target >= whole)
        pdf = pdf.sort_values("size", ignore_index=True)
        size, n = pdf["size"].to_numpy(np.int64), pdf["n"].to_numpy(np.int64)
        some = size > 0
        extra = np.zeros(len(pdf), np.int64)
        if some.any():
            extra[some] = fit_budget(size[some], n[some], round(target) - once * whole, seed)
        return pdf.assign(extra=extra, once=once)

    histogram = sizes.groupBy("key", "size").agg(F.count("*").alias("n")).join(targets, "key")
    chosen = written(histogram.groupBy("key").applyInPandas(fit, "key string, size long, n long, source_size long, target double, extra long, once int").drop("n"), "chosen")
    ranked = rank_within(sizes, ["key", "size"], ["doc_id", "k1"], seed, per_key=chosen, salt="salt")
    times = F.when(F.col("size") > 0, F.col("once") + (F.col("rank") < F.col("extra")).cast("int")).otherwise(0)
    return ranked.select("doc_id", "k1", "k2", "size", "source_size", "target", times.alias("times"))


def mixed_documents(docs: DataFrame, **how) -> DataFrame:
    """``docs`` with every row as often as the mix takes it. Rows that share
    ``doc_id`` and text are told apart by number only."""
    times = _mixed(docs, **how).groupBy("doc_id", "k1", "k2").agg(F.sum("times").cast("int").alias("t"), F.count("*").alias("n"))
    picks = written(times.filter("t > 0").toDF("_docloom_id", "_docloom_k1", "_docloom_k2", "_docloom_t", "_docloom_n"), "picks")
    key = docs.select("*", *digests(("_docloom_a", "_docloom_b")))
    on = F.col("doc_id").cast("long").eqNullSafe(F.col("_docloom_id")) & (F.col("_docloom_a") == F.col("_docloom_k1")) & (F.col("_docloom_b") == F.col("_docloom_k2"))
    both = sized_join(key, picks, on, "inner")
    even = F.col("_docloom_t") % F.col("_docloom_n") == 0
    each = both.filter(even).withColumn("_docloom_m", (F.col("_docloom_t") / F.col("_docloom_n")).cast("int"))
    odd = written(both.filter(~even).withColumn("_docloom_s", F.monotonically_increasing_id()), "odd")
    if not odd.isEmpty():
        # equal rows, numbered: the first ones come once more
        keys = odd.select(F.coalesce(F.col("_docloom_id").cast("string"), F.lit("")).alias("id"), "_docloom_k1", "_docloom_k2", "_docloom_t", "_docloom_n", "_docloom_s")
        number = rank_within(keys, ["id", "_docloom_k1", "_docloom_k2"], ["_docloom_s"])
        times = F.floor(F.col("_docloom_t") / F.col("_docloom_n")) + (F.col("rank") < F.col("_docloom_t") % F.col("_docloom_n")).cast("int")
        number = number.select("_docloom_s", times.cast("int").alias("_docloom_m"))
        each = each.unionByName(odd.join(number, "_docloom_s").drop("_docloom_s"))
    return each.filter("_docloom_m > 0").withColumn("_docloom_copy", F.explode(F.sequence(F.lit(1), F.col("_docloom_m")))).select(*docs.columns)


def op5_subset_sum_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(documents(spark, sf_dir))
