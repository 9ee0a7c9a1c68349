"""Small tables in few files, spread over the cores."""

from __future__ import annotations

from pyspark.sql import DataFrame

#: No table above this size is shuffled for it.
SPREAD_BYTES = 256 << 20
#: Bytes of files to a segment.
SEGMENT_BYTES = 16 << 20


def spread(df: DataFrame) -> DataFrame:
    """``df``, repartitioned if it is small, and read from fewer files than
    there are cores and in only a few splits: a file of one row group is one
    task, whatever its splits say. Anything larger is left as it is, as it has
    more of either, or isn't worth a shuffle."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    if df.rdd.getNumPartitions() > 4 * cores or len(df.inputFiles()) >= cores:
        return df
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(cores) if size <= SPREAD_BYTES else df


def segments(df: DataFrame) -> DataFrame:
    """``df`` in even parts of at most about ``SEGMENT_BYTES`` of the files it
    is read from, equally many for every core: for work on rows that costs far
    more than shuffling them. What isn't read from files is left as it is."""
    leaves = df._jdf.queryExecution().optimizedPlan().collectLeaves()
    size = sum(int(str(leaves.apply(k).stats().sizeInBytes())) for k in range(leaves.size()))
    if size >= 1 << 60:  # unknown
        return df
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores * max(1, -(-size // (cores * SEGMENT_BYTES))))
