"""Joins by a key that may hold a third of all rows, and batch sizes of Python stages."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tracehound.llm.common import partitions, total


def joined(rows: DataFrame, looked_up: DataFrame, key: str, sizes: DataFrame) -> DataFrame:
    """Inner join of rows with looked_up (one row a key). sizes: key, n, the number of rows of each key.

    Keys with more rows than a quarter of a partition's share, four times the shuffle partitions at most, are broadcast
    with what is looked up for them; only the others are shuffled, so no task gets a hot key.
    """
    spark = rows.sparkSession
    limit = max(1, (total(sizes, F.sum("n"))[0] or 0) // (4 * partitions(spark)))
    hot = F.broadcast(sizes.where(F.col("n") > limit).select(key))
    found = looked_up.join(hot, key)
    cold = rows.join(hot, key, "left_anti").join(looked_up, key)
    return rows.join(F.broadcast(found), key).unionByName(cold)


@contextmanager
def rows_at_once(spark: SparkSession, n: int = 500):
    """Batches of n rows for the Python stages that run inside; the session's own setting holds again afterwards."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    spark.conf.set(name, str(n))
    try:
        yield
    finally:
        spark.conf.set(name, before)
