"""Numbers of shuffle partitions that grow with what is shuffled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows that one task should sort or group about (some 100 MB), and below which a task of its own does not pay.
TASK_ROWS, LEAST_ROWS = 1 << 20, 1 << 15


def parts_of(df: DataFrame, n: int, each: int | None = None) -> int:
    """Partitions for ``n`` rows of about ``each``; less data still meets all cores, where it pays."""
    each = TASK_ROWS if each is None else each
    return max(1, -(-n // each), min(df.sparkSession.sparkContext.defaultParallelism, -(-n // LEAST_ROWS)))


def spread(df: DataFrame, n: int, *keys: Column | str, each: int | None = None) -> DataFrame:
    """``df`` by keys in as many partitions as ``n`` rows need; Spark merges none of them.

    A number of its own beats ``spark.sql.shuffle.partitions``, by which tasks grow with the data.
    Joins and groups on the keys use these partitions and make no others.
    """
    return df.repartition(parts_of(df, n, each), *keys)


def pairs_met(left: DataFrame, right: DataFrame | None, key: str, n: int) -> int:
    """How many pairs of rows have equal keys, for ``n`` rows; without ``right``, of ``left`` with itself."""
    count = lambda df, name: spread(df.select(key), n, key).groupBy(key).agg(F.count(F.lit(1)).alias(name))
    met = count(left, "m").withColumn("n", F.col("m")) if right is None else count(left, "m").join(count(right, "n"), key)
    return int(met.agg(F.sum(F.col("m").cast("double") * F.col("n"))).first()[0] or 0)
