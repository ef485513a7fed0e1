"""Sharding by a two-pass external shuffle.

Pass 1 scatters whole records, all columns counted, into buckets of about ``bucket_bytes``
by a seeded hash of doc_id and text checksum, so that neither a hot source nor a group of
copies shares a bucket.  Partitions are as many as hold ``TASK_BUCKETS`` buckets each on average,
so what a task reads does not grow with the input, and chance evens out how many it gets.  Pass 2 shuffles each bucket on its own with a seeded Fisher-Yates permutation.
A record's place in the whole order is its bucket's offset plus its place there; shard
and slot are that place modulo and divided by the number of shards, which is the law
``rows``: shards differ by one row at most and slots have no gaps.  Buckets' counts and
offsets stay tables: a bucket's offset meets its rows in a cogroup.

A rerun, or a task started again after an executor was lost, gives the same order: the
bucket is sorted by hash, id and checksum before it is shuffled.  Where more than
``HEAVY`` rows have one hash (rows that repeat id and text), their place in the input
deals them over the buckets as well; then the order also follows the input's layout.

Defined results: null text has size 16 and the checksum of the empty text; null ids are
hashed like any value; rows that repeat id and text are interchangeable; an empty table
gives no rows.  Extra columns travel with their rows; size, text_crc32, shard and slot
replace columns of these names.
"""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .common import Scratch, row_columns, text_of, with_row

LAW = "rows"
HEAVY = 1000
TASK_BUCKETS = 8
_ADDED = ("size", "text_crc32", "shard", "slot")
_GROUP = 4096  # buckets whose offsets one window adds up


def _offsets(counts: DataFrame) -> DataFrame:
    """counts (bucket, n) -> (bucket, first): rows in the buckets before; by groups of buckets, then over groups."""
    grouped = counts.withColumn("g", F.floor(F.col("bucket") / _GROUP))
    inner = F.sum("n").over(Window.partitionBy("g").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    groups = grouped.groupBy("g").agg(F.sum("n").alias("gn"))
    outer = groups.select(F.col("g").alias("_g"), F.coalesce(F.sum("gn").over(Window.orderBy("g").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    zero = F.lit(0).cast("long")
    return grouped.withColumn("inner", F.coalesce(inner, zero)).join(outer, F.col("g") == F.col("_g")).select("bucket", (F.col("base") + F.col("inner")).cast("long").alias("first"))


def _row_bytes(docs: DataFrame) -> Column:
    """About how many bytes a row has: texts and binaries as they are, nested columns as JSON, 8 for any other."""
    parts = [F.lit(8 * len(docs.columns)).cast("long")]
    for f in docs.schema:
        c = F.col(f"`{f.name}`")
        if isinstance(f.dataType, (T.StringType, T.BinaryType)):
            parts.append(F.coalesce(F.octet_length(c).cast("long"), F.lit(0)))
        elif isinstance(f.dataType, (T.ArrayType, T.MapType, T.StructType)):
            parts.append(F.coalesce(F.octet_length(F.to_json(F.struct(c))).cast("long"), F.lit(0)))
    return reduce(lambda a, b: a + b, parts)


def shuffle_into_shards(docs: DataFrame, n_shards: int = 40, seed: int = 23, bucket_bytes: int = 4 << 20) -> DataFrame:
    """``docs``, all columns, with size, text_crc32, shard and slot added."""
    scratch = Scratch(docs.sparkSession, "sharding")
    text = text_of("text")
    crc = F.crc32(text.cast("binary"))
    rows = with_row(docs, doc_id=F.col("doc_id"), size=(F.octet_length(text) + 16).cast("long"), text_crc32=crc, hash=F.xxhash64(F.lit(seed), F.col("doc_id"), crc), place=F.monotonically_increasing_id(), bytes=_row_bytes(docs))
    hashes = scratch.put(rows.groupBy("hash").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")), "hashes")
    n_buckets = max(1, math.ceil((hashes.agg(F.sum("bytes")).first()[0] or 0) / bucket_bytes))
    spread, heavy = F.col("hash"), hashes.filter(F.col("n") > HEAVY).select(F.col("hash").alias("_heavy"))
    if heavy.limit(1).count():
        rows = rows.join(heavy, F.col("hash") == F.col("_heavy"), "left")
        spread = F.when(F.col("_heavy").isNull(), F.col("hash")).otherwise(F.xxhash64("hash", "place"))
    rows = rows.select("row", "doc_id", "size", "text_crc32", "hash", F.pmod(spread, F.lit(n_buckets)).cast("int").alias("bucket"))
    offsets = _offsets(scratch.put(rows.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")), "counts"))

    def fisher_yates(key: tuple, table: pa.Table, offset: pa.Table) -> pa.Table:
        order = pc.sort_indices(table, [("hash", "ascending"), ("doc_id", "ascending"), ("text_crc32", "ascending")])
        mixed = np.random.default_rng([seed, key[0].as_py()]).permutation(len(order))  # numpy permutes by Fisher-Yates
        place = np.empty(len(order), dtype=np.int64)
        place[mixed] = np.arange(len(order)) + offset["first"][0].as_py()
        table = table.select(["row", "size", "text_crc32"]).take(order)
        return table.append_column("shard", pa.array(place % n_shards, pa.int32())).append_column("slot", pa.array(place // n_shards, pa.int64()))

    schema = T.StructType([rows.schema[c] for c in ("row", "size", "text_crc32")] + [T.StructField("shard", T.IntegerType()), T.StructField("slot", T.LongType())])
    rows = rows.repartition(math.ceil(n_buckets / TASK_BUCKETS), "bucket")
    placed = rows.groupBy("bucket").cogroup(offsets.groupBy("bucket")).applyInArrow(fisher_yates, schema)
    return placed.select(*row_columns(docs, *_ADDED), *_ADDED)


def write_shards(docs: DataFrame, path: str, rows_per_file: int = 1_000_000, **how) -> None:
    """The records as Parquet, one folder per shard, in files of ``rows_per_file`` slots each, sorted by slot."""
    placed = shuffle_into_shards(docs, **how).withColumn("_file", F.floor(F.col("slot") / rows_per_file))
    placed.repartition("shard", "_file").sortWithinPartitions("shard", "slot").drop("_file").write.partitionBy("shard").parquet(path)


def shard_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law, shard, slot, grown_shard."""
    placed = shuffle_into_shards(docs.select("doc_id", "text"), **how)
    return placed.select("doc_id", "size", "text_crc32", F.lit(LAW).alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
