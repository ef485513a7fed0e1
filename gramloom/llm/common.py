"""Shared pieces: word patterns, one scratch folder per run, let-binding for native lambdas."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: One white-space character, and one word, as Java and RE2 both read them.
SPACE = r"[\x20\x09-\x0D]"
WORD = r"[^\x20\x09-\x0D]+"
#: The characters of SPACE themselves, for trim().
SPACE_CHARS = " \t\n\x0b\x0c\r"


#: Bits that one bitmap of Spark holds, and how many bitmaps are broadcast at most (8 MB).
PIECE_BITS, MAP_PIECES = 32768, 2048


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that setting is missing, a local session (tests) gets a temporary folder, and a
    cluster an error, since its executors would not see one another's files.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-gramloom-")
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


class Scratch:
    """Tables written to the shared folder to cut lineage; each run has a folder of its own."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.root = f"{shared_root(spark)}/{name}-{uuid.uuid4().hex}"

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def put(self, df: DataFrame, name: str) -> DataFrame:
        """Write ``df`` as Parquet and return it as read back."""
        df.write.mode("overwrite").parquet(self.path(name))
        return self.get(name, df)

    def get(self, name: str, like: DataFrame) -> DataFrame:
        return self.spark.read.schema(like.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        """Delete tables that no later step reads."""
        jvm = self.spark._jvm
        for name in names:
            path = jvm.org.apache.hadoop.fs.Path(self.path(name))
            path.getFileSystem(self.spark._jsparkSession.sessionState().newHadoopConf()).delete(path, True)


def with_row(docs: DataFrame, **columns: Column) -> DataFrame:
    """The whole input row as one struct ``row``, and ``columns``: no name of the input can clash."""
    return docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *[v.alias(k) for k, v in columns.items()])


def row_columns(docs: DataFrame, *replaced: str) -> list[Column]:
    """The columns of ``docs`` out of ``row``, less those that an operator's own columns replace."""
    gone = {c.lower() for c in replaced}
    return [F.col(f"row.`{c}`").alias(c) for c in docs.columns if c.lower() not in gone]


def marked(rows: DataFrame, wanted: DataFrame, keys: list[str], name: str) -> DataFrame:
    """``rows`` with a boolean ``name``: true for all rows whose keys are in ``wanted``, and for few others.

    A bitmap of key hashes, of about 16 bits for a key and never more than ``MAP_PIECES``
    pieces of 4 KB, is broadcast.  It keeps rows that cannot match out of a shuffle; with
    more keys it lets more rows through, and the join after it decides.
    """
    pieces = max(1, min(MAP_PIECES, wanted.count() * 16 // PIECE_BITS + 1))
    at = F.pmod(F.xxhash64(*keys), F.lit(pieces * PIECE_BITS)) + 1
    bits = wanted.select(F.bitmap_bucket_number(at).alias("_piece"), F.bitmap_bit_position(at).alias("_bit")).groupBy("_piece").agg(F.bitmap_construct_agg("_bit").alias("_bits"))
    place = F.bitmap_bit_position(F.col("_at"))
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    held = F.pmod(F.floor(byte / F.pow(F.lit(2), F.pmod(place, F.lit(8)))), F.lit(2)) == 1
    placed = rows.withColumn("_at", at).withColumn("_piece", F.bitmap_bucket_number("_at"))
    return placed.join(F.broadcast(bits), "_piece", "left").select(*rows.columns, F.coalesce(held, F.lit(False)).alias(name))


def perhaps_in(rows: DataFrame, wanted: DataFrame, keys: list[str]) -> DataFrame:
    """The rows that :func:`marked` marks."""
    return marked(rows, wanted, keys, "_held").filter("_held").drop("_held")


def one_of_each(rows: DataFrame, keys: list[str], copies: str) -> DataFrame:
    """One row for each value of ``keys``; ``copies`` says how many rows have it, and only repeated ones are shuffled."""
    return rows.filter(F.col(copies) == 1).unionByName(rows.filter(F.col(copies) > 1).dropDuplicates(keys))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` computed once for the row, even inside lambdas of ``body``."""
    return F.transform(F.array(value), body)[0]


def text_of(column: str = "text") -> Column:
    """A text column with null read as empty."""
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def word_count(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def text_identity(text: Column) -> list[Column]:
    """Two 64-bit hashes that together stand for a whole text in joins."""
    return [F.xxhash64(text), F.xxhash64(F.lit(7919), text)]
