"""Exact deduplication over an extendible-hash index kept on shared files.

Texts are equal when identical after every character of ``[\\x20\\x09-\\x0D]`` is deleted.

1. Every row gets a 64-bit hash of its normalised text: a slim table without texts.
2. Index entries are one row per hash, with the number of rows and the best of them.  Map
   tasks combine, so that a text with a third of all rows sends one row per map task.
3. The directory is grown in Spark.  Entries are counted by the top bits of their hash;
   a bucket that holds more than ``bucket_entries`` is split in two, and so doubles the
   directory, until none is overfull: the leaves of that tree are the buckets, and
   the directory has a slot for each value of as many bits as the deepest bucket uses.
4. Buckets are ranges of hashes.  Owner tasks take ranges of buckets, sort their entries
   by hash and write them to the shared folder.
5. Entries of two rows or more are chains.  Only their texts are fetched, and rows of a
   chain are told apart by comparing bytes: Spark's aggregation on (hash, text).  Each
   row probes the chains; rows that are in none are alone.

Defined results: null text is the empty text (all empty or white-space texts are one
group); a null doc_id never wins against another id; rows that repeat doc_id, length and
text are not told apart and carry the same result; an empty table gives no rows.  Extra
columns of any name are ignored, and returned by :func:`drop_exact_copies`.
"""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, Scratch, marked, one_of_each, perhaps_in, row_columns, text_of, with_row

_ID_SPAN = Decimal(10) ** 20  # over 2**64: room for any doc_id below the length
_ID_TOP = Decimal(2**63)
#: Bits of a hash that a directory uses at most.
MOST_BITS = 20


def _priority(length: Column, doc_id: Column) -> Column:
    """One number that orders rows by more code points, then smaller doc_id, null last."""
    wide = "decimal(38,0)"
    span, top = F.lit(_ID_SPAN).cast("decimal(21,0)"), F.lit(_ID_TOP).cast("decimal(20,0)")
    rank = F.coalesce(top - doc_id.cast("decimal(20,0)"), F.lit(0).cast("decimal(20,0)"))
    return (length.cast("decimal(12,0)") * span + rank).cast(wide)


def _winner(priority: Column) -> Column:
    """The doc_id within :func:`_priority`."""
    low = F.pmod(priority, F.lit(_ID_SPAN).cast("decimal(38,0)"))
    return F.when(low > 0, (F.lit(_ID_TOP).cast("decimal(38,0)") - low).cast("long"))


def _top_bits(h: Column, bits: int) -> Column:
    """The first bits of a hash, read as unsigned."""
    return F.shiftrightunsigned(h, 64 - bits) if bits else F.lit(0).cast("long")


def grow_directory(entries: DataFrame, bucket_entries: int, scratch: Scratch) -> DataFrame:
    """The directory as (slot, bucket, depth): which bucket holds the hashes that begin with ``slot``.

    ``entries`` has ``h``.  Loads of all tree nodes come from one count by ``fine`` bits, 16
    times finer than buckets should be; a node is a bucket if it is not overfull and its
    parent is, or if no bits are left.  ``bucket`` grows with the hash.  Slots have as many
    bits as the deepest bucket, which the columns' ``bits`` tells.
    """
    n = entries.count()
    fine = min(MOST_BITS, max(0, (n // max(1, bucket_entries)).bit_length()) + 4)
    cells = entries.groupBy(_top_bits(F.col("h"), fine).alias("cell")).agg(F.count(F.lit(1)).alias("load"))
    every = F.explode(F.sequence(F.lit(0), F.lit(fine))).alias("depth")
    nodes = cells.select("load", "cell", every).groupBy("depth", F.expr(f"shiftright(cell, {fine} - depth)").alias("prefix")).agg(F.sum("load").alias("load"))
    nodes = scratch.put(nodes, "nodes")
    parents = nodes.select((F.col("depth") + 1).alias("depth"), F.col("prefix").alias("parent"), F.col("load").alias("above"))
    placed = nodes.withColumn("parent", F.shiftright("prefix", 1)).join(parents, ["depth", "parent"], "left")
    overfull = F.lit(bucket_entries)
    leaf = (F.coalesce(F.col("above"), overfull + 1) > overfull) & ((F.col("load") <= overfull) | (F.col("depth") == fine))
    leaves = scratch.put(placed.filter(leaf).select("prefix", "depth"), "leaves")
    bits = leaves.agg(F.max("depth")).first()[0] or 0
    first = F.expr(f"shiftleft(prefix, {bits} - depth)")
    slots = leaves.select(first.alias("bucket"), "depth", F.explode(F.sequence(first, F.expr(f"shiftleft(prefix + 1, {bits} - depth) - 1"))).alias("slot"))
    return scratch.put(slots.select("slot", "bucket", "depth", F.lit(bits).alias("bits")), "directory")


def exact_index(docs: DataFrame, bucket_entries: int, scratch: Scratch) -> tuple[DataFrame, DataFrame]:
    """The slim table of rows (without texts), and the chains: h, text_sha256, group_size, best."""
    text, doc_id = text_of("text"), F.col("doc_id").cast("long")
    norm = F.regexp_replace(text, SPACE, "")
    rows = docs.select(doc_id.alias("doc_id"), F.length(text).cast("long").alias("n_code_points"), norm.alias("norm")).withColumn("h", F.xxhash64("norm"))
    keys = scratch.put(rows.select("doc_id", "n_code_points", "h", F.sha2("norm", 256).alias("text_sha256")), "keys")
    entries = scratch.put(keys.groupBy("h").agg(F.count(F.lit(1)).alias("members")), "entries")
    directory = grow_directory(entries, bucket_entries, scratch)
    bits = directory.agg(F.max("bits")).first()[0] or 0
    if bits:
        dealt = entries.withColumn("slot", _top_bits(F.col("h"), bits)).join(directory.select("slot", "bucket"), "slot").drop("slot")
    else:
        dealt = entries.withColumn("bucket", F.lit(0).cast("long"))  # never split
    index = scratch.put(dealt.repartitionByRange("bucket", "h").sortWithinPartitions("bucket", "h"), "index")
    scratch.drop("entries", "nodes", "leaves")
    chained = index.filter("members > 1").select("h")
    fetched = perhaps_in(rows, chained, ["h"]).groupBy("h", "norm").agg(F.count(F.lit(1)).alias("group_size"), F.max(_priority(F.col("n_code_points"), F.col("doc_id"))).alias("best"))
    chains = fetched.join(chained, "h", "left_semi").select("h", F.sha2("norm", 256).alias("text_sha256"), "group_size", "best")
    return keys, scratch.put(chains, "chains")


def exact_groups(docs: DataFrame, bucket_entries: int = 1 << 16) -> DataFrame:
    """One row per document: doc_id, n_code_points, text_sha256, keep_id, group_size, kept."""
    keys, chains = exact_index(docs, bucket_entries, Scratch(docs.sparkSession, "exact-dedup"))
    named = chains.select("h", "text_sha256", "group_size", _winner(F.col("best")).alias("keep_id"), F.floor(F.col("best") / F.lit(_ID_SPAN)).cast("long").alias("keep_length"))
    found = keys.join(named, ["h", "text_sha256"], "left")
    alone = F.col("group_size").isNull()
    kept = alone | (F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_code_points") == F.col("keep_length")))
    return found.select("doc_id", "n_code_points", "text_sha256", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("group_size", F.lit(1).cast("long")).alias("group_size"), kept.alias("kept"))


def drop_exact_copies(docs: DataFrame, bucket_entries: int = 1 << 16) -> DataFrame:
    """The rows of ``docs``, all columns, less the copies: one row of each group stays.

    Rows that repeat the doc_id and text of the row that stays are cut to one as well.  Only
    rows that may be in a chain are shuffled.
    """
    scratch = Scratch(docs.sparkSession, "exact-copies")
    _, chains = exact_index(docs, bucket_entries, scratch)
    text, doc_id = text_of("text"), F.col("doc_id").cast("long")
    norm = F.regexp_replace(text, SPACE, "")
    keyed = with_row(docs, h=F.xxhash64(norm), priority=_priority(F.length(text).cast("long"), doc_id))
    keyed = marked(keyed, chains.select("h"), ["h"], "perhaps")
    some = keyed.filter("perhaps").withColumn("sha", F.sha2(F.regexp_replace(F.coalesce(F.col("row.text").cast("string"), F.lit("")), SPACE, ""), 256))
    best = chains.select(F.col("h").alias("_h"), F.col("text_sha256").alias("_sha"), "best")
    met = some.join(best, (F.col("h") == F.col("_h")) & (F.col("sha") == F.col("_sha")), "left")
    met = scratch.put(met.filter("best IS NULL OR priority = best").select("row", "h", "sha", "priority", "best"), "met")
    alone = met.filter("best IS NULL")
    winners = met.filter("priority = best")
    copies = winners.groupBy(F.col("h").alias("_c1"), F.col("sha").alias("_c2")).agg(F.count(F.lit(1)).alias("copies"))
    repeated = copies.filter("copies > 1")
    single = winners.join(repeated, (F.col("h") == F.col("_c1")) & (F.col("sha") == F.col("_c2")), "left").withColumn("copies", F.coalesce("copies", F.lit(1).cast("long")))
    kept = one_of_each(single, ["h", "sha"], "copies")
    return keyed.filter("NOT perhaps").select("row").unionAll(alone.select("row")).unionAll(kept.select("row")).select(*row_columns(docs))
