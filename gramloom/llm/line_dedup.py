"""Line deduplication over levelled sorted runs of line hashes.

A line's key is the line without the characters ``[\\x20\\x09-\\x0D]`` at its ends and with
A-Z in lower case.  Keys of at least ``min_length`` code points that are found in at least
``min_docs`` documents lose all their lines in every document; other lines stay.

Documents come in batches.  A batch is summed to (key hash, documents), merge-anti-joined
with the keys that one of the runs already holds as common, and added as a run of level
0.  Runs are cut by ranges of the hash and sorted.  When a level has ``fanout`` runs, they
are merged into one run of the next level, with their counts added.  A last pass over the
documents looks the common keys up; only texts that may hold one are shuffled.

Keys are told apart by two 64-bit hashes.  Every key counts once for a document and is
combined in map tasks, so that a line of a third of all documents is one row per task.

Defined results: null and empty texts have one empty line, which is never dropped when
``min_length`` is 1; each row is a document, also where doc_ids repeat or are null; an
empty table gives no rows.  Extra columns are ignored by :func:`common_lines_report`
and returned by :func:`drop_common_lines`, whose own columns replace those of their names.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACE_CHARS, Scratch, marked, row_columns, text_identity, text_of, with_row

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(SPACE_CHARS)), _UPPER, _LOWER)


def _key_hash(key: Column) -> Column:
    return F.struct(F.xxhash64(key).alias("h1"), F.xxhash64(F.lit(104729), key).alias("h2"))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def _hashes(text: Column, min_length: int) -> Column:
    """The hashes of a text's keys, each once."""
    keys = F.array_distinct(F.transform(_lines(text), line_key))
    return F.transform(F.filter(keys, lambda k: F.length(k) >= min_length), _key_hash)


class LineRuns:
    """Runs of (h1, h2, docs), sorted by hash, by level."""

    def __init__(self, spark: SparkSession, min_docs: int = 10, min_length: int = 1, fanout: int = 4):
        self.scratch = Scratch(spark, "line-runs")
        self.min_docs, self.min_length, self.fanout = min_docs, min_length, fanout
        self.levels: list[list[tuple[str, DataFrame]]] = [[]]
        self.made = 0

    def _write(self, counts: DataFrame, level: int) -> None:
        self.made += 1
        name = f"level{level}-run{self.made}"
        while len(self.levels) <= level:
            self.levels.append([])
        self.levels[level].append((name, self.scratch.put(counts.repartitionByRange("h1", "h2").sortWithinPartitions("h1", "h2"), name)))

    def runs(self) -> list[DataFrame]:
        return [df for level in self.levels for _, df in level]

    def add(self, docs: DataFrame) -> None:
        """One batch: its counts, less keys already known as common, become a run."""
        found = docs.select(F.explode(_hashes(text_of("text"), self.min_length)).alias("k")).select("k.h1", "k.h2")
        counts = found.groupBy("h1", "h2").agg(F.count(F.lit(1)).alias("docs"))
        if runs := self.runs():
            known = reduce(DataFrame.unionAll, [r.filter(F.col("docs") >= self.min_docs).select("h1", "h2") for r in runs])
            counts = counts.join(known.hint("merge"), ["h1", "h2"], "left_anti")
        self._write(counts, 0)
        self._compact()

    def _compact(self) -> None:
        for level in range(len(self.levels)):
            if len(self.levels[level]) >= self.fanout:
                old, self.levels[level] = self.levels[level], []
                self._write(self._merged([df for _, df in old]), level + 1)
                self.scratch.drop(*[name for name, _ in old])

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        return reduce(DataFrame.unionAll, runs).groupBy("h1", "h2").agg(F.sum("docs").alias("docs"))

    def common(self) -> DataFrame:
        """The hashes of keys found in at least ``min_docs`` documents, as a table."""
        runs = self.runs()
        return self.scratch.put(self._merged(runs).filter(F.col("docs") >= self.min_docs).select("h1", "h2"), f"common-{self.made}")


def hash_batches(docs: DataFrame, n: int = 6) -> list[DataFrame]:
    """``docs`` as ``n`` batches by a hash of doc_id, above the fanout whatever the number of files."""
    return [docs.filter(F.pmod(F.xxhash64("doc_id"), F.lit(n)) == k) for k in range(n)]


#: Up to so many different common lines in a text, its lines are filtered in place; beyond, they become rows.
IN_PLACE = 256
_ADDED = ("kept_text", "n_lines", "n_dropped")


def _by_rows(texts: DataFrame, common: DataFrame) -> DataFrame:
    """For texts (t1, t2, text) of many common lines: what stays, by an anti-join of their lines."""
    lines = texts.select("t1", "t2", F.posexplode(_lines(F.col("text"))).alias("at", "line"))
    keyed = lines.withColumn("k", _key_hash(line_key(F.col("line")))).select("t1", "t2", "at", "line", F.col("k.h1").alias("h1"), F.col("k.h2").alias("h2"))
    # a text's own lines come together again, as the text did
    stay = keyed.join(common, ["h1", "h2"], "left_anti").groupBy("t1", "t2").agg(F.sort_array(F.collect_list(F.struct("at", "line"))).alias("stay"))
    return stay.select(F.col("t1").alias("_r1"), F.col("t2").alias("_r2"), F.col("stay.line").alias("by_rows"))


def drop_common_lines(docs: DataFrame, batches: list[DataFrame] | None = None, min_docs: int = 10, min_length: int = 1, fanout: int = 4) -> DataFrame:
    """``docs``, all columns, with kept_text, n_lines and n_dropped added."""
    runs = LineRuns(docs.sparkSession, min_docs, min_length, fanout)
    for batch in batches or [docs]:
        runs.add(batch)
    common = runs.common()
    text = text_of("text")
    one, two = text_identity(text)
    rows = with_row(docs, text=text, t1=one, t2=two)
    held = rows.select("t1", "t2", F.explode(_hashes(F.col("text"), min_length)).alias("k")).select("t1", "t2", "k.h1", "k.h2")
    # a text's hits are no more than its own lines
    hits = held.join(common, ["h1", "h2"]).groupBy(F.col("t1").alias("_t1"), F.col("t2").alias("_t2")).agg(F.collect_set(F.struct("h1", "h2")).alias("gone"))
    hits = runs.scratch.put(hits, "hits")
    flagged = marked(rows, hits.select(F.col("_t1").alias("t1"), F.col("_t2").alias("t2")), ["t1", "t2"], "perhaps")
    met = flagged.filter("perhaps").join(hits, (F.col("t1") == F.col("_t1")) & (F.col("t2") == F.col("_t2")), "left")
    in_place = F.filter(_lines(F.col("text")), lambda x: ~F.array_contains(F.col("gone"), _key_hash(line_key(x))))
    stay = F.when(F.size("gone") <= IN_PLACE, in_place)
    if hits.filter(F.size("gone") > IN_PLACE).limit(1).count():
        many = met.filter(F.size("gone") > IN_PLACE).select("t1", "t2", "text").dropDuplicates(["t1", "t2"])
        met = met.join(_by_rows(many, common), (F.col("t1") == F.col("_r1")) & (F.col("t2") == F.col("_r2")), "left")
        stay = F.coalesce(stay, F.col("by_rows"), F.when(F.size("gone") > IN_PLACE, F.array().cast("array<string>")))
    met = met.withColumn("stay", F.when(F.col("gone").isNotNull(), stay))
    n_lines = F.size(_lines(F.col("text"))).cast("long")
    kept_text = F.when(F.col("gone").isNull(), F.col("text")).otherwise(F.array_join("stay", "\n"))
    n_dropped = F.when(F.col("gone").isNull(), F.lit(0).cast("long")).otherwise(n_lines - F.size("stay"))
    cleaned = met.select("row", kept_text.alias("kept_text"), n_lines.alias("n_lines"), n_dropped.alias("n_dropped"))
    whole = flagged.filter("NOT perhaps").select("row", F.col("text").alias("kept_text"), n_lines.alias("n_lines"), F.lit(0).cast("long").alias("n_dropped"))
    return whole.unionAll(cleaned).select(*row_columns(docs, *_ADDED), *_ADDED)


def common_lines_report(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256."""
    return drop_common_lines(docs.select("doc_id", "text"), **how).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))
