"""Language-model scores: stupid backoff over n-gram tables, computed relationally.

:func:`score_words`, which op9 runs, has words as units and the order 2: see there.

In :func:`score` the unit is the UTF-8 byte, the order 5, and a text starts with four start
symbols, so that every position has a full 5-gram, packed exactly (no hash) into 45 bits.  An n-gram
seen fewer than ``min_count`` times in the corpus backs off to its last n-1 units, with
the factor ``alpha``; single bytes always count.

1. Documents are dealt into blocks of about ``block_bytes`` by a hash.  Each block sends
   its distinct 5-grams with counts, so that a very common n-gram is one row per block.
2. Counts are summed into one table, partitioned by the n-gram's hash.  Shorter n-grams
   and contexts are sums over it, and every 5-gram gets the logarithm of its score by
   joins on its suffixes.
3. The blocks' n-grams are joined to that table, come back to their block, and are summed
   over each document's positions.

Defined results: null and empty texts have 0 positions and score 0; texts are scored
whole; rows that repeat are counted as often as they occur; an empty table gives no
rows.  Extra columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import hash_words, mix64, slices, words_of
from .common import Scratch, text_of

ORDER, BITS = 5, 9
_START = 1 << 8  # the start symbol, above every byte
#: Numbers that keep the hashes of words and pairs apart; the start symbol; the key of the empty n-gram.
_PAIR = np.uint64(0x9E3779B97F4A7C15)
_START_HASH, _ONE, _EMPTY_GRAM = np.uint64(0x165667B19E3779F9), np.uint64(1), 0
#: Buckets of :func:`score_words` for each block of texts, bytes of a key in its bucket, and keys sent at once.
BUCKETS_A_BLOCK, _KEY_BYTES, BATCH_KEYS = 8, 6, 1 << 18


def _grams(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The 5-gram ending at every byte of the texts in a row, and each text's bounds."""
    texts = texts.cast(pa.large_string())
    at = np.frombuffer(texts.buffers()[1], dtype=np.int64)[texts.offset : texts.offset + len(texts) + 1]
    data = texts.buffers()[2]
    raw = np.frombuffer(data, dtype=np.uint8)[at[0] : at[-1]] if data is not None else np.zeros(0, np.uint8)
    at = at - at[0]
    # each text with its start symbols in front
    n = np.diff(at)
    units = np.full(len(raw) + (ORDER - 1) * len(n), _START, dtype=np.int64)
    place = np.arange(len(raw)) + np.repeat((ORDER - 1) * (np.arange(len(n)) + 1), n)
    units[place] = raw
    grams = np.zeros(len(raw), dtype=np.int64)
    for k in range(ORDER - 1, -1, -1):
        grams = (grams << BITS) | units[place - k]
    return grams, at


def _suffix(n: int) -> Column:
    return F.col("gram").bitwiseAND(F.lit((1 << BITS * n) - 1))


def backoff_table(counts: DataFrame, alpha: float, min_count: int) -> DataFrame:
    """counts (gram, c) of all 5-grams -> (gram, score): log of the stupid-backoff score."""

    def level(n: int) -> DataFrame:
        """(s, r): the log ratio of each n-gram that occurs often enough, or of any byte."""
        own = counts.groupBy(_suffix(n).alias("s")).agg(F.sum("c").alias("c"))
        context = own.groupBy(F.shiftright("s", BITS).alias("p")).agg(F.sum("c").alias("all"))
        ratio = own.join(context, F.shiftright("s", BITS) == F.col("p"))
        return ratio.filter(F.col("c") >= (min_count if n > 1 else 1)).select("s", F.log(F.col("c") / F.col("all")).alias("r"))

    scored = counts.select("gram")
    for n in range(ORDER, 0, -1):
        scored = scored.join(level(n).withColumnsRenamed({"s": f"s{n}", "r": f"r{n}"}), _suffix(n) == F.col(f"s{n}"), "left").drop(f"s{n}")
    steps = [F.col(f"r{n}") + F.lit((ORDER - n) * math.log(alpha)) for n in range(ORDER, 0, -1)]
    return scored.select("gram", F.coalesce(*steps).alias("score"))


def score(docs: DataFrame, alpha: float = 0.4, min_count: int = 2, block_bytes: int = 32 << 20) -> DataFrame:
    """One row per document: doc_id, n_units, log_score (sum), mean_log_score."""
    scratch = Scratch(docs.sparkSession, "lm-scoring")
    total = docs.agg(F.sum(F.octet_length(text_of("text")).cast("long"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    text = text_of("text")
    rows = docs.select("doc_id", text.alias("text")).withColumn("block", F.pmod(F.xxhash64("doc_id", "text"), F.lit(n_blocks)).cast("int"))

    def distinct(key: tuple, table: pa.Table) -> pa.Table:
        sums: dict[str, list[np.ndarray]] = {"gram": [], "c": []}
        for batch in table.to_batches():
            for part in slices(batch):
                code, gram = pd.factorize(_grams(part.column("text"))[0])
                sums["gram"].append(gram)
                sums["c"].append(np.bincount(code, minlength=len(gram)))
        code, gram = pd.factorize(np.concatenate([*sums["gram"], np.zeros(0, np.int64)]))
        c = np.bincount(code, weights=np.concatenate([*sums["c"], np.zeros(0)]), minlength=len(gram)).astype(np.int64)
        return pa.table({"block": pa.array(np.full(len(gram), key[0].as_py()), pa.int32()), "gram": pa.array(gram, pa.int64()), "c": pa.array(c, pa.int64())})

    sent = scratch.put(rows.groupBy("block").applyInArrow(distinct, "block int, gram long, c long"), "sent")
    counts = scratch.put(sent.groupBy("gram").agg(F.sum("c").alias("c")), "counts")
    table = scratch.put(backoff_table(counts, alpha, min_count), "scores")
    answers = sent.select("block", "gram").join(table, "gram")

    def add_up(texts: pa.Table, known: pa.Table) -> pa.Table:
        index, value = pd.Index(known["gram"].to_numpy()), known["score"].to_numpy()
        sums, sizes = [], []
        for batch in texts.to_batches():
            for part in slices(batch):
                grams, at = _grams(part.column("text"))
                each = np.concatenate([[0.0], np.cumsum(value[index.get_indexer(grams)])]) if len(grams) else np.zeros(1)
                sums.append(each[at[1:]] - each[at[:-1]])
                sizes.append(np.diff(at))
        return pa.table({"doc_id": texts["doc_id"], "n_units": pa.array(np.concatenate([*sizes, np.zeros(0, np.int64)]), pa.int64()), "log_score": pa.array(np.concatenate([*sums, np.zeros(0)]), pa.float64())})

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, f"doc_id {kind}, n_units long, log_score double")
    return found.select("doc_id", "n_units", "log_score", F.when(F.col("n_units") > 0, F.col("log_score") / F.col("n_units")).otherwise(F.lit(0.0)).alias("mean_log_score"))


def _pair_keys(hashes: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For every word of the texts in a row the key of its pair, and the hash of the word before it.

    Keys are hashes of 63 bits and one bit for the kind: pairs are odd, other n-grams even.
    The word before the first word of a text is the start symbol.
    """
    before = np.concatenate([[_START_HASH], hashes[:-1]]) if len(hashes) else hashes
    before[at[:-1][at[:-1] < at[1:]]] = _START_HASH
    return (mix64(mix64(before) * _PAIR + hashes) | _ONE).view(np.int64), before


def _word_keys(hashes: np.ndarray) -> np.ndarray:
    return (mix64(hashes ^ _PAIR) & ~_ONE).view(np.int64)


def _lists(group: np.ndarray, keys: np.ndarray, counts: np.ndarray, lasts: np.ndarray) -> list[pa.Array]:
    """The groups, and for each its keys (cut to _KEY_BYTES) and both counts, in order of counts: long runs compress well."""
    order = np.lexsort((lasts, counts, group))
    held, first = np.unique(group[order], return_index=True)
    bounds = np.append(first, len(keys)).astype(np.int32)
    raw = np.ascontiguousarray(keys[order].view(np.uint8).reshape(-1, 8)[:, :_KEY_BYTES])
    blobs = pa.Array.from_buffers(pa.binary(), len(held), [None, pa.py_buffer(bounds * _KEY_BYTES), pa.py_buffer(raw)])
    of = lambda x: pa.ListArray.from_arrays(pa.array(bounds), pa.array(x[order].astype(np.int64)))
    return [pa.array(held, pa.int32()), blobs, of(counts), of(lasts)]


def _from_lists(batch: pa.RecordBatch, label: str) -> tuple[np.ndarray, ...]:
    """Per key of :func:`_lists` the row's number under ``label``, the key, and both counts."""
    lists = batch.column("counts")
    own = np.repeat(batch.column(label).to_numpy(), pc.list_value_length(lists).to_numpy())
    blobs = batch.column("keys")
    at = np.frombuffer(blobs.buffers()[1], dtype=np.int32)[blobs.offset : blobs.offset + len(blobs) + 1]
    keys = np.zeros((len(own), 8), np.uint8)
    if len(own):
        keys[:, :_KEY_BYTES] = np.frombuffer(blobs.buffers()[2], dtype=np.uint8)[at[0] : at[-1]].reshape(-1, _KEY_BYTES)
    return own, keys.view(np.int64).ravel(), lists.flatten().to_numpy(), batch.column("lasts").flatten().to_numpy()


def _buckets(keys: np.ndarray, n_buckets: int) -> np.ndarray:
    return (mix64(keys.view(np.uint64)) % np.uint64(n_buckets)).astype(np.int32)


def _in_block(keys: np.ndarray, buckets: np.ndarray) -> np.ndarray:
    """The cut key below the last bits of its bucket."""
    return (keys & (1 << 8 * _KEY_BYTES) - 1) | (buckets.astype(np.int64) << 8 * _KEY_BYTES)


class _Counts:
    """Counts of keys, merged whenever as many new ones wait as are held."""

    def __init__(self) -> None:
        self.keys, self.sums = np.zeros(0, np.int64), np.zeros(0, np.int64)
        self.waiting: list[np.ndarray] = []
        self.size = 0

    def add(self, keys: np.ndarray) -> None:
        self.waiting.append(keys)
        self.size += len(keys)
        if self.size > max(len(self.keys) // 2, 1 << 20):
            self.merge()

    def merge(self) -> None:
        code, keys = pd.factorize(np.concatenate([self.keys, *self.waiting]))
        weights = np.concatenate([self.sums, np.ones(self.size, np.int64)])
        self.keys, self.sums = keys, np.bincount(code, weights=weights, minlength=len(keys)).astype(np.int64)
        self.waiting, self.size = [], 0


def score_words(docs: DataFrame, alpha: float = 0.4, min_count: int = 2, block_bytes: int = 12 << 20) -> DataFrame:
    """As :func:`score`, over word pairs: doc_id, n_units (words), log_score, mean_log_score.

    A word is a run of characters that are not white space; before the first word of a text
    stands the start symbol.  A pair seen fewer than ``min_count`` times backs off to its second
    word.

    1. Texts are dealt into blocks of about ``block_bytes``.  A block sends its distinct n-grams
       (pairs, words, and the empty one, which counts all words) once each, with their counts, and
       how often a word is the last of a text, which makes it no context.  They are dealt into
       buckets by 64-bit hashes, and in a bucket, which holds a few hundred thousand n-grams at any
       size of the corpus, keyed by 48 bits of them: a pair shares its key, and so its count, with
       another one with a chance of 1e-7 or less up to 10^12 different pairs.
    2. The n-grams are partitioned by a hash into these buckets, and each one's counts
       are added up over all blocks.  A very common n-gram is one entry per block.
    3. Each block gets back the totals of its words, and of those pairs that occur often enough;
       what is missing backs off.  Scores are summed over each document.

    The texts are shuffled once: both uses of the blocks are one exchange.
    """
    text = text_of("text")
    total = docs.agg(F.sum(F.octet_length(text).cast("long"))).first()[0] or 0
    n_blocks = max(1, math.ceil(total / block_bytes))
    n_buckets = n_blocks * BUCKETS_A_BLOCK
    block = F.pmod(F.xxhash64("doc_id", text), F.lit(n_blocks)).cast("int")
    rows = docs.select("doc_id", text.alias("text"), block.alias("block"))

    def distinct(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, ends, n = _Counts(), _Counts(), 0
        for batch in batches:
            for part in slices(batch):
                words, at = words_of(part.column("text"), lower=False)
                hashes, last = hash_words(words), at[1:][at[:-1] < at[1:]] - 1
                n += len(words)
                counts.add(_pair_keys(hashes, at)[0])
                counts.add(_word_keys(np.append(hashes, np.full(len(last), _START_HASH))))
                ends.add(_word_keys(hashes[last]))
        counts.merge()
        ends.merge()
        lasts = np.zeros(len(counts.keys) + 1, np.int64)
        lasts[pd.Index(counts.keys).get_indexer(ends.keys)] = ends.sums
        keys, sums = np.append(counts.keys, _EMPTY_GRAM), np.append(counts.sums, n)
        del counts, ends
        bucket = _buckets(keys, n_buckets)
        order = np.argsort(bucket, kind="stable")
        # a few buckets at a time
        edges = np.append(np.flatnonzero(np.diff(bucket[order], prepend=-1)), len(order))
        edges = edges[np.append(np.flatnonzero(np.diff(edges[:-1] // BATCH_KEYS, prepend=-1)), len(edges) - 1)]
        for a, b in zip(edges, edges[1:]):
            some = order[a:b]
            held, *lists = _lists(bucket[some], keys[some], sums[some], lasts[some])
            blocks = pa.array(np.full(len(held), key[0].as_py()), pa.int32())
            yield pa.RecordBatch.from_arrays([held, blocks, *lists], ["bucket", "block", "keys", "counts", "lasts"])

    def add_blocks(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        owner, keys, counts, lasts = (np.concatenate(x) for x in zip(*[_from_lists(b, "block") for b in batches]))
        code, _ = pd.factorize(keys)
        totals, lasts = (np.bincount(code, weights=x).astype(np.int64)[code] for x in (counts, lasts))
        kept = (keys & 1 == 0) | (totals >= min_count)
        blocks, *lists = _lists(owner[kept], keys[kept], totals[kept], lasts[kept])
        buckets = pa.array(np.full(len(blocks), key[0].as_py()), pa.int32())
        yield pa.RecordBatch.from_arrays([buckets, blocks, *lists], ["bucket", "block", "keys", "counts", "lasts"])

    lists = "bucket int, block int, keys binary, counts array<long>, lasts array<long>"
    answers = rows.groupBy("block").applyInArrow(distinct, lists).groupBy("bucket").applyInArrow(add_blocks, lists)

    def add_up(texts: pa.Table, known: pa.Table) -> pa.Table:
        parts = [(np.zeros(0, np.int64),) * 3]
        for batch in known.to_batches():
            buckets, keys, counts, lasts = _from_lists(batch, "bucket")
            parts.append((_in_block(keys, buckets), counts, lasts))
        keys, *sums_of = (np.concatenate(x) for x in zip(*parts))
        total, last = (np.append(x, 0) for x in sums_of)  # the last ones are for what is missing
        index = pd.Index(keys)
        del parts, keys, sums_of
        find = lambda keys: index.get_indexer(_in_block(keys, _buckets(keys, n_buckets)))
        n = total[find(np.array([_EMPTY_GRAM], np.int64))[0]]
        sums, sizes = [np.zeros(0)], [np.zeros(0, np.int64)]
        for batch in texts.to_batches():
            for part in slices(batch):
                words, at = words_of(part.column("text"), lower=False)
                hashes = hash_words(words)
                keys, before = _pair_keys(hashes, at)
                pair, word, at_before = total[find(keys)], total[find(_word_keys(hashes))], find(_word_keys(before))
                context = total[at_before] - last[at_before]
                often = pair > 0
                score = np.log(np.where(often, pair, alpha * word) / np.where(often, context, n))
                of_text = np.repeat(np.arange(len(at) - 1), np.diff(at))
                sums.append(np.bincount(of_text, weights=score, minlength=len(at) - 1))
                sizes.append(np.diff(at))
        columns = [texts["doc_id"], pa.array(np.concatenate(sizes), pa.int64()), pa.array(np.concatenate(sums), pa.float64())]
        return pa.table(columns, names=["doc_id", "n_units", "log_score"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    found = rows.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(add_up, f"doc_id {kind}, n_units long, log_score double")
    mean = F.when(F.col("n_units") > 0, F.col("log_score") / F.col("n_units")).otherwise(F.lit(0.0))
    return found.select("doc_id", "n_units", "log_score", mean.alias("mean_log_score"))
