"""Spelling variants of words: PartEnum signatures over letter multisets, joined and verified.

1. :func:`word_counts` takes maximal runs of letters (A-Z, a-z, U+00C0 to U+00FF), lower-cases
   A-Z, and counts them over all documents.  Tasks add up what they read and send one row
   for a word and flush, so that a word with a third of all occurrences is a few rows a task.
2. :func:`signatures`: a word's letters are a binary vector with one dimension for the k-th
   occurrence of a letter.  Two words one edit apart differ in at most two dimensions: a
   replaced letter leaves one and enters another, an inserted one enters.  Dimensions are
   dealt to ``PARTS`` parts.  Leaving out each pair of parts in turn (15 pairs of 6) gives
   signatures, exact hashes of what is left, of which two such words share at least one.
   One edit also leaves the first or the last few letters as they are, so a signature is
   taken together with each end: words of the same letters in another order rarely meet.
3. Words are equi-joined on signatures, and the edit distance decides in the join.  A pair met
   over several signatures counts once.
4. :func:`group_variants` gives each word its form, the near word with the largest count, if
   that is at least ``factor`` times its own; roots come from pointer doubling, since counts
   grow by ``factor`` from word to form and so bound the length of a chain.

Defined results: a null text has no words; a null id reads as the empty string where typos
are drawn; repeated rows count again; ties between forms go to the word that is smaller by
code points; texts are read whole, whatever their length; an empty table gives no rows.
Extra columns of any name are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import mix64, slices
from .common import Scratch

#: Parts that the dimensions are dealt to; two are left out of each signature.
PARTS = 6
#: Distinct words that a task holds before it sends its counts on.
HELD_WORDS = 200_000
#: Words worked on, and rows sent, at a time.
WORDS_AT_ONCE = 20_000

_LETTERS = bytes(c + 32 if 65 <= c <= 90 else c if 97 <= c <= 122 or c >= 0xC0 else 32 for c in range(256))
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


def letter_runs(text: str) -> list[bytes]:
    """Runs of letters with A-Z lower-cased, as Latin-1: one byte is one code point."""
    return text.encode("latin-1", "replace").translate(_LETTERS).split()


def _crc(doc_id: str | None, run: bytes) -> int:
    return zlib.crc32(run if run.isascii() else run.decode("latin-1").encode(), zlib.crc32(f"{doc_id or ''}:".encode()))


def _with_typos(doc_id: str | None, runs: list[bytes], counts: Counter, every: int, shortest: int) -> None:
    """Where ``every`` divides the CRC of ``<doc_id>:<run>``, moves the run's count to the run less one letter."""
    seed = zlib.crc32(f"{doc_id or ''}:".encode())
    for run in set(runs):
        h = zlib.crc32(run, seed) if run.isascii() else _crc(doc_id, run)
        if h % every == 0:
            n, at = runs.count(run), h % len(run)
            counts[run] -= n
            if len(run) > shortest:
                counts[run[:at] + run[at + 1 :]] += n


def _counted(batches: Iterator[pa.RecordBatch], shortest: int, typo_every: int | None) -> Iterator[pa.RecordBatch]:
    counts: Counter = Counter()

    def sent() -> Iterator[pa.RecordBatch]:
        words = [w for w, n in counts.items() if n]
        for k in range(0, len(words), WORDS_AT_ONCE):
            some = words[k : k + WORDS_AT_ONCE]
            yield pa.RecordBatch.from_arrays([pa.array([w.decode("latin-1") for w in some], pa.string()), pa.array([counts[w] for w in some], pa.int64())], ["word", "n"])
        counts.clear()

    for whole in batches:
        for batch in slices(whole):
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                runs = [r for r in letter_runs(text or "") if len(r) >= shortest]
                counts.update(runs)
                if typo_every:
                    _with_typos(doc_id, runs, counts, typo_every, shortest)
            if len(counts) > HELD_WORDS:
                yield from sent()
    yield from sent()


def word_counts(docs: DataFrame, shortest: int = 6, least: int = 5, typo_every: int | None = None) -> DataFrame:
    """word, n: words of at least ``shortest`` code points with at least ``least`` occurrences in all documents.

    With ``typo_every``, a run loses one letter in every document for which that number
    divides the CRC-32 of ``<doc_id>:<run>``: typing errors that are the same in each run.
    """
    rows = docs.select(F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"))
    parts = rows.mapInArrow(lambda batches: _counted(batches, shortest, typo_every), "word string, n long")
    return parts.groupBy("word").agg(F.sum("n").alias("n")).filter(F.col("n") >= least)


def signature_hashes(words: list[str], end: int) -> np.ndarray:
    """For each word its signatures in a row: every pair of parts left out, with the first and with the last ``end`` letters."""
    points = np.frombuffer("".join(words).encode("utf-32-le"), dtype=np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    first = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(words)), sizes)
    # the how-manieth of its letter each one is, within its word
    key = of.astype(np.uint64) << np.uint64(21) | points
    by_key = np.argsort(key, kind="stable")
    new = np.flatnonzero(np.diff(key[by_key], prepend=key[by_key][:1] ^ np.uint64(1)))
    nth = np.empty(len(points), dtype=np.int64)
    nth[by_key] = np.arange(len(points)) - np.repeat(new, np.diff(np.append(new, len(points))))
    nth = nth.astype(np.uint64)
    part = ((points * np.uint64(5) + nth * np.uint64(3)) % np.uint64(PARTS)).astype(np.int64)
    sums = np.zeros((len(words), PARTS), dtype=np.uint64)
    np.add.at(sums, (of, part), mix64(points + (nth << np.uint64(24)) + np.uint64(1)))
    ends = []
    for side, start in enumerate((first, first + sizes - end)):
        h = np.full(len(words), side + 1, dtype=np.uint64)
        for k in range(end):
            h = mix64(h * _A + points[start + k])
        ends.append(h)
    whole = sums.sum(axis=1, dtype=np.uint64)
    out = [mix64((whole - sums[:, a] - sums[:, b]) * _A + h * _B + np.uint64(a * PARTS + b)) for a, b in combinations(range(PARTS), 2) for h in ends]
    return np.stack(out, axis=1)


def _signed(batches: Iterator[pa.RecordBatch], end: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for k in range(0, whole.num_rows, WORDS_AT_ONCE // 10):
            batch = whole.slice(k, WORDS_AT_ONCE // 10)
            found = signature_hashes(batch.column(0).to_pylist(), end)
            at = pa.array(np.repeat(np.arange(batch.num_rows), found.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(found.ravel().view(np.int64)), batch.column(0).take(at), batch.column(1).take(at)], ["signature", "word", "n"])


def signatures(words: DataFrame, shortest: int = 6) -> DataFrame:
    """signature, word, n: 30 rows a word, for words of at least ``shortest`` code points."""
    return words.select("word", "n").mapInArrow(lambda batches: _signed(batches, shortest // 2), "signature long, word string, n long")


def near_words(words: DataFrame, scratch: Scratch, shortest: int = 6) -> DataFrame:
    """word, n, near, near_n: each pair of words one edit apart once, the smaller word first."""
    signed = scratch.put(signatures(words, shortest), "signatures")
    other = signed.select(F.col("signature").alias("_s"), F.col("word").alias("near"), F.col("n").alias("near_n"))
    met = signed.join(other, (F.col("signature") == F.col("_s")) & (F.col("word") < F.col("near")) & (F.levenshtein("word", "near", 1) == 1))
    return met.groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))


def _best(n: Column, word: Column) -> Column:
    """Orders words by more occurrences, then by code points, the best smallest."""
    return F.struct((-n).alias("less"), word.alias("word"))


def _roots(forms: DataFrame, hops: int, scratch: Scratch) -> DataFrame:
    """word, root: forms followed to their ends, twice as far with each round; ``hops`` is the most that a chain has."""
    found = scratch.put(forms.select("word", F.col("form").alias("root")), "roots-0")
    for k in range(1, math.ceil(math.log2(max(1, hops))) + 1):
        on = found.select(F.col("word").alias("_w"), F.col("root").alias("_r"))
        found = scratch.put(found.join(on, F.col("root") == F.col("_w"), "left").select("word", F.coalesce("_r", "root").alias("root")), f"roots-{k}")
    return found


def group_variants(words: DataFrame, factor: int = 5, shortest: int = 6) -> DataFrame:
    """word, form, root, n, n_near, form_n for a table of distinct words (word, n) of at least ``shortest`` code points.

    ``form`` is the near word of largest n if that is at least ``factor`` times the word's n,
    else null; ``root`` is the end of the chain of forms, the word itself if it has none.
    """
    if factor < 2:
        raise ValueError("factor is at least 2: forms must lead to more frequent words")
    if shortest < 2:
        raise ValueError("words need two letters at least, one for each end")
    scratch = Scratch(words.sparkSession, "spelling")
    words = scratch.put(words.select("word", "n"), "words")
    pairs = scratch.put(near_words(words, scratch, shortest), "pairs")
    both = pairs.select("word", F.struct("near", "near_n").alias("o")).unionAll(pairs.select(F.col("near").alias("word"), F.struct(F.col("word").alias("near"), F.col("n").alias("near_n")).alias("o")))
    near = both.groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(_best(F.col("o.near_n"), F.col("o.near"))).alias("best"))
    formed = -F.col("best.less") >= factor * F.col("n")
    judged = words.join(near, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(formed, F.col("best.word")).alias("form"), F.when(formed, -F.col("best.less")).alias("form_n"))
    judged = scratch.put(judged, "judged")
    scratch.drop("signatures", "pairs", "words")
    top, low = judged.agg(F.max("n"), F.min("n")).first()
    hops = 1 if top is None else int(math.log(top / max(1, low), factor)) + 2
    roots = _roots(judged.filter("form IS NOT NULL"), hops, scratch)
    return judged.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
