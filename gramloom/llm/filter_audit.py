"""Filter interaction audit: what each filter removes in each order, from one mask per document.

Filters A to E are conditions on a text that fail it; E fails a text identical to that of a
smaller doc_id.  Whatever the order, counts follow from how many documents of a part have
which set of failures, so each document becomes a mask of five bits, masks are added up, and
the 120 orders are expanded from 32 sums a part.

Duplicates are found by compressed radix tries over whole texts:

1. The text space is cut into prefixes.  A prefix whose distinct texts hold more bytes than
   ``trie_bytes`` is cut at a longer one, and only those go to the next round; a prefix that is a
   single text is never cut.  Copies count once here, so a hot text makes no prefix longer.
2. Map tasks make the masks of A to D.  Of copies that a task reads, only the smallest id goes
   on with the text; the rest are decided, since a smaller id is known.  A text with a third of
   all rows leaves each task as one row.
3. Texts are dealt by prefix.  A task gets its prefixes one after the other, inserts each whole text
   into the prefix's trie, whose terminals hold the smallest id, and decides the larger ones;
   what the terminals hold at the end is no duplicate.  One prefix's trie is held at a time.

Labels are joined to (doc_id, part, mask) sums; no text is in that join.

Defined results: a null text is empty (so all null and empty texts are identical); a null id
is never smaller nor larger than another, so its row never fails E and makes none fail it;
rows that repeat an id and text do not fail each other; a null lang is the part ''; labels that
repeat an id count as marked if one of them is; texts are read whole; an empty table gives no
rows.  Extra columns of any name are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import permutations

import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import slices
from .common import Scratch, text_of

FILTERS = "ABCDE"
_BIT = {f: 1 << k for k, f in enumerate(FILTERS)}
_CAPITALS = bytes(range(65, 91))
_MARKS = b"#$%&*|"
#: Bytes of texts after which a map task sends on what it holds.
HELD_BYTES = 16 << 20
#: Rows sent at a time, and bytes of texts among them.
ROWS_AT_ONCE, BYTES_AT_ONCE = 10_000, 4 << 20
#: Prefix lengths of the first rounds, in code points; each later one is four times the one before.
FIRST_LENGTHS = (1, 2, 4, 8, 16)


class RadixTrie:
    """A compressed trie over byte strings; each terminal holds the smallest id and what is known of its rows.

    An edge is a slice of a text that was inserted, so that no label is copied.
    """

    __slots__ = ("root",)

    def __init__(self) -> None:
        self.root: list = [b"", 0, 0, {}, None]  # text, start, end of the edge; children by first byte; terminal

    @staticmethod
    def _shared(a: bytes, at: int, b: bytes, start: int, end: int) -> int:
        """How many bytes ``a[at:]`` and ``b[start:end]`` begin with in common."""
        low, high = 0, min(len(a) - at, end - start)
        step = 64
        while low < high:  # doubling steps, then halving ones: slices are compared by memory blocks
            step = min(step, high - low)
            if a[at + low : at + low + step] == b[start + low : start + low + step]:
                low += step
                step *= 2
            elif step == 1:
                break
            else:
                high = low + step
                step = max(1, step // 2)
        return low

    def terminal(self, text: bytes) -> list:
        """The terminal of a text, made if it is new: [smallest id, what is held]."""
        node, at = self.root, 0
        while at < len(text):
            child = node[3].get(text[at])
            if child is None:
                child = [text, at, len(text), {}, None]
                node[3][text[at]] = child
                node, at = child, len(text)
                break
            edge, start, end = child[:3]
            n = self._shared(text, at, edge, start, end)
            if start + n < end:  # split the edge where they part
                upper = [edge, start, start + n, {edge[start + n]: child}, None]
                child[1] = start + n
                node[3][text[at]] = upper
                child = upper
            node, at = child, at + n
        if node[4] is None:
            node[4] = [None, None]
        return node[4]

    def terminals(self) -> Iterator[list]:
        """All terminals, depth first."""
        open_nodes = [self.root]
        while open_nodes:
            node = open_nodes.pop()
            if node[4] is not None:
                yield node[4]
            open_nodes.extend(node[3].values())


def text_mask(text: bytes, n_points: int) -> int:
    """The failures A to D of a text in UTF-8 with so many code points."""
    words = text.split()  # at the bytes 09-0D and 20
    n = len(words)
    mask = _BIT["A"] if n < 100 else 0
    if 100 * len(set(words)) < 80 * n:
        mask |= _BIT["B"]
    if 100 * (len(text) - len(text.translate(None, _CAPITALS))) > 10 * n_points:
        mask |= _BIT["C"]
    if len(text.translate(None, _MARKS)) < len(text):
        mask |= _BIT["D"]
    return mask


class _Rows:
    """Arrow batches of a bounded size: key, text or null, doc_id, part, mask, n."""

    SCHEMA = pa.schema([("key", pa.int64()), ("text", pa.binary()), ("doc_id", pa.int64()), ("part", pa.string()), ("mask", pa.int32()), ("n", pa.int64())])
    DDL = "key long, text binary, doc_id long, part string, mask int, n long"

    def __init__(self) -> None:
        self.rows: list[tuple] = []
        self.bytes = 0

    def add(self, *row) -> bool:
        """Whether enough rows are there."""
        self.rows.append(row)
        self.bytes += len(row[1] or b"")
        return len(self.rows) >= ROWS_AT_ONCE or self.bytes >= BYTES_AT_ONCE

    def take(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*self.rows), self.SCHEMA)], schema=self.SCHEMA)
        self.rows, self.bytes = [], 0


def _hash(data: bytes) -> int:
    return int.from_bytes(xxhash.xxh3_64_digest(data), "big", signed=True)


def _smallest(terminal: list, doc_id: int, row: tuple, n: int, decided: Counter) -> None:
    """Bring (doc_id, row) to a terminal; larger ids than the smallest one seen are decided as duplicates."""
    if terminal[0] is None:
        terminal[:] = [doc_id, Counter({row: n})]
    elif doc_id == terminal[0]:
        terminal[1][row] += n
    else:
        loser, rows = (doc_id, {row: n}) if doc_id > terminal[0] else (terminal[0], terminal[1])
        for (part, mask), k in rows.items():
            decided[loser, part, mask | _BIT["E"]] += k
        if doc_id < terminal[0]:
            terminal[:] = [doc_id, Counter({row: n})]


def _sums(decided: Counter, out: _Rows) -> Iterator[pa.RecordBatch]:
    """Decided rows, dealt by their id."""
    for (doc_id, part, mask), n in decided.items():
        if out.add(_hash(str(doc_id).encode()), None, doc_id, part, mask, n):
            yield from out.take()
    decided.clear()


def _masked(batches: Iterator[pa.RecordBatch], cuts: list[tuple[int, frozenset[str]]]) -> Iterator[pa.RecordBatch]:
    """Masks of A to D; a text goes on once a flush, with its smallest id, under the hash of its prefix."""
    held: dict[bytes, list] = {}
    keys: dict[bytes, int] = {}
    decided: Counter = Counter()
    out = _Rows()
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for text, (doc_id, rows) in held.items():
            for (part, mask), n in rows.items():
                if out.add(keys[text], text, doc_id, part, mask, n):
                    yield from out.take()
        held.clear()
        keys.clear()
        yield from _sums(decided, out)
        yield from out.take()

    for whole in batches:
        for batch in slices(whole):
            for doc_id, string, part in zip(*(c.to_pylist() for c in batch.columns)):
                text = string.encode()
                row = (part, text_mask(text, len(string)))
                if doc_id is None:
                    decided[None, *row] += 1
                    continue
                terminal = held.get(text)
                if terminal is None:
                    terminal = held[text] = [None, None]
                    keys[text] = _hash(prefix_of(string, cuts).encode())
                    size += len(text)
                _smallest(terminal, doc_id, row, 1, decided)
            if size > HELD_BYTES or len(decided) > 10 * ROWS_AT_ONCE:
                yield from flush()
                size = 0
    yield from flush()


def prefix_of(text: str, cuts: list[tuple[int, frozenset[str]]]) -> str:
    """The prefix that a text is dealt by: of the first length at which its beginning is not one to be cut further."""
    for length, further in cuts:
        if text[:length] not in further:
            return text[:length]
    return text


def _decided(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One prefix after the other: its texts into a trie, its rows out with their masks."""
    trie, now = RadixTrie(), None
    decided: Counter = Counter()
    out = _Rows()

    def close() -> Iterator[pa.RecordBatch]:
        for doc_id, rows in trie.terminals():
            for (part, mask), n in rows.items():
                decided[doc_id, part, mask] += n
            if len(decided) > ROWS_AT_ONCE:
                yield from _sums(decided, out)
        yield from _sums(decided, out)

    for batch in batches:
        for key, text, doc_id, part, mask, n in zip(*(c.to_pylist() for c in batch.columns)):
            if text is None:
                decided[doc_id, part, mask] += n
                continue
            if key != now:
                yield from close()
                trie, now = RadixTrie(), key
            _smallest(trie.terminal(text), doc_id, (part, mask), n, decided)
        if len(decided) > ROWS_AT_ONCE:
            yield from _sums(decided, out)
    yield from close()
    yield from out.take()


def prefix_cuts(docs: DataFrame, trie_bytes: int, scratch: Scratch) -> tuple[list[tuple[int, frozenset[str]]], int]:
    """For growing lengths the prefixes to be cut further, and the bytes of all distinct texts.

    At most one prefix is cut a length for ``trie_bytes`` of texts, so the lists are as long as
    the list of tasks.  Rounds read a slim table of beginnings; only where cuts go beyond them
    are documents read again, for longer ones.
    """
    text = text_of("text")
    cuts: list[tuple[int, frozenset[str]]] = []
    total, lengths, width = 0, list(FIRST_LENGTHS), 0
    while True:
        length = lengths.pop(0) if lengths else cuts[-1][0] * 4
        if length > width:
            width = length * 16
            rows = docs.select(F.substring(text, 1, width).alias("head"), F.octet_length(text).cast("long").alias("bytes"), F.xxhash64(text).alias("h"))
            if cuts:
                rows = _among(rows, *cuts[-1])
            slim = scratch.put(rows.groupBy("h").agg(F.first("head").alias("head"), F.first("bytes").alias("bytes")), f"heads-{width}")
            total = total or slim.agg(F.sum("bytes")).first()[0] or 0
        rows = _among(slim, *cuts[-1]) if cuts else slim
        loads = rows.groupBy(F.substring("head", 1, length).alias("prefix")).agg(F.sum("bytes").alias("bytes"), F.count(F.lit(1)).alias("texts"))
        further = frozenset(r["prefix"] for r in loads.filter((F.col("bytes") > trie_bytes) & (F.col("texts") > 1)).select("prefix").toLocalIterator())
        if not further:
            return [*cuts, (length, further)], total
        cuts.append((length, further))


def _among(rows: DataFrame, length: int, prefixes: frozenset[str]) -> DataFrame:
    wanted = rows.sparkSession.createDataFrame([(p,) for p in sorted(prefixes)], "_prefix string")
    return rows.join(F.broadcast(wanted), F.substring("head", 1, length) == F.col("_prefix"), "left_semi")


def failure_masks(docs: DataFrame, scratch: Scratch, trie_bytes: int = 32 << 20) -> DataFrame:
    """doc_id, part, mask, n: how many rows of an id and part fail which filters (bit k for the k-th)."""
    cuts, total = prefix_cuts(docs, trie_bytes, scratch)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of("text").alias("text"), F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("part"))
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), 2 * total // trie_bytes)
    dealt = rows.mapInArrow(lambda batches: _masked(batches, cuts), _Rows.DDL).repartition(tasks, "key").sortWithinPartitions("key")
    return dealt.mapInArrow(_decided, _Rows.DDL).select("doc_id", "part", "mask", "n")


def _marks(labels: DataFrame) -> DataFrame:
    known = labels.select(F.col("doc_id").cast("long").alias("_id"), (F.col("quality") == 1).alias("good"), (F.col("toxic") == 1).alias("toxic")).filter("_id IS NOT NULL AND (good OR toxic)")
    return known.groupBy("_id").agg(F.coalesce(F.bool_or("good"), F.lit(False)).alias("good"), F.coalesce(F.bool_or("toxic"), F.lit(False)).alias("toxic"))


def mask_sums(masks: DataFrame, labels: DataFrame) -> DataFrame:
    """part, mask, n, good, toxic: documents, and those of them that are labelled so."""
    per_id = masks.groupBy("doc_id", "part", "mask").agg(F.sum("n").alias("n"))
    met = per_id.join(_marks(labels), F.col("doc_id") == F.col("_id"), "left")
    marked = lambda c: F.sum(F.when(F.col(c), F.col("n")).otherwise(0)).alias(c)
    return met.groupBy("part", "mask").agg(F.sum("n").alias("n"), marked("good"), marked("toxic"))


def by_order(sums: DataFrame) -> DataFrame:
    """One row per part, order and step of what :func:`mask_sums` gives."""
    orders = ",".join(map("".join, permutations(FILTERS)))
    bit = lambda name: F.expr(f"int(shiftleft(1, instr('{FILTERS}', {name}) - 1))")
    # one row for each part and filter order and step, and mask of the part: 32 x 600 a part at most
    steps = sums.withColumn("filter_order", F.explode(F.split(F.lit(orders), ","))).withColumn("step", F.explode(F.sequence(F.lit(1), F.lit(len(FILTERS)))))
    steps = steps.withColumn("letter", F.expr("substring(filter_order, step, 1)"))
    steps = steps.withColumn("own", bit("letter"))
    earlier = F.expr("aggregate(filter(sequence(1, 5), i -> i < step), 0, (a, i) -> a | int(shiftleft(1, instr('%s', substring(filter_order, i, 1)) - 1)))" % FILTERS)
    steps = steps.withColumn("before", earlier)
    fails, gone = (F.col("mask").bitwiseAND(F.col("own")) != 0), (F.col("mask").bitwiseAND(F.col("before")) != 0)
    added = lambda condition, what, name: F.sum(F.when(condition, F.col(what)).otherwise(0)).cast("long").alias(name)
    rows = steps.groupBy("part", "filter_order", "step", "letter").agg(
        added(~fails & ~gone, "n", "kept"),
        added(fails & ~gone, "n", "removed"),
        added(fails & gone, "n", "redundant"),
        added(F.col("mask") == F.col("own"), "n", "unique_fails"),
        added(fails & ~gone, "good", "good_lost"),
        added(fails & ~gone, "toxic", "toxic_lost"),
    )
    shares = rows.groupBy(F.col("part").alias("_part"), F.col("letter").alias("_letter")).agg(F.sum("removed").cast("long").alias("shapley"))
    met = rows.join(shares, (F.col("part") == F.col("_part")) & (F.col("letter") == F.col("_letter")))
    return met.select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")


def audit(docs: DataFrame, labels: DataFrame, trie_bytes: int = 32 << 20) -> DataFrame:
    """Per part, filter order and step: kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley."""
    scratch = Scratch(docs.sparkSession, "filter-audit")
    sums = scratch.put(mask_sums(failure_masks(docs, scratch, trie_bytes), labels), "sums")
    return by_order(sums)
