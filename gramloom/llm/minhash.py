"""MinHash near-deduplication with bottom-k sketches from one hash function.

Texts are compared as sets of n-word shingles (A-Z in lower case, words
``[^\\x20\\x09-\\x0D]+``); two texts are linked when Jaccard similarity reaches the
threshold; groups are the connected components.

1. *Sketches.*  One hash per shingle; a text keeps the ``K`` smallest (their upper 32
   bits).  Rows with the same set (size and two 64-bit sums over the whole set) form a
   class, which needs no links.  Classes are numbered when they are written, and
   everything below speaks of these numbers, never of doc_ids.
2. *Inverted lists.*  A list holds the classes that retain the same ``TUPLE`` values, those
   that come first in one of ``LISTS`` orders of the sketch.  Single values are in more
   sketches the larger the corpus is; tuples are shared by texts that are alike.  Linked
   texts share no list with a chance of about 1e-6 at exactly 0.8, far less above it.
3. *Overlaps.*  Each member of a list is paired with three of its members (the smallest
   number, the largest, the smallest in another order), which map tasks find, so that a
   list with a third of all classes is no hot group, and pairs grow with the lists.
   A pair goes on if the union sketch estimates at least ``LEAST`` (5 standard errors
   below 0.8) and a parity sketch (the parities of a text's shingles by hash bin; of texts
   beyond ``DENSE`` shingles, every 2nd, 4th ... counts) differs in no more bins than the
   largest symmetric difference of linked sets allows (5 standard errors above).
4. *Verification.*  Both whole texts are read and exact Jaccard on full sets decides.  A
   hub's text travels once for each ``PARTNERS`` of its partners.
5. *The rest.*  Where a list's members are in several components after that, members of
   different components are compared by their parity sketches in blocks.  Only pairs that
   pass leave a block, the closest first, with 8, 512 ... per member and round, until no
   pair is left out.  Pairs inside one component add nothing.

Defined results: a text without words (or null) has an empty set and is linked with
nothing; with fewer than n words the whole sequence is one shingle; rows that repeat an id
with other texts are told apart; a null id is never the smallest, so a group of null ids
alone has a null component and keeps all its rows in :func:`near_groups`; an empty table
gives no rows.  Extra columns are ignored, and returned by :func:`drop_near_copies`.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrow_text import mix64, shingle_sets, slices
from .common import Scratch, one_of_each, perhaps_in, row_columns, text_of, with_row
from .components import connected_components

K, TUPLE, LISTS, BLOCK, PARTNERS, LEAST = 64, 4, 40, 1024, 256, 0.55
ODD, DENSE = 2048, 4096  # bits of the parity sketch, and shingles that all count in it
_PAD = np.uint32(0xFFFFFFFF)
_ORDERS = mix64(np.arange(1, TUPLE * LISTS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
_OTHER_ORDER = 0x2A5A5A5A5A5A5A5A  # class numbers in another order: what they differ in from this


def _halvings(n: np.ndarray) -> np.ndarray:
    """How often the parity sketch of a set of ``n`` shingles halves what it counts."""
    return np.ceil(np.log2(np.maximum(n, DENSE) / DENSE)).astype(int)


def parity_sketch(shingles: np.ndarray) -> bytes:
    """For each bin of hashes, whether an odd number of the shingles that count is in it."""
    kept = shingles[shingles % np.uint64(1 << int(_halvings(len(shingles)))) == 0]
    return np.packbits(np.bincount((kept >> np.uint64(17)) % np.uint64(ODD), minlength=ODD).astype(np.uint8) & 1).tobytes()


def sketch_rows(docs: DataFrame, n: int) -> DataFrame:
    """doc_id, th (text hash), n_shingles, f1, f2, sketch, odd."""

    def sketches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                size, f1, f2, kept, odd = [], [], [], [], []
                for s in shingle_sets(part.column("text"), n):
                    size.append(len(s))
                    f1.append(int(s.sum(dtype=np.uint64).astype(np.int64)))
                    f2.append(int(mix64(s ^ np.uint64(0x5851F42D4C957F2D)).sum(dtype=np.uint64).astype(np.int64)))
                    kept.append((s[:K] >> np.uint64(32)).astype(np.uint32).view(np.int32))
                    odd.append(parity_sketch(s))
                bounds = np.concatenate([[0], np.cumsum([len(x) for x in kept])]).astype(np.int32)
                values = np.concatenate(kept) if kept else np.zeros(0, np.int32)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("th"), pa.array(size, pa.int64()), pa.array(f1, pa.int64()), pa.array(f2, pa.int64()), pa.ListArray.from_arrays(pa.array(bounds), pa.array(values)), pa.array(odd, pa.binary())],
                    ["doc_id", "th", "n_shingles", "f1", "f2", "sketch", "odd"],
                )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text_of("text")).alias("th"), text_of("text").alias("text"))
    return rows.mapInArrow(sketches, "doc_id long, th long, n_shingles long, f1 long, f2 long, sketch array<int>, odd binary")


def _classes(rows: DataFrame, scratch: Scratch) -> DataFrame:
    """One row per set: cid, its key, a member (id, th) to read the text of, the smallest doc_id, sketches."""
    key = ["n_shingles", "f1", "f2"]
    found = rows.filter("n_shingles > 0").groupBy(*key).agg(F.min(F.struct("doc_id", "th")).alias("member"), F.min("doc_id").alias("least_id"), F.first("sketch").alias("sketch"), F.first("odd").alias("odd"))
    # the numbers are read back from the written table, so they stay the same whatever is run again
    return scratch.put(found.select(F.monotonically_increasing_id().alias("cid"), *key, F.col("member.doc_id").alias("id"), F.col("member.th").alias("th"), "least_id", "sketch", "odd"), "classes")


def _matrix(sketches: pa.Array) -> np.ndarray:
    """Sketches, in the order of their values, as rows of K, padded."""
    lengths = np.diff(sketches.offsets.to_numpy())
    out = np.full((len(lengths), K), _PAD, dtype=np.uint32)
    out[np.arange(K) < lengths[:, None]] = sketches.flatten().to_numpy().view(np.uint32)
    return out


def list_keys(sketches: np.ndarray) -> np.ndarray:
    """For each sketch the LISTS lists it is in: hashes of the TUPLE values that come first in an order each."""
    spread = mix64(sketches.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + np.uint64(1))
    absent = sketches == _PAD
    keys = np.zeros((len(sketches), LISTS), dtype=np.uint64)
    for k, factor in enumerate(_ORDERS):
        order = spread * factor
        order[absent] = np.uint64(2**64 - 1)
        band = k // TUPLE
        keys[:, band] = mix64(keys[:, band] * np.uint64(0x9E3779B97F4A7C15) + order.min(axis=1) + np.uint64(band))
    return keys.view(np.int64)


def _lists(classes: DataFrame, scratch: Scratch) -> DataFrame:
    """(key, cid) of the lists with two members or more."""

    def postings(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                keys = list_keys(_matrix(part.column("sketch")))
                yield pa.RecordBatch.from_arrays([pa.array(keys.ravel()), pa.array(np.repeat(part.column("cid").to_numpy(), LISTS))], ["key", "cid"])

    every = scratch.put(classes.select("cid", "sketch").mapInArrow(postings, "key long, cid long"), "postings")
    shared = scratch.put(every.groupBy("key").agg(F.count(F.lit(1)).alias("m")).filter("m > 1"), "shared-keys")
    found = scratch.put(perhaps_in(every, shared.select("key"), ["key"]).join(shared, "key").select("key", "m", "cid"), "lists")
    scratch.drop("postings", "shared-keys")
    return found


def union_estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Share of values common to both among the K smallest of each pair's union."""
    found = np.empty(len(a))
    for at in range(0, len(a), 1 << 14):
        x = np.sort(np.concatenate([a[at : at + (1 << 14)], b[at : at + (1 << 14)]], axis=1), axis=1)
        real = x != _PAD
        new = np.concatenate([np.ones((len(x), 1), bool), x[:, 1:] != x[:, :-1]], axis=1) & real
        rank = np.cumsum(new, axis=1)
        twice = ~new & real & (rank <= K)
        found[at : at + (1 << 14)] = twice.sum(axis=1) / np.maximum(1, np.minimum(K, rank[:, -1]))
    return found


def _most_odd(sizes: np.ndarray, halvings: np.ndarray, threshold: float) -> np.ndarray:
    """Bins of odd parity that the symmetric difference of a linked pair reaches at most.

    ``sizes`` is the sum of both set sizes.  For c elements thrown into m bins the mean and
    variance of the odd bins are exact; where only a share counts, c varies as well.  Of
    sets that count whole no more bins can be odd than elements differ.
    """
    m, apart, share = ODD, (1 - threshold) / (1 + threshold) * sizes, 0.5**halvings
    c = apart * share
    mean = m / 2 * (1 - (1 - 2 / m) ** c)
    variance = np.maximum(0.0, (m + m * (m - 1) * (1 - 4 / m) ** c - m * m * (1 - 2 / m) ** (2 * c)) / 4) + c * (1 - share)
    most = mean + 5 * np.sqrt(variance) + 3
    return np.where(halvings == 0, np.minimum(most, apart + 1e-6), most)


def _used(na: np.ndarray, nb: np.ndarray, oa: np.ndarray, ob: np.ndarray, threshold: float) -> np.ndarray:
    """The share of the allowed difference that each pair's parities use; beyond 1 it cannot be linked.

    Pairs of unlike size are beyond 1.  Parities that count unlike shares of their texts say nothing: 1.
    """
    differ = np.bitwise_count(oa ^ ob).sum(axis=1, dtype=np.int64)
    ha, hb = _halvings(na), _halvings(nb)
    used = np.where(ha == hb, differ / np.maximum(_most_odd(na + nb, ha, threshold), 1e-9), 1.0)
    return np.where(np.minimum(na, nb) >= threshold * np.maximum(na, nb) - 1e-9, used, 2.0)


def _words(odd: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(odd.to_pylist()), dtype=np.uint64).reshape(len(odd), ODD // 64)


def _hub_pairs(lists: DataFrame) -> DataFrame:
    """(a, b): every member with up to three members of its lists, each pair once, a the hub."""
    other = F.lit(_OTHER_ORDER)
    hubs = lists.groupBy("key").agg(F.min("cid").alias("h1"), F.max("cid").alias("h2"), F.min(F.col("cid").bitwiseXOR(other)).bitwiseXOR(other).alias("h3"))
    met = lists.join(hubs, "key").select("cid", F.explode(F.array("h1", "h2", "h3")).alias("hub")).filter("cid <> hub")
    # one direction for each pair, kept where either may be the hub
    return met.select(F.least("hub", "cid").alias("a"), F.greatest("hub", "cid").alias("b")).distinct()


def _whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 4_000) -> Iterator[pa.Table]:
    """Tables of whole groups from batches sorted by ``keys``."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        held.append(batch)
        if sum(map(len, held)) < rows:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        same = np.ones(len(table), bool)
        for k in keys:
            c = table[k].to_numpy()
            same &= c == c[-1]
        cut = int(np.argmax(same))
        if cut:
            yield table.slice(0, cut)
        held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def _later_pairs(lists: DataFrame, labels: DataFrame, classes: DataFrame, threshold: float, most: int) -> DataFrame:
    """Pairs (a, b) across components in one list: ``most`` for a member at once; ``more``: some were left out.

    Members of a list's largest component meet the others only; either kind is dealt in
    blocks of about ``BLOCK`` members, and each pair of blocks is one group.
    """
    placed = lists.join(labels, F.col("cid") == F.col("node"), "left").select("key", "cid", F.coalesce("label", "cid").alias("comp"))
    counts = placed.groupBy("key", "comp").agg(F.count(F.lit(1)).alias("c"))
    mixed = counts.groupBy("key").agg(F.max_by("comp", F.struct("c", "comp")).alias("main"), F.max("c").alias("mc"), F.sum("c").alias("m"), F.count(F.lit(1)).alias("comps")).filter("comps > 1").select("key", "main", "mc", "m")
    rows = placed.join(mixed, "key").withColumn("other", F.col("comp") != F.col("main"))
    n_main, n_other = F.ceil(F.col("mc") / BLOCK).cast("int"), F.ceil((F.col("m") - F.col("mc")) / BLOCK).cast("int")
    block = F.when(F.col("other"), F.pmod(F.hash("cid"), n_other)).otherwise(n_other + F.pmod(F.hash("cid"), n_main))
    meets = F.when(F.col("other"), F.sequence(F.lit(0), n_other + n_main - 1)).otherwise(F.sequence(F.lit(0), n_other - 1))
    dealt = rows.withColumn("block", block).withColumn("with", F.explode(meets)).select("key", F.least("block", "with").alias("x"), F.greatest("block", "with").alias("y"), "block", "cid", "comp")
    dealt = dealt.join(classes.select(F.col("cid").alias("c"), F.col("n_shingles").alias("n"), "odd"), F.col("cid") == F.col("c")).drop("c")

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table in _whole_groups(batches, ["key", "x", "y"]):
            key, x, y, own, cid, comp, n = (table[c].to_numpy() for c in ("key", "x", "y", "block", "cid", "comp", "n"))
            odd = _words(table["odd"])
            new = np.r_[True, (key[1:] != key[:-1]) | (x[1:] != x[:-1]) | (y[1:] != y[:-1])]
            for a, b in zip(np.flatnonzero(new), np.r_[np.flatnonzero(new)[1:], len(new)]):
                left = np.arange(a, b)[own[a:b] == x[a]]
                right = left if x[a] == y[a] else np.arange(a, b)[own[a:b] == y[a]]
                found = [(np.zeros(0, int), np.zeros(0, int), np.zeros(0))]
                for strip in range(0, len(left), 64):
                    i, j = (z.ravel() for z in np.meshgrid(left[strip : strip + 64], right, indexing="ij"))
                    ok = (comp[i] != comp[j]) & ((i < j) | (x[a] != y[a]))
                    i, j = i[ok], j[ok]
                    used = _used(n[i], n[j], odd[i], odd[j], threshold)
                    found.append((i[used <= 1], j[used <= 1], used[used <= 1]))
                i, j, used = (np.concatenate(z) for z in zip(*found))
                order = np.lexsort((used, i))
                i, j = i[order], j[order]
                start = np.maximum.accumulate(np.where(np.r_[True, i[1:] != i[:-1]], np.arange(len(i)), 0)) if len(i) else i
                taken = np.arange(len(i)) - start < most
                i, j = cid[i[taken]], cid[j[taken]]
                more = np.full(len(i), bool((~taken).any()))
                yield pa.RecordBatch.from_pydict({"a": np.minimum(i, j), "b": np.maximum(i, j), "more": more})

    return dealt.repartition("key", "x", "y").sortWithinPartitions("key", "x", "y").mapInArrow(pairs, "a long, b long, more boolean")


def _likely(pairs: DataFrame, classes: DataFrame, threshold: float) -> DataFrame:
    """The pairs (a, b) that the union sketch and the parity sketch both let through."""

    def estimate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = union_estimate(_matrix(batch.column("sa")), _matrix(batch.column("sb"))) >= LEAST
            near &= _used(batch.column("na").to_numpy(), batch.column("nb").to_numpy(), _words(batch.column("oa")), _words(batch.column("ob")), threshold) <= 1
            yield batch.select(["a", "b"]).filter(pa.array(near, pa.bool_()))

    wanted = pairs.select(F.col("a").alias("cid")).unionAll(pairs.select("b")).distinct()
    some = perhaps_in(classes.select("cid", "n_shingles", "sketch", "odd"), wanted, ["cid"])
    side = lambda x: some.select(F.col("cid").alias(x), F.col("n_shingles").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"), F.col("odd").alias(f"o{x}"))
    return pairs.select("a", "b").join(side("a"), "a").join(side("b"), "b").select("a", "b", "na", "nb", "sa", "sb", "oa", "ob").mapInArrow(estimate, "a long, b long")


def _verified(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, threshold: float) -> DataFrame:
    """The pairs whose full sets reach the threshold, as edges (a, b).

    Pairs meet at the end that is in more of them, the hub, in blocks of its partners.
    """
    percent = round(threshold * 100)
    ends = pairs.select(F.col("a").alias("e")).unionAll(pairs.select("b"))
    degree = ends.groupBy("e").agg(F.count(F.lit(1)).alias("d"))
    da, db = degree.toDF("a", "da"), degree.toDF("b", "db")
    turned = pairs.join(da, "a").join(db, "b").select(F.when(F.col("da") >= F.col("db"), F.struct(F.col("a").alias("hub"), F.col("b").alias("cid"), F.col("da").alias("d"))).otherwise(F.struct(F.col("b").alias("hub"), F.col("a").alias("cid"), F.col("db").alias("d"))).alias("p")).select("p.*")
    dealt = turned.withColumn("block", F.pmod(F.hash("cid"), F.ceil(F.col("d") / PARTNERS)).cast("int"))
    needed = dealt.select("hub", "block", F.col("hub").alias("cid")).distinct().unionAll(dealt.select("hub", "block", "cid"))
    wanted = degree.select(F.col("e").alias("cid"))
    where = perhaps_in(classes.select("cid", F.coalesce("id", F.lit(0)).alias("id"), F.col("id").isNull().alias("no_id"), "th"), wanted, ["cid"])
    needed = needed.join(where, "cid")
    doc_id = F.col("doc_id").cast("long")
    texts = docs.select(F.coalesce(doc_id, F.lit(0)).alias("id"), doc_id.isNull().alias("no_id"), F.xxhash64(text_of("text")).alias("th"), text_of("text").alias("text"))
    key = ["id", "no_id", "th"]
    texts = perhaps_in(texts, where.select(*key), key).dropDuplicates(key)
    # the hub's row comes first in its block
    rows = texts.join(needed, key).select("hub", "block", "cid", (F.col("hub") == F.col("cid")).alias("is_hub"), "text")

    def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        center = np.zeros(0, np.uint64)
        for batch in batches:
            for part in slices(batch):
                hit = []
                for is_hub, s in zip(part.column("is_hub").to_pylist(), shingle_sets(part.column("text"), n)):
                    if is_hub:
                        center = s
                        hit.append(False)
                        continue
                    both = len(np.intersect1d(center, s, assume_unique=True))
                    hit.append(100 * both >= percent * (len(center) + len(s) - both))
                yield part.select(["hub", "cid"]).filter(pa.array(hit, pa.bool_()))

    ordered = rows.repartition("hub", "block").sortWithinPartitions("hub", "block", F.col("is_hub").desc())
    return ordered.mapInArrow(check, "a long, b long")


def _links(pairs: DataFrame, classes: DataFrame, docs: DataFrame, n: int, threshold: float, scratch: Scratch, name: str) -> DataFrame:
    likely = scratch.put(_likely(pairs, classes, threshold), f"likely-{name}")
    edges = scratch.put(_verified(likely, classes, docs, n, threshold), f"edges-{name}")
    scratch.drop(f"likely-{name}")
    return edges


def near_groups(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """One row per document: doc_id, th (text hash), n_shingles, group, component_id, kept.

    ``group`` is one number per component, null for empty sets.  Sketch sizes are set for
    thresholds of 0.8 and more.
    """
    if threshold < 0.8:
        raise ValueError("the sketches are sized for similarities of 0.8 and more")
    scratch = Scratch(docs.sparkSession, "minhash")
    rows = scratch.put(sketch_rows(docs, n), "sketches")
    classes = _classes(rows, scratch)
    lists = _lists(classes, scratch)
    pairs = scratch.put(_hub_pairs(lists), "pairs-0")
    edges = _links(pairs, classes, docs, n, threshold, scratch, "0")
    labels = connected_components(edges, scratch)
    most, step, more = 8, 1, lists.limit(1).count() > 0
    while more:
        later = scratch.put(_later_pairs(lists, labels, classes, threshold, most), f"pairs-{step}")
        state = later.agg(F.count(F.lit(1)).alias("n"), F.max("more").alias("more")).first()
        if not state["n"]:
            break
        edges = edges.unionAll(_links(later.select("a", "b").distinct(), classes, docs, n, threshold, scratch, str(step)))
        labels = connected_components(edges, scratch)
        more, most, step = bool(state["more"]), most * 64, step + 1
    placed = classes.join(labels, F.col("cid") == F.col("node"), "left").select(F.col("n_shingles").alias("_n"), F.col("f1").alias("_1"), F.col("f2").alias("_2"), F.coalesce("label", "cid").alias("group"), "least_id")
    least = placed.groupBy(F.col("group").alias("_g")).agg(F.min("least_id").alias("component_id"))
    groups = placed.join(least, F.col("group") == F.col("_g")).select("_n", "_1", "_2", "group", "component_id")
    slim = rows.select("doc_id", "th", "n_shingles", "f1", "f2")
    found = slim.join(groups, (F.col("n_shingles") == F.col("_n")) & (F.col("f1") == F.col("_1")) & (F.col("f2") == F.col("_2")), "left")
    component = F.when(F.col("group").isNull(), F.col("doc_id")).otherwise(F.col("component_id"))
    return found.select("doc_id", "th", "n_shingles", "group", component.alias("component_id"), F.col("doc_id").eqNullSafe(component).alias("kept"))


def drop_near_copies(docs: DataFrame, n: int = 5, threshold: float = 0.8) -> DataFrame:
    """The rows of ``docs``, all columns: one row of each group, one with the smallest id.

    Where several texts of a group have that id, the text with the smallest hash stays, and
    one of the rows that repeat it.  Rows without words all stay.
    """
    spark = docs.sparkSession
    groups = Scratch(spark, "near-groups").put(near_groups(docs, n, threshold).filter("kept"), "groups")
    first = groups.filter("group IS NOT NULL").groupBy("group").agg(F.min("th").alias("th"), F.first("doc_id").alias("doc_id"))
    rows = groups.select(F.col("group").alias("_g"), F.col("th").alias("_t"))
    copies = first.join(rows, (F.col("group") == F.col("_g")) & (F.col("th") == F.col("_t"))).groupBy("group", "th", "doc_id").agg(F.count(F.lit(1)).alias("copies"))

    def some_id(c: Column) -> list[Column]:
        return [F.coalesce(c, F.lit(0).cast("long")), c.isNull()]

    winners = copies.select(*[x.alias(k) for x, k in zip(some_id(F.col("doc_id")), ("id", "no_id"))], "th", "copies")
    doc_id, text = F.col("doc_id").cast("long"), text_of("text")
    key = dict(zip(("id", "no_id"), some_id(doc_id))) | {"th": F.xxhash64(text), "worded": text.rlike(r"[^\x20\x09-\x0D]")}
    keyed = with_row(docs, **key)
    kept = keyed.filter("worded").join(winners, ["id", "no_id", "th"])
    return one_of_each(kept, ["id", "no_id", "th"], "copies").select("row").unionAll(keyed.filter("NOT worded").select("row")).select(*row_columns(docs))
