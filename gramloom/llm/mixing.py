"""Mixing sources to target weights by thresholds on a hash.

Every document has a 60-bit hash of its id.  A source's documents below a threshold of
that hash are in the mix, so that a larger budget takes a superset.  Thresholds come
from histograms: words are summed by source and hash bucket (12 bits), the bucket in
which the budget runs out is found, and only that bucket is refined, 12 bits a level.
Where the last bucket is one hash of several documents (null or repeated ids), it is
refined by the hash of their texts in the same way.  No document is sorted.

Targets: sources in code-point order, null last, have the weights 3, 1, 2, repeating;
they share 150 % of all words.  A target stops at twice its source's size, and the
excess is shared again by weight among the rest.

Defined results: null text has 0 words; a null source is a source of its own, as is the
empty one; rows that repeat doc_id and text fall under the same threshold; an empty table
gives no rows; no words at all give targets of 0.  Extra columns of any name are ignored
by :func:`mix` and returned by :func:`mixed_rows`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import Scratch, row_columns, text_of, with_row, word_count

BITS, LEVELS = 12, 5


def seeded_hash(value: Column, seed: int) -> Column:
    """The first 60 bits of SHA-256 of "seed:value"."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(value.cast("string"), F.lit(""))), 256)
    return F.conv(F.substring(digest, 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, most: float) -> DataFrame:
    """``sizes`` (skey, source, source_size), a row per source, with ``target``.

    The level at which uncapped targets stand is found on sources sorted by cap over
    weight: the first source whose cap the level does not reach, when all before it are
    at their caps.  One row per source, so one window over them is small.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    n = len(weights)
    weighted = sizes.withColumn("weight", F.element_at(F.array(*[F.lit(w) for w in weights]), (F.row_number().over(order) - 1) % n + 1)).withColumn("cap", most * F.col("source_size"))
    by_cap = Window.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    before = by_cap.rowsBetween(Window.unboundedPreceding, -1)
    after = by_cap.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    whole = Window.partitionBy(F.lit(1))
    levels = weighted.withColumns({"level": (share * F.sum("source_size").over(whole) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after), "rank": F.row_number().over(by_cap)})
    level = F.min(F.when(F.col("cap") >= F.col("level") * F.col("weight"), F.struct("rank", "level"))).over(whole)["level"]
    return levels.withColumn("chosen", level).select("skey", "source", "source_size", F.least("cap", F.col("chosen") * F.col("weight")).alias("target"))


def boundary(sized: DataFrame, budgets: DataFrame, u: str) -> DataFrame:
    """Where each budget (skey, rest) runs out: path, the hash there, words before and after it, and its documents.

    ``sized`` has skey, size and the 60-bit hash ``u``.  Budgets that never run out are left out.
    """
    state = None
    for level in range(1, LEVELS + 1):
        path = F.shiftright(u, 60 - BITS * level)
        sums = [F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")]
        if level == 1:
            cells = sized.groupBy("skey", path.alias("path")).agg(*sums)
            cells = cells.join(budgets, "skey").withColumn("base", F.lit(0).cast("long"))
        else:
            old = state.select(F.col("skey").alias("k"), F.col("path").alias("p"), "rest", F.col("before").alias("base"))
            inside = sized.join(old, (F.col("skey") == F.col("k")) & (F.shiftright(u, 60 - BITS * (level - 1)) == F.col("p")))
            cells = inside.groupBy("skey", path.alias("path"), "rest", "base").agg(*sums)
        # at most 2**BITS rows per source
        running = cells.withColumn("upto", F.col("base") + F.sum("words").over(Window.partitionBy("skey").orderBy("path")))
        over = running.filter(F.col("upto") > F.col("rest"))
        least = over.groupBy("skey", "rest").agg(F.min(F.struct("path", "words", "upto", "docs")).alias("b"))
        state = least.select("skey", "rest", "b.path", (F.col("b.upto") - F.col("b.words")).alias("before"), F.col("b.upto").alias("after"), "b.docs")
    return state


def thresholds(sized: DataFrame, budgets: DataFrame, scratch: Scratch) -> DataFrame:
    """budgets (skey, rest: words wanted of one pass) with below, also, tied, below2 and also2.

    Documents with u < below, or = also, are in; of those with u = tied, the ones with
    t < below2, or = also2.  ``sized`` has skey, size, u and t.
    """
    none, everything = F.lit(-1).cast("long"), F.lit(1 << 60).cast("long")
    nearest = (F.col("after") - F.col("rest")) < (F.col("rest") - F.col("before"))
    first = scratch.put(boundary(sized, budgets, "u"), "boundary")
    several = F.col("docs") > 1
    cut = first.select(F.col("skey").alias("k"), F.col("path").alias("below"), F.when(~several & nearest, F.col("path")).alias("also"), F.when(several, F.col("path")).alias("tied"))
    ties = first.filter(several).select("skey", F.col("path").alias("p"), (F.col("rest") - F.col("before")).alias("rest"))
    if ties.limit(1).count():
        inside = sized.join(ties.select(F.col("skey").alias("s"), "p"), (F.col("skey") == F.col("s")) & (F.col("u") == F.col("p"))).drop("s", "p")
        second = boundary(inside, ties.select("skey", "rest"), "t")
        second = second.select(F.col("skey").alias("s"), F.col("path").alias("below2"), F.when(nearest, F.col("path")).alias("also2"))
        cut = cut.join(second, F.col("k") == F.col("s"), "left").drop("s")
    else:
        cut = cut.withColumns({"below2": none, "also2": none})
    joined = budgets.join(cut, budgets["skey"] == cut["k"], "left")
    return joined.select("skey", F.coalesce("below", everything).alias("below"), *[F.coalesce(c, none).alias(c) for c in ("also", "tied", "below2", "also2")])


def _source_key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("n"))


def plan_mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: int = 17) -> tuple[DataFrame, DataFrame]:
    """The slim table of documents (no text), and the thresholds: one row per source."""
    scratch = Scratch(docs.sparkSession, "mixing")
    source = F.col("source").cast("string")
    sized = docs.select(F.col("doc_id"), source.alias("source"), _source_key(source).alias("skey"), word_count(text_of("text")).alias("size"), seeded_hash(F.col("doc_id"), seed).alias("u"), seeded_hash(text_of("text"), seed).alias("t"))
    sized = scratch.put(sized, "sized")
    targets = scratch.put(source_targets(sized.groupBy("skey", "source").agg(F.sum("size").alias("source_size")), weights, share, most), "targets")
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("int")
    budgets = targets.select("skey", (F.col("target") - whole * F.col("source_size")).alias("rest"))
    cuts = scratch.put(targets.withColumn("whole", whole).join(thresholds(sized, budgets, scratch), "skey"), "cuts")
    return sized, cuts.select(F.col("skey").alias("_k"), "source_size", "target", "whole", "below", "also", "tied", "below2", "also2", F.lit(int(most)).alias("most"))


def _copies(u: Column, t: Column) -> Column:
    """How often the mix takes a document; at the full target nothing is left for another pass."""
    more = (u < F.col("below")) | (u == F.col("also")) | ((u == F.col("tied")) & ((t < F.col("below2")) | (t == F.col("also2"))))
    return F.least(F.col("whole") + more.cast("int"), F.col("most")).cast("int")


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source, source_size, target, copies, taken."""
    sized, cuts = plan_mix(docs, **how)
    met = sized.join(cuts, F.col("skey") == F.col("_k")).withColumn("copies", _copies(F.col("u"), F.col("t")))
    return met.select("doc_id", "size", "source", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_rows(docs: DataFrame, seed: int = 17, **how) -> DataFrame:
    """The mix itself: the rows of ``docs``, all columns, each as often as the mix takes it.

    The thresholds depend on the source and the hashes alone, so the texts are not shuffled.
    """
    _, cuts = plan_mix(docs, seed=seed, **how)
    keyed = with_row(docs, skey=_source_key(F.col("source").cast("string")), u=seeded_hash(F.col("doc_id"), seed), t=seeded_hash(text_of("text"), seed))
    taken = keyed.join(cuts, F.col("skey") == F.col("_k")).withColumn("copies", _copies(F.col("u"), F.col("t"))).filter("copies > 0")
    return taken.select("row", F.explode(F.sequence(F.lit(1), F.col("copies"))).alias("copy")).select(*row_columns(docs))
