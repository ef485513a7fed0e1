"""Quality rules as a short-circuit cascade of native expressions.

A rule is a predicate over counts of a text (words, characters in words, symbols, repeated
lines, words inside 8-word windows that occur again in the text ...).  Each count is an
expression of its own, made only where a rule that needs it is reached.  A rule's cost
(seconds a row, counts included) and selectivity (share of rows it rejects) are estimated
on a bounded sample; the cascade asks the rules by falling rejections per second, and a
document leaves at the first rule it fails.  The order changes the cost alone, never the
verdict.  :func:`judge` returns base counts of every row, so it asks for those in any case,
and its cascade reads them; :func:`keep` returns the rows that pass, and makes no count
that no rule asks for.

Defined results: null text has no words, fails the base rules and is not kept; lines are
split at ``\\n``; windows that repeat inside one text count however far apart they are.
Rows are judged one by one, so ties, repeated rows and null ids do not matter.  An empty
table gives no rows.  Extra columns of any name are ignored by :func:`judge` and returned
by :func:`keep`.
"""

from __future__ import annotations

import math
import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACE, WORD, Scratch, let, row_columns, text_of, with_row

WINDOW = 8


#: A count of the row's text by name; "text" is the text itself.
Count = Callable[[str], Column]


@dataclass(frozen=True)
class Rule:
    """``accept`` says of counts whether a text passes (null rejects); ``sql`` says the same for the queries' oracle."""

    name: str
    accept: Callable[[Count], Column]
    sql: str


def _without(text: Column, what: str) -> Column:
    """How many characters go when ``what`` is deleted."""
    return F.length(text) - F.length(F.replace(text, F.lit(what), F.lit("")))


#: The base rules: a text that fails one of them is base_failed.
BASE_RULES = (
    Rule("enough_words", lambda c: c("n_words") >= 20, "n_words >= 20"),
    Rule("few_repeated_words", lambda c: 100 * c("n_repeat_words") <= 30 * c("n_words"), "100 * n_repeat_words <= 30 * n_words"),
)
#: The other rules in use.
RULES = (
    Rule("few_symbols", lambda c: 10 * c("n_symbols") <= 3 * c("n_words"), "10 * n_symbols <= 3 * n_words"),
    Rule("word_length", lambda c: (c("word_chars") >= 2 * c("n_words")) & (c("word_chars") <= 15 * c("n_words")), "word_chars >= 2 * n_words AND word_chars <= 15 * n_words"),
    Rule("few_repeated_lines", lambda c: 2 * c("n_dup_lines") <= c("n_words"), "2 * n_dup_lines <= n_words"),
    Rule("few_exclamations", lambda c: 5 * _without(c("text"), "!") <= c("n_words"), "5 * (length(text) - length(replace(text, '!', ''))) <= n_words"),
    Rule("few_ellipses", lambda c: 10 * _without(c("text"), "...") <= 3 * c("n_words"), "10 * (length(text) - length(replace(text, '...', ''))) <= 3 * n_words"),
    Rule("few_digits", lambda c: 2 * (F.length(c("text")) - F.length(F.translate(c("text"), "0123456789", ""))) <= c("word_chars"), "2 * (length(text) - length(translate(text, '0123456789', ''))) <= word_chars"),
)

#: The base rules reject on these alone.
BASE_FAILED = "n_words < 20 OR 100 * n_repeat_words > 30 * n_words"


def _windows(hashes: Column) -> Column:
    at = F.sequence(F.lit(0), F.size(hashes) - WINDOW)
    return F.transform(at, lambda i: F.xxhash64(*[F.get(hashes, i + k) for k in range(WINDOW)]))


def _covered(windows: Column) -> Column:
    """Words in windows whose hash occurs twice or more: sort by hash, mark equal neighbours, add the steps between their places."""

    def places(a: Column) -> Column:
        marked = F.transform(a, lambda e, j: F.when((e["h"] == F.get(a, j - 1)["h"]) | (e["h"] == F.get(a, j + 1)["h"]), e["i"]).otherwise(F.lit(-1)))
        return F.sort_array(F.filter(marked, lambda i: i >= 0))

    def total(p: Column) -> Column:
        steps = F.transform(p, lambda i, j: F.coalesce(F.least(F.lit(WINDOW), i - F.get(p, j - 1)), F.lit(WINDOW)))
        return F.aggregate(steps, F.lit(0), lambda acc, x: acc + x)

    pairs = F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i")))
    return let(F.sort_array(pairs), lambda a: let(places(a), total))


def _words(text: Column) -> Column:
    """n_words, word_chars and n_repeat_words in one pass over the split text."""

    def repeated(hashes: Column) -> Column:
        some = let(_windows(hashes), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)))
        return F.when(F.size(hashes) < WINDOW, F.lit(0)).otherwise(some)

    def counts(words: Column) -> Column:
        return F.struct(F.size(words).cast("long").alias("n_words"), F.length(F.array_join(words, "")).cast("long").alias("word_chars"), let(F.transform(words, lambda w: F.xxhash64(w)), repeated).cast("long").alias("n_repeat_words"))

    return let(F.regexp_extract_all(text, F.lit(WORD), F.lit(0)), counts)


def _dup_lines(text: Column) -> Column:
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD))
    return let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long")


#: Each count by itself.
COUNTS: dict[str, Callable[[Column], Column]] = {
    "n_words": lambda text: F.regexp_count(text, F.lit(WORD)).cast("long"),
    "word_chars": lambda text: F.length(F.regexp_replace(text, SPACE, "")).cast("long"),
    "n_symbols": lambda text: F.regexp_count(text, F.lit(r"[#*$%&|<>]")).cast("long"),
    "n_dup_lines": _dup_lines,
    "n_repeat_words": lambda text: _words(text)["n_repeat_words"],
}


def _counts(*made: str) -> Count:
    """Counts of the column ``text``: columns where they are ``made``, else expressions."""
    return lambda name: F.col(name) if name == "text" or name in made else COUNTS[name](F.col("text"))


def _rejects(rule: Rule, counts: Count) -> Column:
    return ~F.coalesce(rule.accept(counts), F.lit(False))


def base_counts(docs: DataFrame, *keep: str) -> DataFrame:
    """doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, text, and ``keep``."""
    rows = docs.select("doc_id", *keep, text_of("text").alias("text"))
    counted = rows.select("*", _words(F.col("text")).alias("w"), F.regexp_count("text", F.lit(r"[#*$%&|<>]")).cast("long").alias("n_symbols"), _dup_lines(F.col("text")).alias("n_dup_lines"))
    return counted.select("doc_id", *keep, "text", "w.n_words", "w.word_chars", "n_symbols", "n_dup_lines", "w.n_repeat_words")


def order_rules(docs: DataFrame, rules: Sequence[Rule] = BASE_RULES + RULES, sample_rows: int = 2000) -> list[Rule]:
    """The rules by falling rejections per second on a sample of at most ``sample_rows`` rows.

    The sample is taken by a hash of the id before it is limited.  A rule's time is that of
    a job over the sample, repeated in the job where it is short, less that of the same job
    without a rule.  Gains within a factor of two count as equal, so that runs agree.
    """
    share = 2 * sample_rows / max(1, docs.count())
    grains = 1 << 20
    some = docs.select(F.col("doc_id"), text_of("text").alias("text")).filter(F.pmod(F.xxhash64("doc_id"), F.lit(grains)) < math.ceil(min(1.0, share) * grains))
    sample = Scratch(docs.sparkSession, "rule-sample").put(some.select("text").limit(sample_rows).repartition(8), "rows")

    def seconds(out: Column, times: int) -> tuple[float, int, int]:
        rows = sample.withColumn("time", F.explode(F.sequence(F.lit(1), F.lit(times))))
        began = time.perf_counter()
        row = rows.agg(F.count(F.lit(1)).alias("n"), F.count_if(out).alias("out")).first()
        return time.perf_counter() - began, row["n"], row["out"]

    nothing = F.length("text") < 0
    seconds(nothing, 1)  # the first job also compiles
    empty = {times: seconds(nothing, times)[0] for times in (1, 20)}
    gains = {}
    for rule in rules:
        for times in (1, 20):
            took, n, out = seconds(_rejects(rule, _counts()), times)
            if took > 1:
                break
        cost = max(took - empty[times], 1e-3) / max(1, n)
        gains[rule.name] = round(math.log2((out + times) / (n + 2 * times) / cost))
    return sorted(rules, key=lambda r: (-gains[r.name], r.name))


def cascade(rules: Sequence[Rule], counts: Count) -> Column:
    """False at the first rule that fails; later rules, and counts that only they need, are not evaluated then."""
    verdict = F.when(F.lit(False), F.lit(False))
    for r in rules:
        verdict = verdict.when(_rejects(r, counts), F.lit(False))
    return verdict.otherwise(F.lit(True))


def judge(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """One row per document: doc_id, the base counts, base_failed, kept."""
    ordered = order_rules(docs, [*BASE_RULES, *rules], sample_rows)
    base = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
    return base_counts(docs).select("doc_id", *base, F.expr(BASE_FAILED).alias("base_failed"), cascade(ordered, _counts(*base)).alias("kept"))


def keep(docs: DataFrame, rules: Sequence[Rule] = RULES, sample_rows: int = 2000) -> DataFrame:
    """The rows of ``docs``, all columns, that pass all rules."""
    ordered = order_rules(docs, [*BASE_RULES, *rules], sample_rows)
    return with_row(docs, text=text_of("text")).filter(cascade(ordered, _counts())).select(*row_columns(docs))
