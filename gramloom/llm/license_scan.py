"""License scans: ordered signature rules behind keyword gates, resolved by rank and containment.

A text is read as words: maximal runs of 0-9, a-z (A-Z lower-cased) and characters from U+0080.

1. Texts without any of a few word pieces (``license_rules.ROOTS``) go no further: most texts
   cost a few substring searches.
2. The others become one string in which each word carries its place, `` mit#7 license#8``.
   Whatever the layout of the text was, rules see single blanks, and what a rule matches tells
   by its own digits where it begins and ends.
3. Of the hundreds of rules only those are run whose keyword stands in the text.
4. All detections of a text, sorted by place, are resolved in two passes.  One that lies in
   another of the same or a better class goes (of equal spans the better class, then the
   smaller label stays); so does one that has another of a better class within it.
   Best are tags, then sentences of a notice, grants with a name, names, mere mentions.

Everything is a projection: no shuffle, no Python, one row's work at a time, linear in its
detections.  The phrases of ``license_rules.BASE`` count in any case, beside the rules.

Defined results: a null text is empty and has no words; n_base counts all places of all
phrases; first_word and last_word are null without a place; label lists are sorted, distinct
and comma-joined, empty if there are none; score is the sureness of the best class that
stays (0 without any).  Rows are judged one by one, so repeated rows, null ids and ties
between rows do not matter; texts are read whole; an empty table gives no rows.  Extra
columns of any name are ignored by :func:`scan`, and returned by :func:`detections`.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import let, row_columns, text_of, with_row
from .license_rules import BASE, ROOTS, RULES, SURENESS, LicenseRule, on_places

#: Words of a text as it is, and of one with A-Z lower-cased.
RAW_WORD = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
LOWER_WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_DETECTION = "struct<start:int,less_end:int,rank:int,label:string>"
_FLAGGED = "struct<d:struct<start:int,less_end:int,rank:int,label:string>,out:boolean>"
#: A list that grows by one is built of pieces of this length.
PIECE = 256
_FAR = 2**31 - 1


def placed_words(text: Column) -> Column:
    """The words of a text with their places, in one string: `` mit#0 license#1``."""
    words = F.regexp_extract_all(F.translate(text, _UPPER, _LOWER), F.lit(LOWER_WORD), F.lit(0))
    numbered = F.transform(words, lambda w, i: F.concat(F.lit(" "), w, F.lit("#"), i.cast("string")))
    return F.array_join(numbered, "")


def _literal(rules: Sequence[LicenseRule]) -> Column:
    quoted = lambda s: "'" + s.replace("\\", "\\\\").replace("'", "\\'") + "'"
    rows = [f"named_struct('rank', {r.rank}, 'label', {quoted(r.label)}, 'keyword', {quoted(r.keyword)}, 'pattern', {quoted(on_places(r.pattern))})" for r in rules]
    return F.expr(f"array({', '.join(rows)})")


def _found(placed: Column, rules: Sequence[LicenseRule]) -> Column:
    """All detections, sorted by start, wider ones first, then by class and label."""
    if not rules:
        return F.array().cast(f"array<{_DETECTION}>")

    def of(rule: Column) -> Column:
        span = lambda m: F.struct(F.regexp_extract(m, "#([0-9]+)", 1).cast("int").alias("start"), (-F.regexp_extract(m, "#([0-9]+)$", 1).cast("int")).alias("less_end"), rule["rank"].alias("rank"), rule["label"].alias("label"))
        return F.transform(F.regexp_extract_all(placed, rule["pattern"], F.lit(0)), span)

    asked = F.filter(_literal(rules), lambda r: F.contains(placed, r["keyword"]))
    return F.sort_array(F.flatten(F.transform(asked, of)))


def _appended(full: Column, last: Column, x: Column) -> tuple[Column, Column]:
    """A list in pieces with one more entry; each step copies one piece at most, or the list of pieces."""
    there = F.size(last) >= PIECE
    return F.when(there, F.concat(full, F.array(last))).otherwise(full), F.when(there, F.array(x)).otherwise(F.concat(last, F.array(x)))


def _pass(items: Column, start: int, judge, step) -> Column:
    """``items`` of (d, out) in order, with ``out`` set where ``judge`` says so of what went before."""
    seen = F.array(*[F.lit(start)] * len(SURENESS))
    none = F.array().cast(f"array<{_FLAGGED}>")
    zero = F.struct(seen.alias("seen"), F.array().cast(f"array<array<{_FLAGGED}>>").alias("full"), none.alias("last"))

    def one(acc: Column, x: Column) -> Column:
        full, last = _appended(acc["full"], acc["last"], F.struct(x["d"].alias("d"), (x["out"] | judge(acc["seen"], x["d"])).alias("out")))
        return F.struct(F.transform(acc["seen"], lambda m, i: F.when(i + 1 == x["d"]["rank"], step(m, -x["d"]["less_end"])).otherwise(m)).alias("seen"), full.alias("full"), last.alias("last"))

    return F.aggregate(items, zero, one, lambda acc: F.concat(F.flatten(acc["full"]), acc["last"]))


def resolved(found: Column) -> Column:
    """The detections that stay."""
    items = F.transform(found, lambda d: F.struct(d.alias("d"), F.lit(False).alias("out")))
    within = _pass(items, -1, lambda seen, d: F.array_max(F.slice(seen, F.lit(1), d["rank"])) >= -d["less_end"], F.greatest)
    better_inside = lambda seen, d: (d["rank"] > 1) & (F.coalesce(F.array_min(F.slice(seen, F.lit(1), d["rank"] - 1)), F.lit(_FAR)) <= -d["less_end"])
    both = _pass(F.reverse(within), _FAR, better_inside, F.least)
    return F.transform(F.filter(both, lambda x: ~x["out"]), lambda x: x["d"])


def _base_places(placed: Column, phrase: str) -> Column:
    """Where the words of a phrase stand one after the other: the places of its first word."""
    return F.transform(F.regexp_extract_all(placed, F.lit(on_places(phrase)), F.lit(0)), lambda m: F.regexp_extract(m, "#([0-9]+)", 1).cast("long"))


def _scanned(text: Column, rules: Sequence[LicenseRule], base: dict[str, str]) -> Column:
    """places, base_labels, stays of a text that passed the gate."""

    def looked(placed: Column) -> Column:
        per_phrase = [_base_places(placed, p) for p in base]
        labels = F.array_distinct(F.filter(F.array(*[F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(per_phrase, base.values())]), lambda x: x.isNotNull()))
        return F.struct(F.flatten(F.array(*per_phrase)).alias("places"), F.sort_array(labels).alias("base_labels"), let(_found(placed, rules), resolved).alias("stays"))

    return let(placed_words(text), looked)


def _gated(text: Column, rules: Sequence[LicenseRule], base: dict[str, str]) -> Column:
    nothing = F.lit(None).cast(f"struct<places:array<bigint>,base_labels:array<string>,stays:array<{_DETECTION}>>")
    perhaps = let(F.lower(text), lambda low: reduce(lambda a, b: a | b, [F.contains(low, F.lit(r)) for r in ROOTS]))
    return F.when(perhaps, _scanned(text, rules, base)).otherwise(nothing)


def detections(docs: DataFrame, rules: Sequence[LicenseRule] = RULES) -> DataFrame:
    """The rows of ``docs`` with ``licenses``: what was found and stays, as (first_word, last_word, rank, label).

    Rules and phrases must have one of ``ROOTS`` in all that they match.
    """
    scanned = with_row(docs, found=_gated(text_of("text"), rules, BASE)["stays"])
    spans = F.transform(F.coalesce("found", F.array().cast(f"array<{_DETECTION}>")), lambda d: F.struct(d["start"].alias("first_word"), (-d["less_end"]).alias("last_word"), d["rank"].alias("rank"), d["label"].alias("label")))
    return scanned.select(*row_columns(docs, "licenses"), spans.alias("licenses"))


def scan(docs: DataFrame, rules: Sequence[LicenseRule] = RULES, base: dict[str, str] = BASE) -> DataFrame:
    """One row per document: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score."""
    text = text_of("text")
    rows = docs.select("doc_id", F.regexp_count(text, F.lit(RAW_WORD)).cast("long").alias("n_words"), _gated(text, rules, base).alias("f"))
    none, no_places = F.array().cast("array<string>"), F.array().cast("array<bigint>")
    base_labels, places = F.coalesce("f.base_labels", none), F.coalesce("f.places", no_places)
    own = F.coalesce(F.transform("f.stays", lambda d: d["label"]), none)
    rank = F.array_min(F.transform("f.stays", lambda d: d["rank"]))
    sure = F.coalesce(F.get(F.array(*[F.lit(x) for x in SURENESS]), rank - 1), F.lit(0.0))
    return rows.select("doc_id", "n_words", F.size(places).cast("long").alias("n_base"), F.array_min(places).alias("first_word"), F.array_max(places).alias("last_word"), F.array_join(base_labels, ",").alias("base_labels"), F.array_join(F.sort_array(F.array_union(base_labels, own)), ",").alias("labels"), sure.alias("score"))
