"""Filter audit, license scans and spelling variants against brute force on small tables."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from itertools import permutations

import pytest
from pyspark.sql import functions as F
from test_llm import ROWS, SCHEMA, got, words

from gramloom.llm import filter_audit, license_rules, license_scan, spelling
from gramloom.llm.common import Scratch

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


# -- filter audit ----------------------------------------------------------------


def audit_rows():
    rng = random.Random(3)
    rows = [list(r) for r in ROWS]
    long = " ".join(f"w{k}" for k in range(130))
    texts = [long, long, long + " #", long.upper(), long + " end", "same " * 150, long, "", None, "", "A B C", long.upper()]
    for k, t in enumerate(texts):
        rows.append([1000 + k, t, rng.choice(["en", "de", None]), "s", 0, "x", 1, "x"])
    rows += [[None, long, "en", "s", 0, "x", 1, "x"], [1000, long, "de", "s", 0, "x", 1, "x"], [5, long, "en", "s", 0, "x", 1, "x"]]
    shared = "z" * 3000  # texts that part late, beyond all first lengths
    rows += [[2000 + k, shared + str(k % 7), "en", "s", 0, "x", 1, "x"] for k in range(20)]
    return [tuple(r) for r in rows]


def fails(t):
    w = words(t)
    return {f for f, bad in zip("ABCD", (len(w) < 100, 100 * len(set(w)) < 80 * len(w), 100 * len(re.findall("[A-Z]", t)) > 10 * len(t), bool(re.search(r"[#$%&*|]", t)))) if bad}


def audit_brute(rows, labels):
    least = {}
    for i, t, *_ in rows:
        if i is not None:
            least[t or ""] = min(i, least.get(t or "", i))
    good, toxic = ({i for i, *_ in labels if i is not None} & {i for i, *m in labels if m[k] == 1} for k in (0, 1))
    docs = [(lang or "", fails(t or "") | ({"E"} if i is not None and i > least[t or ""] else set()), i) for i, t, lang, *_ in rows]
    out = []
    for part in {p for p, *_ in docs}:
        own = [(f, i) for p, f, i in docs if p == part]
        shares = Counter()
        made = []
        for order in permutations("ABCDE"):
            left = own
            for step, x in enumerate(order, 1):
                gone = [(f, i) for f, i in left if x in f]
                redundant = sum(x in f and bool(f & set(order[: step - 1])) for f, _ in own)
                left = [(f, i) for f, i in left if x not in f]
                shares[x] += len(gone)
                made.append((part, "".join(order), step, len(left), len(gone), redundant, sum(f == {x} for f, _ in own), sum(i in good for _, i in gone), sum(i in toxic for _, i in gone), x))
        out += [(*m[:9], shares[m[9]]) for m in made]
    return sorted(out, key=repr)


@pytest.mark.parametrize("trie_bytes", [32 << 20, 2000])
def test_audit(spark, trie_bytes):
    rows = audit_rows()
    labels = [(i, i % 2, int(i % 3 == 0)) for i in range(60)] + [(1000, 0, 0), (1000, 1, None), (1001, 1, 1), (None, 1, 1), (2003, 1, 0)]
    docs = spark.createDataFrame(rows, SCHEMA).repartition(4)
    out = filter_audit.audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), trie_bytes)
    assert got(out) == audit_brute(rows, labels)


def test_audit_of_nothing(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert filter_audit.audit(spark.createDataFrame([], SCHEMA), labels).count() == 0
    one = filter_audit.audit(spark.createDataFrame([(1, None, None)], "doc_id long, text string, lang string"), labels).toPandas()
    assert len(one) == 600 and set(one["part"]) == {""} and one["removed"].sum() == 120


def test_prefixes_are_cut_only_where_texts_part(spark):
    texts = ["a" * 50] * 40 + ["b" * 30 + str(k) for k in range(10)] + ["c"]
    docs = spark.createDataFrame([(k, t) for k, t in enumerate(texts)], "doc_id long, text string")
    cuts, total = filter_audit.prefix_cuts(docs, 100, Scratch(spark, "t"))
    assert total == len("a" * 50) + 10 * 31 + 1  # copies count once
    assert all("a" not in {p[:1] for p in further} for _, further in cuts)  # one text is never cut
    assert {filter_audit.prefix_of(t, cuts) for t in texts[40:50]} == set(texts[40:50])


def test_trie_finds_every_text():
    rng = random.Random(1)
    texts = [bytes(rng.choice(b"ab") for _ in range(rng.randint(0, 12))) for _ in range(3000)] + [b"x" * 500 + bytes([c]) for c in range(50)]
    trie, n = filter_audit.RadixTrie(), Counter()
    for t in texts:
        terminal = trie.terminal(t)
        terminal[0] = t
        n[t] += 1
    assert sorted(x[0] for x in trie.terminals()) == sorted(set(texts))
    assert all(trie.terminal(t)[0] == t for t in texts)


# -- license scans ----------------------------------------------------------------

LICENSED = [
    "Released under the MIT License.",
    "This work is licensed under the GNU General Public License, version 3.",
    "Licensed under the Apache\nLicense,   Version 2.0.",
    "SPDX-License-Identifier: BSD-3-Clause\ncode",
    "mit license mit license MIT-LICENSE apache license",
    "Copyright (c) 2019 2020 A. All rights reserved.",
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that neither name may be used to endorse or promote products derived from this software without specific prior written permission",
    "commit license mitlicense general public licenses",
    "see the licence", "licensed under something else", "the gnu general public license", "THİS LİCENSE", "mit © license", "general\x85public license",
    None, "", "x " * 3000 + "MIT License" + " y" * 3000, "MIT License. " * 700,
    "CC BY-NC 4.0 license; licensed under CC BY-NC 4.0.", "dual licensed: gpl v2 or later, or a commercial license",
]


def placed(t):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOWER))
    return w, "".join(f" {x}#{k}" for k, x in enumerate(w))


def scan_brute(i, t):
    w, text = placed(t)
    spots = [(k, label) for phrase, label in license_rules.BASE.items() for k in range(len(w)) if w[k : k + len(phrase.split())] == phrase.split()]
    found = set()
    for r in license_rules.RULES:
        for m in re.finditer(license_rules.on_places(r.pattern), text):
            ends = re.findall("#([0-9]+)", m[0])
            found.add((int(ends[0]), -int(ends[-1]), r.rank, r.label))
    found = sorted(found)
    stays = []
    for d in found:
        held = any(o != d and o[0] <= d[0] and o[1] <= d[1] and (o[2] < d[2] or o[2] == d[2] and (o[:2] != d[:2] or o[3] < d[3])) for o in found)
        holds = any(d[0] <= o[0] and d[1] <= o[1] and o[2] < d[2] for o in found)
        if not held and not holds:
            stays.append(d)
    base = sorted({x for _, x in spots})
    labels = sorted({*base, *(d[3] for d in stays)})
    first, last = (min(k for k, _ in spots), max(k for k, _ in spots)) if spots else (None, None)
    return (i, len(w), len(spots), first, last, ",".join(base), ",".join(labels), max((license_rules.SURENESS[d[2] - 1] for d in stays), default=0.0))


def test_license_scan(spark):
    rows = [(k, t, "x", 1.5) for k, t in enumerate(LICENSED)] + [(3, LICENSED[3], "x", 1.5), (None, LICENSED[0], "x", 1.5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, labels string, score double").repartition(2)
    assert got(license_scan.scan(docs)) == sorted((scan_brute(i, t) for i, t, *_ in rows), key=repr)
    found = license_scan.detections(docs)
    assert found.columns == ["doc_id", "text", "labels", "score", "licenses"] and found.count() == len(rows)
    spans = {r["doc_id"]: [tuple(x) for x in r["licenses"]] for r in found.filter("doc_id IN (0, 16)").collect()}
    assert spans[0] == [(0, 4, 3, "mit")] and [s[3] for s in spans[16]] == ["mit"] and spans[16][0][:2] == (3000, 3001)
    assert license_scan.scan(docs.limit(0)).count() == 0
    assert license_scan.scan(docs, rules=()).filter("score > 0").count() == 0


def examples(pattern):
    """A shortest and a longest text that a pattern matches."""
    import re._parser as parser

    def made(tree, long):
        out = ""
        for op, arg in tree:
            name = str(op)
            if name == "LITERAL":
                out += chr(arg)
            elif name == "IN":
                out += "q" if str(arg[0][0]) == "NEGATE" else chr(arg[0][1] if str(arg[0][0]) == "LITERAL" else arg[0][1][0])
            elif name == "SUBPATTERN":
                out += made(arg[3], long)
            elif name == "BRANCH":
                out += made(arg[1][-1 if long else 0], long)
            elif name == "MAX_REPEAT":
                low, high, inner = arg
                out += made(inner, long) * (max(low, min(int(high), 3)) if long else low)
            else:
                raise AssertionError(name)
        return out

    tree = parser.parse(pattern.replace(" ?", "(?: |)").replace("~", "wild"))
    return {made(tree, False).strip(), made(tree, True).strip()}


def test_every_rule_has_its_keyword_and_is_found(spark):
    assert len(license_rules.RULES) > 200
    texts = []
    for r in license_rules.RULES:
        for t in examples(r.pattern):
            assert r.keyword in t and any(x in t for x in license_rules.ROOTS), (r, t)
            assert re.search(license_rules.on_places(r.pattern), placed(t)[1]), (r, t)
            texts.append(t)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert got(license_scan.scan(docs)) == sorted((scan_brute(i, t) for i, t in enumerate(texts)), key=repr)


# -- spelling variants ---------------------------------------------------------------


def counts_brute(rows, every=199, shortest=6, least=5):
    n = Counter()
    for i, t, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if every and h % every == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= shortest:
                n[run] += 1
    return {w: k for w, k in n.items() if k >= least}


def near(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:k] + b[k + 1 :] == a for k in range(len(b)))


def variants_brute(n, factor=5):
    by_length = defaultdict(list)
    for w in n:
        by_length[len(w)].append(w)
    close = {w: [v for d in (-1, 0, 1) for v in by_length[len(w) + d] if near(w, v)] for w in n}
    form = {}
    for w, vs in close.items():
        best = min(vs, key=lambda v: (-n[v], v), default=None)
        if best is not None and n[best] >= factor * n[w]:
            form[w] = best

    def root(w):
        return root(form[w]) if w in form else w

    return sorted(((w, form.get(w), root(w), n[w], len(close[w]), n[form[w]] if w in form else None) for w in n), key=repr)


def spelled_rows():
    rng = random.Random(11)
    base = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(6, 9))) for _ in range(60)] + ["straße", "ÀÉÎõü×"]
    text = []
    for w in base:
        k = 2 ** rng.randint(0, 9)
        text += [w] * k
        for _ in range(3):
            v, at = list(w), rng.randrange(len(w))
            v[at : at + 1] = rng.choice([[], [rng.choice("abxy")], [v[at], rng.choice("abxy")]])
            text += ["".join(v)] * max(1, k // rng.choice([1, 4, 6, 30]))
    text += ["anagram"] * 40 + ["margana"] * 40 + ["MiXeDx"] * 9 + ["short"] * 50 + ["w" * 4000] * 6 + ["w" * 4001] * 40
    rng.shuffle(text)
    rows = [(k, " ".join(text[k * 40 : k * 40 + 40]) + ("\n1st-two.three_FOUR 漢字" if k % 3 else "")) for k in range(len(text) // 40 + 1)]
    return [*rows, (None, " ".join(text[:300])), (None, None), (7, rows[7][1]), (8, "")]


def test_spelling_variants(spark):
    rows = spelled_rows()
    docs = spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, word string").repartition(3)
    words_found = spelling.word_counts(docs, typo_every=199)
    want = counts_brute(rows)
    assert dict(words_found.collect()) == want
    assert any(w in want for w in ("w" * 4000, "w" * 3999))
    out = variants_brute(want)
    assert sum(r[1] is not None for r in out) > 20
    assert got(spelling.group_variants(words_found)) == out
    assert dict(spelling.word_counts(docs).collect()) == counts_brute(rows, every=None)


def test_chains_of_forms_are_followed_to_the_end(spark):
    chain = [("a" * k + "b" * (20 - k), 2 * 5**k) for k in range(13)]
    out = {r["word"]: r for r in spelling.group_variants(spark.createDataFrame(chain, "word string, n long")).collect()}
    assert all(r["root"] == chain[-1][0] for r in out.values()) and out[chain[0][0]]["form"] == chain[1][0]


def test_no_words(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert spelling.group_variants(spelling.word_counts(empty)).count() == 0
    with pytest.raises(ValueError):
        spelling.group_variants(spelling.word_counts(empty), factor=1)
    assert spelling.word_counts(empty.select(F.col("doc_id"), "text")).columns == ["word", "n"]


# -- sharding: as many partitions as hold a few buckets each ---------------------------------------------


def test_buckets_count_whole_rows_and_share_partitions_evenly(spark):
    from gramloom.llm import sharding

    rows = [(k, "t", "w" * 4000, [k, k], b"z" * 100) for k in range(200)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, wide string, list array<long>, raw binary").repartition(4)
    made = docs.select(sharding._row_bytes(docs).alias("n"), "doc_id").collect()
    assert all(r["n"] == 40 + 1 + 4000 + 100 + len('{"list":[' + f"{r['doc_id']},{r['doc_id']}" + "]}") for r in made)
    out = sharding.shuffle_into_shards(docs, bucket_bytes=10_000)
    assert out.rdd.getNumPartitions() == math.ceil(math.ceil(sum(r["n"] for r in made) / 10_000) / sharding.TASK_BUCKETS) > 8
    assert got(out.select("doc_id", "wide")) == got(docs.select("doc_id", "wide"))
    n = out.groupBy("shard").count().toPandas()["count"]
    assert n.max() - n.min() <= 1 and len(n) == 40
