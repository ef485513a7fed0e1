"""The operators against brute force on small tables with nulls, ties, repeats and odd columns."""

import hashlib
import math
import os
import random
import re
import zlib
from collections import Counter, defaultdict

import pyarrow as pa
import pytest

from gramloom.llm.common import Scratch
from gramloom.llm import exact_dedup, line_dedup, lm_scoring, minhash, mixing, quality_gam, quality_rules, sentencepiece_codec, sharding, wordpiece

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
SPACE = " \t\n\x0b\x0c\r"
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, h string, block int, size string"
needs_model = pytest.mark.skipif(not os.path.exists(MODEL), reason="no tokenizer files")


def make_rows():
    rng = random.Random(5)
    vocab = ["".join(rng.choice("abcdeéü") for _ in range(rng.randint(1, 6))) for _ in range(300)]
    text = lambda n: "\n".join(" ".join(rng.choice(vocab) for _ in range(rng.randint(3, 12))) for _ in range(n))
    base = [text(rng.randint(3, 9)) for _ in range(40)]
    texts = list(base)
    for b in base[:12]:  # near copies, some of copies
        w = b.split(" ")
        for _ in range(3):
            v = list(w)
            v[rng.randrange(len(v))] = "changed"
            texts.append(" ".join(v))
    texts += base[:5] + [b.replace("\n", " \t") for b in base[:6]] + [base[0]] * 10
    texts += [t + "\n Shared LINE \n" for t in base[20:33]]
    texts += [None, "", " \n\t", "one", "One", "two words", "x " * 40, "a\x0bb\x0cc", "漢字酷 😀 y", " ".join(rng.choice(vocab) for _ in range(20_000))]
    rows = [(i, t, "en", rng.choice(["s1", "s2", "s1", "s1", None, ""]), 0, "clash", 7, "clash") for i, t in enumerate(texts)]
    return [*rows, (3, texts[3], "en", "s1", 0, "clash", 7, "clash"), (None, "no id here", None, None, None, None, None, None)]


ROWS = make_rows()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def test_exact_dedup(docs, empty):
    groups = defaultdict(list)
    norm = lambda t: (t or "").translate({ord(c): None for c in SPACE})
    for i, t, *_ in ROWS:
        groups[norm(t)].append((-len(t or ""), i is None, i))
    want = []
    for i, t, *_ in ROWS:
        g = sorted(groups[norm(t)])
        want.append((i, g[0][2], len(g), i == g[0][2] and -len(t or "") == g[0][0], hashlib.sha256(norm(t).encode()).hexdigest()))
    for size in (1 << 20, 2):  # one bucket, and many splits
        out = exact_dedup.exact_groups(docs, size).select("doc_id", "keep_id", "group_size", "kept", "text_sha256")
        assert got(out) == sorted(want, key=repr)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns and kept.count() == len(groups)
    assert exact_dedup.exact_groups(empty).count() == 0 and exact_dedup.drop_exact_copies(empty).count() == 0


def test_directory_splits_only_overfull_buckets(spark):
    rng = random.Random(3)
    hashes = [rng.randrange(-(2**63), 2**63) for _ in range(300)] + [(5 << 60) + k for k in range(60)]
    entries = spark.createDataFrame([(h,) for h in hashes], "h long")
    rows = exact_dedup.grow_directory(entries, 25, Scratch(spark, "test-directory")).collect()
    bits = {r["bits"] for r in rows}.pop()
    by_slot = {r["slot"]: (r["bucket"], r["depth"]) for r in rows}
    assert len(by_slot) == len(rows) and bits <= exact_dedup.MOST_BITS
    load = Counter(by_slot[(h % 2**64) >> (64 - bits)] for h in hashes)
    # only the bucket that no bit can split is overfull; halves of a split bucket together are overfull
    assert sorted(load.values())[-1] >= 60 and sorted(load.values())[-2] <= 25
    for (bucket, depth), n in load.items():
        if 0 < depth:
            parent = bucket >> (bits - depth + 1)
            assert sum(1 for h in hashes if (h % 2**64) >> (64 - depth + 1) == parent) > 25


def test_mixing(docs, empty):
    out = mixing.mix(docs).toPandas()
    assert len(out) == len(ROWS)
    sizes = Counter()
    for _, t, _, s, *_ in ROWS:
        sizes[s] += len(words(t))
    order = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: (3, 1, 2)[k % 3] for k, s in enumerate(order)}
    target, open_ = {}, set(order)
    left = 1.5 * sum(sizes.values())
    while open_:
        level = left / sum(weight[s] for s in open_)
        over = {s for s in open_ if 2 * sizes[s] < level * weight[s]}
        if not over:
            target.update({s: level * weight[s] for s in open_})
            break
        for s in over:
            target[s] = 2 * sizes[s]
            left -= target[s]
        open_ -= over
    largest = max(len(words(t)) for _, t, *_ in ROWS)
    by = out.assign(source=out["source"].where(out["source"].notna(), "NULL")).groupby("source")
    for s in order:
        part = by.get_group("NULL" if s is None else s)
        assert part["source_size"].iloc[0] == sizes[s] and math.isclose(part["target"].iloc[0], target[s])
        assert abs(part["taken"].sum() - target[s]) <= largest
    assert (out["taken"] <= 2 * out["size"]).all()
    rows = mixing.mixed_rows(docs)
    assert rows.columns == docs.columns and rows.count() == out["copies"].sum()
    assert got(mixing.mix(docs.repartition(7))) == got(mixing.mix(docs))
    assert mixing.mix(empty).count() == 0 and mixing.mixed_rows(empty).count() == 0


@pytest.mark.parametrize("n", [2, 5])
def test_minhash(docs, empty, n):
    sets, ids = [], [-1 if r[0] is None else r[0] for r in ROWS]
    for _, t, *_ in ROWS:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(len(w) - n + 1)} or ({tuple(w)} if w else set()))
    parent = list(range(len(ROWS)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in range(len(ROWS)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                parent[root(a)] = root(b)
    least = defaultdict(lambda: 10**9)
    for k in range(len(ROWS)):
        least[root(k)] = min(least[root(k)], ids[k])
    none = lambda x: None if x == -1 else x
    want = [(none(ids[k]), len(sets[k]), none(least[root(k)]), ids[k] == least[root(k)]) for k in range(len(ROWS))]
    out = minhash.near_groups(docs, n=n).select("doc_id", "n_shingles", "component_id", "kept")
    assert got(out) == sorted(want, key=repr)
    if n == 5:
        kept = minhash.drop_near_copies(exact_dedup.drop_exact_copies(docs), 5)
        assert kept.columns == docs.columns
        assert minhash.near_groups(empty).count() == 0


def test_minhash_finds_a_hub_that_is_not_the_smallest(spark):
    """Copies of one original that are too far from each other; the original has the largest id."""
    rng = random.Random(2)
    w = [f"w{k}" for k in range(120)]
    rows = []
    for i in range(40):
        v = list(w)
        for k in rng.sample(range(len(v)), 5):
            v[k] = f"x{i}_{k}"
        rows.append((i, " ".join(v)))
    rows.append((99, " ".join(w)))
    out = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), n=2).toPandas()
    assert set(out["component_id"]) == {0}


@needs_model
def test_wordpiece(docs, empty):
    with open(MODEL, "rb") as f:
        initial, rest = map(set, wordpiece.vocabulary(f.read()))

    def count(w):
        n = i = 0
        while i < len(w):
            j = next((j for j in range(len(w), i, -1) if w[i:j] in (rest if i else initial)), None)
            if j is None:
                return 1, 1
            n, i = n + 1, j
        return n, 0

    want = []
    for i, t, *_ in ROWS:
        c = [count(w) for w in words(t)]
        want.append((i, len(c), sum(x for x, _ in c), sum(u for _, u in c)))
    assert got(wordpiece.count_tokens(docs, MODEL)) == sorted(want, key=repr)
    assert wordpiece.count_tokens(empty, MODEL).count() == 0


def test_automaton_backtracks():
    a = wordpiece.PieceAutomaton(["a", "ab", "abcd"], ["b", "c", "bc", "x"])
    assert [a.count(w) for w in ("abc", "abcd", "abcx", "az", "abcdx", "")] == [(2, False), (1, False), (3, False), (1, True), (2, False), (0, False)]


def test_quality_rules(docs, empty):
    want = []
    for i, t, *_ in ROWS:
        t = t or ""
        w = words(t)
        wins = [tuple(w[k : k + 8]) for k in range(len(w) - 7)]
        c = Counter(wins)
        hit = {k + d for k, x in enumerate(wins) if c[x] > 1 for d in range(8)}
        lines = [x for x in t.split("\n") if words(x)]
        failed = len(w) < 20 or 100 * len(hit) > 30 * len(w)
        want.append((i, len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(hit), failed))
    out = quality_rules.judge(docs)
    assert got(out.drop("kept")) == sorted(want, key=repr)
    assert out.filter("base_failed AND kept").count() == 0 and out.filter("kept").count() > 30
    assert got(quality_rules.judge(docs, tuple(reversed(quality_rules.RULES)))) == got(out)
    assert quality_rules.judge(empty).count() == 0 and quality_rules.keep(empty).count() == 0
    kept = quality_rules.keep(docs)
    assert kept.columns == docs.columns
    assert got(kept.select("doc_id")) == got(out.filter("kept").select("doc_id"))


def test_line_dedup(docs, empty):
    lower = lambda x: "".join(c.lower() if "A" <= c <= "Z" else c for c in x)
    key = lambda x: lower(x.strip(SPACE))
    seen = Counter(k for _, t, *_ in ROWS for k in {key(x) for x in (t or "").split("\n")})
    common = {k for k, n in seen.items() if n >= 10 and k}
    assert "shared line" in common
    want = []
    for i, t, *_ in ROWS:
        lines = (t or "").split("\n")
        stay = [x for x in lines if key(x) not in common]
        want.append((i, len(lines), len(lines) - len(stay), hashlib.sha256("\n".join(stay).encode()).hexdigest()))
    assert got(line_dedup.common_lines_report(docs)) == sorted(want, key=repr)
    parts = [docs.filter(f"coalesce(doc_id, 0) % 6 = {k}") for k in range(6)]
    assert got(line_dedup.common_lines_report(docs, batches=parts, fanout=2)) == sorted(want, key=repr)
    assert line_dedup.common_lines_report(empty).count() == 0


@needs_model
def test_sentencepiece(docs, empty):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    coded = sentencepiece_codec.encode(docs, MODEL)
    assert set(docs.columns) < set(coded.columns)
    for r in coded.collect():
        assert list(r["ids"]) == sp.encode(r["text"] or "")
    out = sentencepiece_codec.codec_report(docs, MODEL)
    assert out.count() == len(ROWS) and out.filter("NOT round_trip").count() == 0
    assert sentencepiece_codec.codec_report(empty, MODEL).count() == 0
    with open(MODEL, "rb") as f:
        c = sentencepiece_codec.codec(f.read())
    texts = ["<s> </s><0x0A>\n\t x", "▁a ▁▁", "  a  ", "a\x00b"]
    ids, at = c.encode(texts)
    assert [list(ids[a:b]) for a, b in zip(at, at[1:])] == sp.encode(texts)
    assert c.decode(ids, at) == sp.decode(sp.encode(texts))


def test_sharding(docs, empty, tmp_path):
    for size in (32 << 20, 4000):
        out = sharding.shard_report(docs, bucket_bytes=size).toPandas()
        n = out.groupby("shard").size()
        assert len(out) == len(ROWS) and n.max() - n.min() <= 1 and len(n) == 40
        for _, part in out.groupby("shard"):
            assert sorted(part["slot"]) == list(range(len(part)))
    want = sorted((repr(i), len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in ROWS)
    assert sorted((repr(None if x != x else int(x)), s, c) for x, s, c in zip(out["doc_id"], out["size"], out["text_crc32"])) == want
    assert got(sharding.shard_report(docs.repartition(5))) == got(sharding.shard_report(docs))
    sharding.write_shards(docs, str(tmp_path / "shards"), rows_per_file=2)
    back = docs.sparkSession.read.parquet(str(tmp_path / "shards"))
    assert got(back.select("doc_id", "text")) == got(docs.select("doc_id", "text"))
    assert sharding.shard_report(empty).count() == 0


def test_line_dedup_query_makes_levels_from_one_file(docs, spark, tmp_path, monkeypatch):
    from gramloom.llm import queries

    docs.coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    table = spark.read.parquet(str(tmp_path / "documents.parquet"))
    assert len(table.inputFiles()) == 1
    levels, write = [], line_dedup.LineRuns._write
    monkeypatch.setattr(line_dedup.LineRuns, "_write", lambda self, counts, level: (levels.append(level), write(self, counts, level)))
    out = got(queries.op6_line_dedup(spark, str(tmp_path)))
    assert levels == [0, 0, 0, 0, 1, 0, 0]
    monkeypatch.undo()
    assert out == got(line_dedup.common_lines_report(table))
    assert sum(b.count() for b in line_dedup.hash_batches(table)) == len(ROWS)


def test_lm_scoring(docs, empty):
    start = 256
    grams = [[tuple(([start] * 4 + list((t or "").encode()))[k : k + 5]) for k in range(len((t or "").encode()))] for _, t, *_ in ROWS]
    count = [Counter() for _ in range(6)]
    context = [Counter() for _ in range(6)]
    for g in (g for own in grams for g in own):
        for n in range(1, 6):
            count[n][g[5 - n :]] += 1
            context[n][g[5 - n : 4]] += 1
    logs = lambda g: next((5 - n) * math.log(0.4) + math.log(count[n][g[5 - n :]] / context[n][g[5 - n : 4]]) for n in range(5, 0, -1) if count[n][g[5 - n :]] >= (2 if n > 1 else 1))
    want = sorted((repr(r[0]), len(g), round(sum(map(logs, g)), 4)) for r, g in zip(ROWS, grams))
    for size in (32 << 20, 50_000):
        out = lm_scoring.score(docs, block_bytes=size).collect()
        assert sorted((repr(r["doc_id"]), r["n_units"], round(r["log_score"], 4)) for r in out) == want
    assert lm_scoring.score(empty).count() == 0


def test_lm_scoring_of_words(docs, empty, spark):
    texts = [[w for w in re.split(f"[{SPACE}]+", t or "") if w] for _, t, *_ in ROWS]
    pairs = Counter(p for w in texts for p in zip(["", *w], w))
    context, own = Counter(), Counter()
    for (a, b), c in pairs.items():
        context[a] += c
        own[b] += c
    n = sum(pairs.values())
    logs = lambda a, b: math.log(pairs[a, b] / context[a]) if pairs[a, b] >= 2 else math.log(0.4 * own[b] / n)
    want = sorted((repr(r[0]), len(w), round(sum(logs(*p) for p in zip(["", *w], w)), 4)) for r, w in zip(ROWS, texts))
    for size in (32 << 20, 50_000):
        out = lm_scoring.score_words(docs, block_bytes=size).collect()
        assert sorted((repr(r["doc_id"]), r["n_units"], round(r["log_score"], 4)) for r in out) == want
    assert lm_scoring.score_words(empty).count() == 0


def test_lm_scoring_query_sees_the_order_of_words(spark, tmp_path):
    from gramloom.llm import queries

    rng = random.Random(2)
    words = [f"word{k}" for k in range(60)]
    mixed = rng.sample(words, len(words))
    spark.createDataFrame([(k, " ".join(words)) for k in range(20)] + [(99, " ".join(mixed))], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    scores = {r["doc_id"]: r["mean_log_score"] for r in queries.op9_lm_scoring(spark, str(tmp_path)).collect()}
    assert scores[99] < scores[0] - 3


def test_quality_classifier(spark, empty):
    rng = random.Random(1)
    rows, labels = [], []
    for i in range(400):
        good = rng.random() < 0.6
        w = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(rng.randint(20, 60))]
        rows.append((i, " ".join(w) if good else " ".join(x.upper() + "!!" for x in w)))
        labels.append((i, int(good), 0))
    docs = spark.createDataFrame([*rows, (None, None), (7, "")], "doc_id long, text string")
    marks = spark.createDataFrame([*labels, (3, None, 0), (None, 1, 0), labels[5]], "doc_id long, quality int, toxic int")
    out = quality_gam.quality_report(docs, marks).toPandas()
    assert len(out) == 402 and out["score"].between(0, 1).all()
    assert ((out["score"] >= 0.3).astype(int) == out["predicted"]).all()
    truth = {i: q for i, q, _ in labels}
    held = out[out["held_out"] & out["doc_id"].notna()]
    assert (zlib.crc32(str(int(held["doc_id"].iloc[0])).encode()) % 5) == 0
    assert (held["predicted"] == held["doc_id"].map(truth)).mean() > 0.95
    none = quality_gam.quality_report(docs, marks.limit(0)).toPandas()
    assert (none["score"] == 0.5).all()
    assert quality_gam.quality_report(empty, marks).count() == 0


def test_quality_training_brings_one_row_of_an_id(spark, monkeypatch):
    rows = [(i, "word " * (i + 1)) for i in range(1, 30)] + [(7, f"{'a' * (k % 40)} {k}") for k in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    marks = spark.createDataFrame([(i, i % 2, 0) for i in range(1, 30)], "doc_id long, quality int, toxic int")
    sizes, whole, fitted = [], type(docs).toPandas, []

    def counted(self):
        out = whole(self)
        sizes.append(len(out))
        return out

    monkeypatch.setattr(type(docs), "toPandas", counted)
    monkeypatch.setattr(quality_gam, "fit", lambda x, y: fitted.append((x, y)))
    quality_gam.train(docs, marks)
    ids = [i for i in range(1, 30) if zlib.crc32(str(i).encode()) % 5]
    assert 7 in ids and sizes == [len(ids)]
    x, y = fitted[0]
    assert x.shape[0] == len(ids) and list(y) == [i % 2 for i in ids]
    every = quality_gam.features(pa.array([t for i, t in rows if i == 7]))
    assert tuple(x[ids.index(7)]) == min(map(tuple, every))


@needs_model
def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    docs = spark.read.parquet(f"{d}/documents.parquet")
    whole = docs.count()
    sizes = []
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, d)
        if k < len(corpus_pipeline.STAGES) - 1:
            assert out.columns == docs.columns, name
        out.write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        sizes.append(docs.count())
    assert whole >= sizes[0] >= sizes[1] >= sizes[2] and sizes[3] == sizes[4]
    exact = spark.read.parquet(str(tmp_path / "exact"))
    assert exact_dedup.exact_groups(exact).filter("NOT kept").count() == 0
    near = spark.read.parquet(str(tmp_path / "near"))
    assert minhash.near_groups(near, 5).filter("NOT kept").count() == 0
    assert got(corpus_pipeline.run(spark, d).select("doc_id", "ids_crc32")) == got(docs.select("doc_id", "ids_crc32"))
