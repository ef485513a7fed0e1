"""The quality classifier against brute force: features, bins and tables, splits, long texts, held-out accuracy."""

import bisect
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from gramloom.llm import quality_gam

SPACE = " \t\n\x0b\x0c\r"
rng = random.Random(6)
WORDS = ["a", "the", "The", "wörd", "漢字", "x1", "#", "12", "end.", "(so)", "wow!!", "it's"]
TEXTS = [" ".join(rng.choice(WORDS) for _ in range(rng.randint(1, 60))) for _ in range(40)]
TEXTS += ["", None, " \n\t ", "one", "one one one", "a\nb\na\n\nb", "a\x0bb\x85c d", "line\n" * 9, "UPPER CASE 123 $%&", " ".join(f"w{k % 97}" for k in range(30_000))]


def brute(text):
    t = text or ""
    words = [w for w in re.split("[" + SPACE + "]+", t) if w]
    low = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words]
    raw, n1 = t.encode(), max(1, len(words))
    size = max(1, len(raw))
    count = lambda chars: sum(raw.count(c.encode()) for c in chars)
    pairs = list(zip(low, low[1:]))
    lines = [x for x in t.split("\n") if x.strip()]
    return [
        math.log1p(len(words)),
        sum(len(w.encode()) for w in words) / n1,
        count("ABCDEFGHIJKLMNOPQRSTUVWXYZ") / size,
        count("0123456789") / size,
        count("#*$%&|<>") / n1,
        count("!") / n1,
        count(".,;:?") / n1,
        count("'\"()[]{}/\\-_=+~^@`") / n1,
        sum(b >= 128 for b in raw) / size,
        len(set(low)) / len(low) if low else 0,
        sum(a == b for a, b in pairs) / n1,
        1 - len(set(pairs)) / len(pairs) if pairs else 0,
        max(Counter(low).values()) / len(low) if low else 0,
        1 - len(set(lines)) / len(lines) if lines else 0,
        len(words) / (t.count("\n") + 1),
        sum(len(w.encode()) == 1 for w in words) / n1,
    ]


def test_features():
    got = quality_gam.features(pa.array(TEXTS, pa.string()))
    for row, t in zip(got, TEXTS):
        np.testing.assert_allclose(row, brute(t), atol=1e-12, err_msg=repr(t)[:80])
    half = quality_gam.features(pa.array(TEXTS, pa.string()).slice(11, 13))
    np.testing.assert_array_equal(half, got[11:24])


@pytest.fixture(scope="module")
def fitted():
    r = np.random.default_rng(3)
    x = r.normal(size=(1500, 4))
    y = (x[:, 1] * x[:, 2] + 0.1 * x[:, 0] > 0).astype(float)
    return quality_gam.fit(x, y, rounds=30, n_pairs=3, pair_rounds=30), x, y


def test_scores_are_sums_of_table_entries(fitted):
    model, x, y = fitted
    want = []
    for row in x:
        b = [bisect.bisect_right(list(c), v) for c, v in zip(model.cuts, row)]
        z = model.intercept + sum(t[k] for t, k in zip(model.tables, b)) + sum(t[b[i], b[j]] for (i, j), t in zip(model.pairs, model.pair_tables))
        want.append(1 / (1 + math.exp(-z)))
    np.testing.assert_allclose(model.score(x), want, rtol=1e-12)
    assert (2, 1) in model.pairs  # the interaction is found
    assert np.mean((model.score(x) > 0.5) == y) > 0.85
    again = quality_gam.fit(x, y, rounds=30, n_pairs=3, pair_rounds=30)
    np.testing.assert_array_equal(again.score(x), model.score(x))


def test_first_split_is_the_best_of_all():
    r = np.random.default_rng(4)
    for _ in range(30):
        g, h = r.normal(size=9), r.random(9) + 0.1
        gain = lambda a, b: g[a:b].sum() ** 2 / (h[a:b].sum() + quality_gam._SMOOTH)
        cut = max(range(1, 9), key=lambda c: gain(0, c) + gain(c, 9))
        out = quality_gam._tree(g, h, 2)
        if gain(0, cut) + gain(cut, 9) - gain(0, 9) > 1e-9:
            assert len(set(out[:cut])) == len(set(out[cut:])) == 1 and out[0] != out[-1]
            np.testing.assert_allclose(out[0], g[:cut].sum() / (h[:cut].sum() + quality_gam._SMOOTH))
        leaves = quality_gam._tree(g, h, 4)
        assert 1 <= len(set(leaves)) <= 4


def test_report_is_the_model_on_whole_texts(spark):
    rows = [(k, t) for k, t in enumerate(TEXTS * 3)] + [(None, TEXTS[0]), (5, TEXTS[5])]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    marks = [(k, int((t or "").count("!") < 8)) for k, t in rows if k is not None and k % 2]
    labels = spark.createDataFrame(marks, "doc_id long, quality int")
    model = quality_gam.train(docs, labels)
    learnt = {k for k, _ in marks if zlib.crc32(str(k).encode()) % 5}
    x = np.array([brute(dict(rows)[k]) for k in sorted(learnt)])
    own = quality_gam.fit(x, np.array([dict(marks)[k] for k in sorted(learnt)], dtype=float))
    got = {(r["doc_id"], r["score"]): r for r in quality_gam.quality_report(docs, labels).collect()}
    want = own.score(np.array([brute(t) for _, t in rows]))
    by_row = {}
    for (k, t), s in zip(rows, want):
        by_row[k] = s
    for (k, s), r in got.items():
        np.testing.assert_allclose(s, by_row[k], rtol=1e-9)
        assert r["held_out"] == (zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 0) and r["predicted"] == int(s >= 0.3)
    np.testing.assert_allclose(model.score(x), own.score(x), rtol=1e-9)
