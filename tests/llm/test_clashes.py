"""Columns of any name, repeated and null ids, in every operator that returns its input's columns."""

import pytest
from test_llm import MODEL, ROWS, got, needs_model, words

from gramloom.llm import exact_dedup, line_dedup, minhash, mixing, quality_gam, sentencepiece_codec, sharding

NAMES = "size slot most target below source_size n_lines quality_score _id _n shard text_crc32 row copies copy kept kept_text h sha best priority perhaps u t skey whole bucket hash place first key cid th group worded id no_id score ids decoded block".split()


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(i, t, s, *[f"{c}{k}" for c in NAMES]) for k, (i, t, _, s, *_) in enumerate(ROWS)]
    rows += [(None, t, s, *["x"] * len(NAMES)) for _, t, _, s, *_ in ROWS[:6]] * 2
    return spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in NAMES)).repartition(3)


def own(rows, columns):
    """Rows come whole: what stands beside a text is what stood beside it."""
    return sorted((tuple(r[c] for c in columns) for r in rows), key=repr)


def test_stages_return_rows_as_they_are(spark, odd):
    every = set(own(odd.collect(), odd.columns))
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    for out in (exact_dedup.drop_exact_copies(odd), minhash.drop_near_copies(odd), mixing.mixed_rows(odd), quality_gam.keep_good(odd, labels)):
        assert out.columns == odd.columns
        assert set(own(out.collect(), odd.columns)) <= every


def test_added_columns_replace_those_of_their_name(odd):
    every = odd.collect()
    for out, added in ((sharding.shuffle_into_shards(odd), {"size", "text_crc32", "shard", "slot"}), (line_dedup.drop_common_lines(odd), {"kept_text", "n_lines", "n_dropped"})):
        assert len(set(out.columns)) == len(out.columns) and added <= set(out.columns)
        rest = [c for c in odd.columns if c not in added]
        assert own(out.collect(), rest) == own(every, rest)


@needs_model
def test_codec_columns(odd):
    out = sentencepiece_codec.decode(sentencepiece_codec.encode(odd, MODEL), MODEL)
    assert len(set(out.columns)) == len(out.columns)
    rest = [c for c in odd.columns if c not in ("ids", "decoded")]
    assert own(out.collect(), rest) == own(odd.collect(), rest)


def test_null_and_repeated_ids_come_near_their_targets(spark):
    rows = [(None, " ".join(f"w{k}_{j}" for j in range(20 + k % 7)), f"s{k % 3}") for k in range(600)] + [(7, f"a b c {k}", "s0") for k in range(50)]
    out = mixing.mix(spark.createDataFrame(rows, "doc_id long, text string, source string")).toPandas()
    for _, part in out.groupby("source"):
        assert abs(part["taken"].sum() - part["target"].iloc[0]) <= 30
    assert len(out) == len(rows) and out["size"].sum() == sum(len(words(t)) for _, t, _ in rows)


def test_equal_rows_are_spread_over_buckets(spark):
    docs = spark.createDataFrame([(None, "same text")] * 3000, "doc_id long, text string").repartition(3)
    out = sharding.shard_report(docs, bucket_bytes=3000 * 25 // 8).toPandas()
    n = out.groupby("shard").size()
    assert len(out) == 3000 and n.max() - n.min() <= 1
    assert all(sorted(p["slot"]) == list(range(len(p))) for _, p in out.groupby("shard"))
    assert got(sharding.shard_report(docs)) == got(sharding.shard_report(docs))
