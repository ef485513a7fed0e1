"""The pipeline's result against brute force on a small table with nulls, copies and near copies."""

import os
from collections import Counter, defaultdict

import duckdb
import pandas as pd
import pyarrow as pa
import pytest
from test_llm import MODEL, ROWS, SCHEMA, SPACE, needs_model, words

from gramloom.llm import quality_gam
from gramloom.llm.oracle import mixing_sql


def without_copies(rows):
    best = {}
    for r in rows:
        norm = (r[1] or "").translate({ord(c): None for c in SPACE})
        rank = (-len(r[1] or ""), r[0] is None, r[0] or 0)
        if norm not in best or rank < best[norm][0]:
            best[norm] = (rank, r)
    return [r for _, r in best.values()]


def without_near_copies(rows):
    sets = []
    for r in rows:
        w = (r[1] or "").encode().lower().split()
        sets.append({tuple(w[k : k + 5]) for k in range(len(w) - 4)} or ({tuple(w)} if w else set()))
    label = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                old, new = label[a], label[b]
                label = [new if x == old else x for x in label]
    groups = defaultdict(list)
    for k, r in enumerate(rows):
        groups[label[k]].append(r)
    return [min(g, key=lambda r: (r[0] is None, r[0] or 0)) for g in groups.values()]


@needs_model
def test_against_brute_force(spark, tmp_path):
    import corpus_pipeline
    import sentencepiece

    unique = [r for k, r in enumerate(ROWS) if r[0] is None or r[0] not in {x[0] for x in ROWS[:k]}]
    labels = [(r[0], int(len(words(r[1])) > 20)) for r in unique if r[0] is not None and r[0] % 2]
    spark.createDataFrame(unique, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    model = quality_gam.train(spark.read.parquet(str(tmp_path / "documents.parquet")), spark.read.parquet(str(tmp_path / "labels.parquet")))
    rows = [r for r in unique if model.score(quality_gam.features(pa.array([r[1] or ""])))[0] >= 0.3]
    assert 0 < len(rows) < len(unique)
    rows = without_near_copies(without_copies(rows))
    documents = pd.DataFrame([r[:4] for r in rows], columns=["doc_id", "text", "lang", "source"]).astype({"doc_id": "Int64"})  # noqa: F841
    copies = duckdb.sql(f"WITH {mixing_sql('documents')} SELECT doc_id, copies FROM mixed").fetchall()
    taken = {i: c for i, c in copies}
    assert len(taken) == len(rows)
    sp = sentencepiece.SentencePieceProcessor(model_file=MODEL)
    want = Counter()
    for r in rows:
        want[r[0], r[3], tuple(sp.encode(r[1] or ""))] += taken[r[0]]
    got = Counter((r["doc_id"], r["source"], tuple(r["ids"])) for r in corpus_pipeline.run(spark, str(tmp_path)).collect())
    assert got == +want


@needs_model
def test_empty_tables(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame([], SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([], "doc_id long, quality int").write.parquet(str(tmp_path / "labels.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test tables")
def test_near_query_against_brute_force_on_the_smallest_table(spark):
    from gramloom.llm import queries

    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()
    sets = []
    for _, t in docs:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[k : k + 2]) for k in range(len(w) - 1)} or ({tuple(w)} if w else set()))
    label = {r["doc_id"]: r["doc_id"] for r in docs}
    for a in range(len(docs)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                x, y = label[docs[a][0]], label[docs[b][0]]
                if x != y:
                    label = {k: min(x, y) if v in (x, y) else v for k, v in label.items()}
    out = queries.op3_minhash(spark, "/root/testdata/sf0.001").collect()
    assert {r["doc_id"]: r["component_id"] for r in out} == label
    assert {r["doc_id"]: r["n_shingles"] for r in out} == {r["doc_id"]: len(s) for r, s in zip(docs, sets)}
