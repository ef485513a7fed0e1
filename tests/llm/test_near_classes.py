"""Near-dedup where ids repeat or are null: classes are told apart by their texts."""

import random

from gramloom.llm import minhash

WORDS = [f"w{k}" for k in range(60)]
A = " ".join(WORDS)
B = " ".join(f"v{k}" for k in range(60))


def components(spark, rows):
    out = minhash.near_groups(spark.createDataFrame(rows, "doc_id long, text string"), n=2)
    return sorted((tuple(r) for r in out.select("doc_id", "n_shingles", "component_id", "kept").collect()), key=repr)


def test_a_repeated_id_loses_no_link(spark):
    rows = [(3, A), (3, B), (1, A + " z"), (9, B + " z")]
    assert components(spark, rows) == sorted([(3, 59, 1, False), (3, 59, 3, True), (1, 60, 1, True), (9, 60, 3, False)], key=repr)


def test_a_repeated_id_gives_no_link(spark):
    assert components(spark, [(3, A), (3, B), (1, A + " z")]) == sorted([(3, 59, 1, False), (3, 59, 3, True), (1, 60, 1, True)], key=repr)


def test_null_ids(spark):
    rows = [(None, A), (None, A + " z"), (5, B + " z"), (None, B), (None, None)]
    assert components(spark, rows) == sorted([(None, 59, None, True), (None, 60, None, True), (5, 60, 5, True), (None, 59, 5, False), (None, 0, None, True)], key=repr)


def test_one_row_of_a_group_stays(spark):
    rows = [(3, A), (3, A), (3, A + " z"), (4, A), (None, B), (None, B), (7, ""), (7, ""), (8, "one"), (8, "one")]
    docs = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], "doc_id long, text string, `row` string, copies string, th int")
    kept = minhash.drop_near_copies(docs, 2)
    assert kept.columns == docs.columns
    out = kept.collect()
    assert sorted(repr(r["doc_id"]) for r in out) == sorted(["3", "None", "7", "7", "8"])
    assert {r["row"] for r in out} == {"x"} and {r["th"] for r in out} == {1}


def test_a_list_of_unlike_members_is_compared_to_the_end(spark):
    """Texts near 0.8 of one another, of which hubs reach only some."""
    rng = random.Random(8)
    rows = []
    for i in range(60):
        v = list(WORDS) + [f"u{k}" for k in range(60)]
        for k in rng.sample(range(len(v)), 4):
            v[k] = f"x{i}_{k}"
        rows.append((i, " ".join(v)))
    sets = [{tuple(t.split(" ")[k : k + 2]) for k in range(119)} for _, t in rows]
    label = list(range(60))
    for _ in range(60):
        for a in range(60):
            for b in range(60):
                if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                    label[a] = label[b] = min(label[a], label[b])
    want = sorted([(i, len(sets[i]), label[i], label[i] == i) for i in range(60)], key=repr)
    assert components(spark, rows) == want and 1 < len(set(label)) < 60
