"""Interactions of observed combinations, and sparse matrices in tiles, against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gramloom as g
from gramloom.operators import tiles
from gramloom.operators.pairs import interaction, product_numbers, with_interaction
from gramloom.operators.tiles import TiledMatrix

N = 400


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(8)
    rows = [(i, int(rng.integers(80)) if i % 9 else None, "k%03d" % rng.integers(70), "xy"[i % 2], float(rng.normal()), float(rng.integers(1, 4))) for i in range(N)]
    return spark.createDataFrame(rows, "id long, a int, b string, c string, u double, w double").repartition(3)


def array(m, rows=N, key="id"):
    out = np.zeros((rows, m.n_columns))
    for r in m.to_coo().collect():
        out[r["row_id"], r["j"]] = r["value"]
    return out


def filled(df, *shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[:-1])] = r[-1]
    return out


def local(frame):
    return frame.orderBy("id").toPandas()


@pytest.mark.parametrize("reduced", [(), ("a",), ("b", "c"), ("a", "b", "c")])
def test_interaction(frame, reduced):
    p = local(frame)
    first = {"a": p["a"].min(), "b": p["b"].min(), "c": p["c"].min()}
    of = [None if any(x != x or x is None for x in t) or any(dict(zip("abc", t))[c] == first[c] for c in reduced) else t for t in zip(p["a"], p["b"], p["c"])]
    seen = sorted({t for t in of if t is not None})
    x = np.array([[t == s for s in seen] for t in of], dtype=float)
    m = interaction(frame, ["a", "b", "c"], reduced, row_id="id")
    assert m.n_columns == len(seen)
    assert m.get_names() == [f"a[{int(a)}]:b[{b}]:c[{c}]" for a, b, c in seen] and m.get_names()[3] == m.blocks[0].levels[3]
    w = p["w"].to_numpy()
    np.testing.assert_array_equal(array(m), x)
    np.testing.assert_allclose(filled(m.transpose_matvec("w"), len(seen)), w @ x)
    both = with_interaction(g.dense(frame, ["u"], "id"), ["a", "b", "c"], reduced=reduced)
    y = np.column_stack([p["u"], x])
    np.testing.assert_allclose(filled(both.sandwich("w"), *[len(seen) + 1] * 2), y.T @ (y * w[:, None]), atol=1e-9)
    some = [len(seen) - 1, 0, 5]
    np.testing.assert_array_equal(array(m.select(some)), x[:, some])
    assert m.select(some).get_names() == [m.get_names()[k] for k in some]


def test_numbers_of_the_full_product(frame):
    m = interaction(frame, ["a", "b"], row_id="id")
    a, b = (g.single_categorical(frame, c, cat_missing_method="zero").blocks[0].levels for c in "ab")
    full = {r["j"]: r["full"] for r in product_numbers(m, [a, b]).collect()}
    la, lb = list(a), list(b)
    assert full == {k: la.index(r["a"]) + len(la) * lb.index(r["b"]) for k, r in enumerate(x["level"] for x in m.blocks[0].levels.df.orderBy("code").collect())}
    assert {r["j"]: r["full"] for r in product_numbers(m, [la, b]).collect()} == full  # a list will do
    with pytest.raises(ValueError):
        product_numbers(m, [a])
    with pytest.raises(ValueError):
        interaction(frame, ["a"])
    with pytest.raises(ValueError):
        interaction(frame, ["a", "b"], reduced=["c"])
    assert interaction(frame.limit(0), ["a", "b"]).n_columns == 0


@pytest.mark.parametrize(("text", "full_rank"), [("u + C(a, missing_method='zero'):b", False), ("a1 * b", True), ("b:c:u", False), ("poly(u, degree=2, raw=True):b:c", False)])
def test_formula_with_observed_interactions(spark, frame, tmp_path, text, full_rank):
    df = frame.withColumn("a1", F.coalesce(F.format_string("a%02d", "a"), F.lit("none")))
    every = g.from_formula(text, df, ensure_full_rank=full_rank, row_id="id")
    some = g.from_formula(text, df, ensure_full_rank=full_rank, row_id="id", interactions="observed")
    x, y = array(every), array(some)
    names = every.get_names()
    at = [names.index(n) for n in some.get_names()] if "poly" not in text and "u" not in text.split(":")[-1] else [k for k in range(x.shape[1]) if x[:, k].any()]
    np.testing.assert_allclose(y, x[:, at]) if "poly" not in text else np.testing.assert_allclose(np.sort(np.abs(y).sum(0)), np.sort(np.abs(x[:, at]).sum(0)))
    assert not x[:, sorted(set(range(x.shape[1])) - set(at))].any()
    w = local(frame)["w"].to_numpy()
    np.testing.assert_allclose(filled(some.transpose_matvec("w"), some.n_columns), w @ y, atol=1e-9)
    again = g.Spec.from_json(spark, some.spec.to_json("file://" + str(tmp_path))).get_model_matrix(df, row_id="id")
    np.testing.assert_allclose(array(again), y)


def test_too_wide_products_are_refused(spark):
    df = spark.range(100).select(F.format_string("%06d", "id").alias("a"), F.lit(1.0).alias("w"))
    with pytest.raises(OverflowError, match="observed"):
        g.from_formula("a:b:c:d:e", df.select("a", *[F.col("a").alias(x) for x in "bcde"]))


# -- tiles ------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def sparse(spark):
    rng = np.random.default_rng(9)
    x = np.where(rng.random((150, 60)) < 0.08, rng.normal(size=(150, 60)), 0.0)
    x[7] = rng.normal(size=60)  # a long row
    x[:, 11] = rng.normal(size=150)
    x[20:40] = 0
    rows = [(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))] + [(0, 59, 0.0)] * int(x[0, 59] == 0)
    return x, spark.createDataFrame(rows, "i long, j int, value double").repartition(3)


@pytest.mark.parametrize(("row_block", "col_block"), [(None, None), (16, 7), (1, 60), (150, 1), (7, 100)])
def test_tiles(spark, sparse, row_block, col_block):
    x, df = sparse
    m = TiledMatrix.from_coo(df, 150, 60, row_block, col_block)
    d = np.arange(150) % 4 - 1.0
    dv = spark.createDataFrame([(i, float(v)) for i, v in enumerate(d) if i % 10], "i long, x double")  # rows without a weight go
    d[::10] = 0
    np.testing.assert_allclose(filled(m.sandwich(dv), 60, 60), x.T @ (x * d[:, None]), atol=1e-12)
    rows, cols = [3, 7, 7, 99], [0, 11, 12, 59]
    rt, ct = spark.createDataFrame([(r,) for r in rows], "r long"), spark.createDataFrame([(c,) for c in cols], "c long")
    keep = np.zeros_like(x)
    keep[np.ix_(sorted(set(rows)), cols)] = x[np.ix_(sorted(set(rows)), cols)]
    np.testing.assert_allclose(filled(m.sandwich(dv, rt, ct), 60, 60), keep.T @ (keep * d[:, None]), atol=1e-12)
    v = np.linspace(-1, 1, 60)
    vv = spark.createDataFrame([(j, float(z)) for j, z in enumerate(v)], "j int, x double")
    np.testing.assert_allclose(filled(m.matvec(vv), 150), x @ v, atol=1e-12)
    np.testing.assert_allclose(filled(m.matvec(vv, rt, ct), 150), keep @ v, atol=1e-12)
    np.testing.assert_allclose(filled(m.transpose_matvec(dv), 60), d @ x, atol=1e-12)
    np.testing.assert_allclose(filled(m.transpose().dot(m), 60, 60), x.T @ x, atol=1e-12)
    other = TiledMatrix.from_coo(df, 150, 60, 33, 9).transpose()
    np.testing.assert_allclose(filled(m.dot(other), 150, 150), x @ x.T, atol=1e-12)
    np.testing.assert_allclose(filled(m.getcol(-49).entries(), 150, 1)[:, 0], x[:, 11])
    assert m.entries().count() == np.count_nonzero(x)


def test_wide_vectors_are_joined_by_entry(spark, sparse, monkeypatch):
    x, df = sparse
    monkeypatch.setattr(tiles, "WIDE", 10)
    m = TiledMatrix.from_coo(df, 150, 60)
    vv = spark.createDataFrame([(j, float(j)) for j in range(60)], "j int, x double")
    np.testing.assert_allclose(filled(m.matvec(vv), 150), x @ np.arange(60.0), atol=1e-9)


def test_products_are_made_in_parts(monkeypatch, spark, sparse):
    x, df = sparse
    monkeypatch.setattr(tiles, "PRODUCTS_AT_ONCE", 100)
    sums = tiles._Sums()
    i, j = np.nonzero(x)
    for a, b, v in tiles._products(i, j, x[i, j], i, j, x[i, j]):
        sums.add(a, b, v)
    sums.reduce()
    got = np.zeros((60, 60))
    got[sums.parts[0][0], sums.parts[0][1]] = sums.parts[0][2]
    np.testing.assert_allclose(got, x.T @ x, atol=1e-12)


def test_tiles_check_their_input(spark, sparse):
    _, df = sparse
    for bad in (df.limit(1).withColumn("i", F.lit(150)), df.limit(1).withColumn("j", F.lit(-1)), df.limit(1).withColumn("i", F.lit(None))):
        with pytest.raises(IndexError):
            TiledMatrix.from_coo(df.unionByName(bad), 150, 60)
    m = TiledMatrix.from_coo(df, 150, 60, column_names=[f"c{k}" for k in range(60)])
    assert m.getcol(3).column_names == ("c3",) and m.shape == (150, 60)
    with pytest.raises(ValueError):
        TiledMatrix.from_coo(df, 150, 60, column_names=["a"])
    with pytest.raises(ValueError):
        m.dot(m)
    with pytest.raises(IndexError):
        m.getcol(60)
    none = TiledMatrix.from_coo(df.limit(0), 5, 4)
    assert none.sandwich(df.select("i", "value")).count() == 0 and none.matvec(df.select("j", "value")).count() == 0


def test_triplets(spark, sparse):
    x, df = sparse
    names = [f"c{k}" for k in range(60)]
    m = g.from_csc(df, 150, 60, column_names=names)
    np.testing.assert_allclose(array(m, 150), x)
    assert m.get_names() == names and {b.kind for b in m.blocks} == {"dense", "sparse"}
    w = np.arange(150) % 5.0
    np.testing.assert_allclose(filled(m.sandwich(F.col("row") % 5), 60, 60), x.T @ (x * w[:, None]), atol=1e-9)
    np.testing.assert_allclose(filled(m.transpose_matvec((F.col("row") % 5).cast("double")), 60), w @ x, atol=1e-9)
    twice = g.from_csc(df.unionAll(df), 150, 60)
    np.testing.assert_allclose(array(twice, 150), 2 * x)
    with pytest.raises(ValueError, match="from_coo"):
        g.from_csc(df, 150, 20_000)
    coo = g.from_coo(df, 150, 60, names)
    rows, cols = spark.createDataFrame([(7,), (3,), (3,)], "r int"), spark.createDataFrame([(11,), (0,)], "c long")
    some = filled(coo.restricted(rows, cols).df, 150, 60)
    keep = np.zeros_like(x)
    keep[np.ix_([3, 7], [0, 11])] = x[np.ix_([3, 7], [0, 11])]
    np.testing.assert_allclose(some, keep)
    np.testing.assert_allclose(filled(coo.tiled(10, 10).transpose_matvec(spark.range(150).select("id", F.lit(1.0))), 60), x.sum(0), atol=1e-9)
    with pytest.raises(ValueError):
        g.from_coo(df, 150, 60, ["a"])


def test_many_column_blocks_meet_once(spark, sparse, monkeypatch):
    """However columns are cut, the entries of a block of rows are sent once; only blocks of more than a piece have partners."""
    x, df = sparse
    d = spark.range(150).select("id", F.lit(2.0).alias("x"))
    sent = []
    plain = tiles._products_of
    monkeypatch.setattr(tiles, "_products_of", lambda *a: sent.append(a[3]) or plain(*a))
    m = TiledMatrix.from_coo(df, 150, 60, 50, 1)
    np.testing.assert_allclose(filled(m.sandwich(d), 60, 60), 2 * x.T @ x, atol=1e-12)
    assert not sent
    monkeypatch.setattr(tiles, "PIECE", 40)
    for m in (TiledMatrix.from_coo(df, 150, 60, 50, 1), TiledMatrix.from_coo(df, 150, 60, 150, 60)):
        np.testing.assert_allclose(filled(m.sandwich(d), 60, 60), 2 * x.T @ x, atol=1e-12)
        np.testing.assert_allclose(filled(m.transpose().dot(m), 60, 60), x.T @ x, atol=1e-12)
    assert sent
