"""Rows by place, vectors as tables, masks of blocks, moments in one pass, several vectors: against NumPy."""

from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

import gramloom as g
from gramloom.operators.moments import moments
from gramloom.operators.vectors import TableView, check_column_vector, matvec_table, standardize_table

N, LEVELS = 600, 90


@pytest.fixture(scope="module")
def frame(spark):
    rng = np.random.default_rng(4)
    rows = [(int(i), float(rng.normal()), float(rng.normal() + 5e5), int(rng.integers(LEVELS)) if i % 11 else None, "xyz"[int(rng.integers(3))], float(rng.integers(1, 5))) for i in rng.permutation(N)]
    return spark.createDataFrame(rows, "id long, u double, far double, k int, c string, w double").repartition(5)


@pytest.fixture(scope="module", params=["convert", "drop_first"])
def m(request, frame):
    method = "zero" if request.param == "drop_first" else "convert"
    k = g.single_categorical(frame, "k", cat_missing_method=method, drop_first=request.param == "drop_first")
    c = g.single_categorical(frame, "c")
    return replace(k, blocks=(*g.dense(frame, ["u", "far"]).blocks, *k.blocks, *c.blocks), row_id="id")


def whole(m):
    """The matrix as an array, by row id."""
    out = np.zeros((N, m.n_columns))
    for r in m.to_coo().collect():
        out[r["row_id"], r["j"]] = r["value"]
    return out


def by_id(df, *shape):
    out = np.zeros(shape or (N,))
    for r in df.collect():
        out[tuple(r[:-1])] = r[-1]
    return out


def weights(frame):
    return np.array([r["w"] for r in frame.orderBy("id").collect()])


def jobs(spark, f):
    """How many Spark jobs ``f`` starts."""
    spark.sparkContext.setJobGroup(f"count-{id(f)}", "")
    out = f()
    n = len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"count-{id(f)}"))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    return out, n


# -- rows by place -----------------------------------------------------------------


def test_rows_by_place(m, frame):
    x = whole(m)
    placed = m.numbered(["id"])
    rows, cols = [7, 3, 3, -1, 0, 599], [3, 0, 5, 1]
    got = by_id(replace(placed[rows, cols], row_id="_row").to_coo(), len(rows), len(cols))
    np.testing.assert_array_equal(got, x[np.ix_(rows, cols)])
    many = frame.sparkSession.createDataFrame([(p, (p * 7) % N - (p % 2) * N) for p in range(2 * N)], "place long, row long")
    taken = placed.take(many)
    np.testing.assert_array_equal(by_id(taken.to_coo(), 2 * N, m.n_columns), x[[(p * 7) % N - (p % 2) * N for p in range(2 * N)]])
    np.testing.assert_allclose(by_id(taken.sandwich("w"), m.n_columns, m.n_columns), x[[(p * 7) % N for p in range(2 * N)]].T @ (x * weights(frame)[:, None])[[(p * 7) % N for p in range(2 * N)]])
    assert placed[[], :].df.count() == 0 and placed[np.array([True] + [False] * (N - 1))].df.count() == 1
    for bad in ([N], [-N - 1]):
        with pytest.raises(IndexError):
            placed.take(bad)
    with pytest.raises(IndexError):
        placed.take(many.withColumn("row", F.col("row") + N))
    with pytest.raises(ValueError):
        m.take([0])


def test_numbers_follow_the_order_and_have_no_gaps(frame):
    from gramloom.operators.rows import number_rows

    rows = number_rows(frame, "n", ["c", F.desc("id")]).orderBy("n").select("c", "id", "n").collect()
    assert [r["n"] for r in rows] == list(range(N))
    assert [(r["c"], -r["id"]) for r in rows] == sorted((r["c"], -r["id"]) for r in rows)
    assert number_rows(frame.limit(0), "n").count() == 0
    with pytest.raises(ValueError):
        number_rows(frame, "u")


def test_hstack_by_place(frame):
    other = frame.select((F.col("id") * 3).alias("key"), F.col("u").alias("v")).sort("key")
    a, b = g.dense(frame.sort("id"), ["u"]), g.dense(other, ["v"])
    both = g.hstack([a, b, g.dense(a.df, ["far"])], by_place=True)
    got = by_id(both.to_coo(), N, 3)
    np.testing.assert_array_equal(got[:, 0], got[:, 1])
    with pytest.raises(ValueError):
        g.hstack([a, g.dense(other.limit(5), ["v"])], by_place=True)


def test_row_vectors_from_elsewhere(m, frame):
    spark = frame.sparkSession
    vector = spark.createDataFrame([(i, float(i % 5)) for i in range(N)], "row long, x double")
    d = np.array([i % 5 for i in range(N)], dtype=float)
    x = whole(m)
    np.testing.assert_allclose(by_id(m.with_row_vector(vector, "d").sandwich("d"), m.n_columns, m.n_columns), x.T @ (x * d[:, None]))
    np.testing.assert_allclose(by_id(m.with_row_vector(vector, "d").transpose_matvec("d"), m.n_columns), d @ x)
    for bad in (vector.limit(N - 1), vector.unionAll(spark.createDataFrame([(N, 1.0)], vector.schema)), vector.unionAll(vector.limit(1)), vector.withColumn("row", F.when(F.col("row") > 0, F.col("row")))):
        with pytest.raises(ValueError, match="does not fit"):
            m.with_row_vector(bad, "d")
    with pytest.raises(ValueError):
        m.with_row_vector(vector, "u")


# -- column vectors as tables ----------------------------------------------------------


def test_matvec_with_a_table(m, frame):
    x, p = whole(m), m.n_columns
    v = np.random.default_rng(1).normal(size=p)
    table = frame.sparkSession.createDataFrame([(j, float(v[j])) for j in range(p)], "col int, x double")
    np.testing.assert_allclose(by_id(m.matvec(table)), x @ v)
    some = [0, 4, 5, p - 1, 2 + 88]
    np.testing.assert_allclose(by_id(matvec_table(m, table, some)), x[:, some] @ v[some])
    np.testing.assert_allclose(by_id(m.multiply("w").matvec(table)), (x * weights(frame)[:, None]) @ v)
    for bad in (table.limit(p - 1), table.unionAll(table.limit(1)), table.withColumn("col", F.col("col") + 1)):
        with pytest.raises(ValueError, match="shapes not aligned"):
            check_column_vector(bad, p)


def test_view_of_a_table(m, frame):
    x, w, p = whole(m), weights(frame), m.n_columns
    view, stats = standardize_table(m, "w")
    assert isinstance(view, TableView) and view.unstandardize() is m
    mean = w @ x / w.sum()
    std = np.sqrt(w @ (x - mean) ** 2 / w.sum())
    np.testing.assert_allclose(by_id(stats.select("j", "std"), p), std, rtol=1e-9, atol=1e-12)
    z = (x - mean) / np.where(std < 1e-7, 1, std)
    v = np.random.default_rng(2).normal(size=p)
    table = frame.sparkSession.createDataFrame([(j, float(v[j])) for j in range(p)], "j int, value double")
    np.testing.assert_allclose(by_id(view.matvec(table)), z @ v, atol=1e-8)
    np.testing.assert_allclose(by_id(view.transpose_matvec("u"), p), x[:, 0] @ z, rtol=1e-6, atol=1e-6)
    some = [1, 3, 50, p - 1]
    got = by_id(view.sandwich("w", cols=some), p, p)[np.ix_(some, some)]
    np.testing.assert_allclose(got, (z.T @ (z * w[:, None]))[np.ix_(some, some)], rtol=1e-3, atol=1e-2)
    centred, _ = standardize_table(m, "w", scale=False)
    np.testing.assert_allclose(by_id(centred.transpose_matvec("w"), p), np.zeros(p), atol=1e-3)


# -- moments ---------------------------------------------------------------------------


def test_moments(m, frame):
    w = weights(frame)
    for matrix in (m, m.multiply("u")):
        x = whole(matrix)
        out = {r["j"]: r for r in moments(matrix, "w").collect()}
        mean = w @ x / w.sum()
        assert sorted(out) == list(range(m.n_columns))
        np.testing.assert_allclose([out[j]["mean"] for j in sorted(out)], mean, rtol=1e-9, atol=1e-12)
        np.testing.assert_allclose([out[j]["m2"] / out[j]["weight"] for j in sorted(out)], w @ (x - mean) ** 2 / w.sum(), rtol=1e-7, atol=1e-12)


def test_moments_keep_digits_and_tell_of_nulls(spark):
    rows = [(46.231 + 1.5e-4 * ((i * 37) % 100 / 50 - 1), float(i) if i else None, 1.0) for i in range(100)]
    df = spark.createDataFrame(rows, "x double, y double, w double").repartition(7)
    out = {r["j"]: r["value"] for r in g.dense(df, ["x", "y"]).col_stds("w").collect()}
    np.testing.assert_allclose(out[0], np.std([r[0] for r in rows]), rtol=1e-9)
    assert np.isnan(out[1])
    with pytest.raises(ValueError, match="weights"):
        moments(g.dense(df, ["x"]), F.lit(0.0))
    with pytest.raises(ValueError, match="weights"):
        moments(g.dense(df.limit(0), ["x"]), "w")


def test_moments_of_scaled_levels_are_one_scan(spark, frame):
    scaled = g.single_categorical(frame, "k", cat_missing_method="zero").multiply("u")
    _, n = jobs(spark, lambda: scaled.col_stds("w").collect())
    assert n < 20  # a few passes and stages, where a job for each of the 90 levels ran before


# -- several vectors ---------------------------------------------------------------------


def test_several_vectors(m, frame):
    x, w, p = whole(m), weights(frame), m.n_columns
    ws = [w, w * 2, x[:, 0]]
    for matrix, y in ((m, x), (m.multiply("u"), x * x[:, :1])):
        got = by_id(matrix.transpose_matmul(["w", F.col("w") * 2, "u"]), p, 3)
        np.testing.assert_allclose(got, y.T @ np.array(ws).T, rtol=1e-9, atol=1e-6)
        some = [0, 3, 4, p - 1]
        got = by_id(matrix.transpose_matmul(["w", "u"], rows="id < 300", cols=some, exact=True), p, 2)
        np.testing.assert_allclose(got[some], (y[:300].T @ np.array([w, x[:, 0]]).T[:300])[some], rtol=1e-6, atol=1e-2)
        v = np.random.default_rng(3).normal(size=(p, 4))
        np.testing.assert_allclose(by_id(matrix.matmul(v).select("row_id", "k", "value"), N, 4), y @ v, rtol=1e-9, atol=1e-9)
        np.testing.assert_allclose(by_id(matrix.matmul(v, cols=some).select("row_id", "k", "value"), N, 4), y[:, some] @ v[some], rtol=1e-9, atol=1e-9)
    with pytest.raises(ValueError):
        m.matmul(np.zeros((p + 1, 2)))


def test_eight_vectors_cost_the_passes_of_one(frame):
    keys = g.single_categorical(frame, "k", cat_missing_method="zero")
    scans = lambda df: df._jdf.queryExecution().executedPlan().toString().count("Scan ExistingRDD")
    one = scans(keys.transpose_matvec("w"))
    assert scans(keys.transpose_matmul([F.col("w") * k for k in range(8)])) == one


# -- masks of blocks ---------------------------------------------------------------------


@pytest.mark.parametrize("cols", [[10, 11, 12, 13], [60, 3, 4, 61], list(range(2, 90, 2)) + [1, 1], list(range(89, 1, -1)), [91, 0, 90, 7]])
def test_masks(m, frame, cols):
    x, w = whole(m), weights(frame)
    picked = m.select(cols)
    assert picked.n_columns == len(cols)
    np.testing.assert_array_equal(by_id(picked.to_coo(), N, len(cols)), x[:, cols])
    y = x[:, cols]
    np.testing.assert_allclose(by_id(picked.transpose_matvec("w"), len(cols)), w @ y)
    np.testing.assert_allclose(by_id(picked.sandwich("w"), len(cols), len(cols)), y.T @ (y * w[:, None]), atol=1e-6)
    v = [float(k + 1) for k in range(len(cols))]
    np.testing.assert_allclose(by_id(picked.matvec(v)), y @ v)
    np.testing.assert_allclose(by_id(moments(picked, "w").select("j", "mean"), len(cols)), w @ y / w.sum(), atol=1e-12)
    names = m.get_names()
    assert picked.get_names() == [names[c] for c in cols]


def test_masks_start_no_job(spark, frame):
    m = g.single_categorical(frame, "k", cat_missing_method="zero")
    picked, n = jobs(spark, lambda: (m.select([7, 8, 9, 30, 2]), m.getcol(5), m.select(range(0, 88, 2))))
    assert n == 0
    assert picked[0].n_columns == 5 and picked[1].get_names() == [m.get_names()[5]]
    kept = {r["value"] for r in picked[0].recover_orig().collect()}
    assert kept == {None, *[int(x[2:-1]) for x in picked[0].get_names()]}


def test_split_column_subsets(m):
    """Each column of a selection is found again in one of its blocks."""
    cols = [1, 0, *range(40, 50), *range(20, 30), m.n_columns - 2, m.n_columns - 1]
    picked = m.select(cols)
    assert [b.width for b in picked.blocks] == [1, 1, 20, 2]


# -- packed columns, places of columns, pandas ------------------------------------------------


def test_packed(spark):
    from gramloom.sources import packed

    x = np.random.default_rng(5).normal(size=(80, 20))
    df = spark.createDataFrame([(i, [float(v) for v in r], float(i % 3)) for i, r in enumerate(x)], "id long, v array<double>, w double").repartition(3)
    w = np.arange(80) % 3.0
    m = packed(df, "v", row_id="id")
    assert m.get_names()[:2] == ["v[0]", "v[1]"] and m.n_columns == 20
    np.testing.assert_allclose(by_id(m.sandwich("w"), 20, 20), x.T @ (x * w[:, None]), atol=1e-9)
    np.testing.assert_allclose(by_id(m.select(range(15)).sandwich("w"), 15, 15), x[:, :15].T @ (x[:, :15] * w[:, None]), atol=1e-9)
    back = list(range(19, 3, -1))
    np.testing.assert_allclose(by_id(m.select(back).sandwich("w"), 16, 16), x[:, back].T @ (x[:, back] * w[:, None]), atol=1e-9)
    np.testing.assert_allclose(by_id(m.multiply("w").sandwich("w"), 20, 20), x.T @ (x * w[:, None] ** 3), atol=1e-9)
    np.testing.assert_allclose(by_id(m.standardize("w")[0].materialize().sandwich("w"), 20, 20).diagonal(), np.full(20, w.sum()), rtol=1e-6)
    for bad in ([1.0], None, [None] * 20):
        with pytest.raises(ValueError):
            packed(df.unionByName(spark.createDataFrame([(99, bad, 1.0)], df.schema)), "v")
    with pytest.raises(ValueError):
        packed(df, "v", names=["a"])
    assert packed(df.limit(0), "v").n_columns == 0


def test_arranged(m, frame):
    x, p = whole(m), m.n_columns
    extra = g.dense(m.df, ["w"], "id")
    places = [*range(1, p), p] if p % 2 else [p, *range(1, p)]
    both = g.arranged([m, extra], [places, [0]])
    want = np.zeros((N, p + 1))
    want[:, places], want[:, 0] = x, weights(frame)
    np.testing.assert_array_equal(by_id(both.to_coo(), N, p + 1), want)
    for bad in ([places], [places, [1]], [places[1:], [0]], [places, [p + 5]]):
        with pytest.raises(ValueError):
            g.arranged([m, extra], bad)


def test_from_pandas(spark):
    import pandas as pd

    pdf = pd.DataFrame({"x": [1.0, 2.0, 4.0], "c": pd.Categorical(["b", "a", "b"], categories=["z", "b", "a"]), "n": [1, 0, 0]})
    with pytest.warns(DeprecationWarning):
        m = g.from_pandas(spark, pdf, cat_threshold=1)
    assert m.get_names() == ["x", "c[z]", "c[b]", "c[a]", "n"]
    assert sorted(map(tuple, m.to_wide().collect())) == [(1.0, 0.0, 1.0, 0.0, 1.0), (2.0, 0.0, 0.0, 1.0, 0.0), (4.0, 0.0, 1.0, 0.0, 0.0)]
