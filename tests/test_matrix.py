"""Reductions against dense NumPy on the same wide values."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gramloom as g


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(0)
    n = 40
    rows = [(i, float(rng.normal()), float(rng.normal() * (rng.random() < 0.1)), str(rng.choice(list("abc"))), rng.choice(["x", "y", None]), float(rng.random())) for i in range(n)]
    return spark.createDataFrame([(r[0], r[1], r[2], r[3], None if r[4] is None else str(r[4]), r[5]) for r in rows], "id long, u double, s double, c string, m string, w double")


def matrix(data, drop_first=False, method="zero"):
    return g.from_df(data.drop("w"), object_as_cat=True, cat_threshold=1, drop_first=drop_first, cat_missing_method=method, row_id="id")


def wide(m):
    return m.to_wide().toPandas().sort_values("id").drop(columns="id").to_numpy()


def weights(data):
    return data.toPandas().sort_values("id")["w"].to_numpy()


@pytest.fixture(scope="module", params=[(False, "zero"), (True, "zero"), (False, "convert"), (True, "convert")])
def case(request, data):
    drop, method = request.param
    m = matrix(data, drop, method)
    full = g.DesignMatrix(m.df, m.blocks, "id")
    return full, wide(full), weights(data)


def with_w(m, data):
    return g.DesignMatrix(m.df.join(data.select(F.col("id").alias("i2"), "w"), F.col("id") == F.col("i2")), m.blocks, "id")


def test_matvec(case):
    m, x, _ = case
    v = np.arange(1.0, m.n_columns + 1)
    got = m.matvec(v).toPandas().sort_values("row_id")["value"].to_numpy()
    np.testing.assert_allclose(got, x @ v)
    cols = [m.n_columns - 1, 0]
    got = m.matvec(v, cols).toPandas().sort_values("row_id")["value"].to_numpy()
    np.testing.assert_allclose(got, x[:, cols] @ v[cols])
    with pytest.raises(ValueError):
        m.matvec([1.0])


def test_transpose_matvec_and_sandwich(case, data):
    m, x, w = case
    m, p = with_w(m, data), x.shape[1]
    np.testing.assert_allclose(g.to_numpy(m.transpose_matvec("w"), p), x.T @ w)
    np.testing.assert_allclose(g.to_numpy(m.sandwich("w"), p, p), x.T @ (x * w[:, None]), atol=1e-12)
    rows, cols = [1, 5, 7, 5], [0, p - 1]
    keep = np.array([1, 5, 7])
    full = np.zeros((p, p))
    full[np.ix_(cols, cols)] = x[np.ix_(keep, cols)].T @ (x[np.ix_(keep, cols)] * w[keep, None])
    np.testing.assert_allclose(g.to_numpy(m.sandwich("w", rows, cols), p, p), full, atol=1e-12)
    assert m.transpose_matvec("w", rows=[]).filter("value <> 0").count() == 0
    assert m.sandwich("w", cols=[]).count() == 0


def test_cross_multiply_and_columns(case, data):
    m, x, w = case
    m, p = with_w(m, data), x.shape[1]
    left, right = [0, 1], list(range(2, p))
    got = g.to_numpy(m.cross_sandwich("w", left, right), p, p)[np.ix_(left, right)]
    np.testing.assert_allclose(got, x[:, left].T @ (x[:, right] * w[:, None]), atol=1e-12)
    scaled = m.multiply("w")
    np.testing.assert_allclose(wide(scaled), x * w[:, None])
    np.testing.assert_allclose(g.to_numpy(scaled.sandwich(F.lit(1.0)), p, p), (x * w[:, None]).T @ (x * w[:, None]), atol=1e-12)
    np.testing.assert_allclose(wide(m.getcol(-1))[:, 0], x[:, -1])
    np.testing.assert_allclose(wide(m[[3, 4], [p - 1, 0]]), x[np.ix_([3, 4], [p - 1, 0])])
    with pytest.raises(IndexError):
        m.getcol(p)


def test_standardize(case, data):
    m, x, w = case
    m, p = with_w(m, data), x.shape[1]
    view, means, stds = m.standardize("w")
    mu = x.T @ w / w.sum()
    sd = np.sqrt((w[:, None] * (x - mu) ** 2).sum(axis=0) / w.sum())
    np.testing.assert_allclose(means, mu, atol=1e-12)
    np.testing.assert_allclose(stds, sd, atol=1e-9)
    z = (x - mu) / np.where(sd < 1e-7, 1, sd)
    v = np.arange(1.0, p + 1)
    np.testing.assert_allclose(view.matvec(v).toPandas().sort_values("row_id")["value"], z @ v, atol=1e-9)
    np.testing.assert_allclose(g.to_numpy(view.transpose_matvec("w"), p), z.T @ w, atol=1e-9)
    np.testing.assert_allclose(g.to_numpy(view.sandwich("w"), p, p), z.T @ (z * w[:, None]), atol=1e-9)
    np.testing.assert_allclose(wide(view.materialize()), z, atol=1e-9)
    np.testing.assert_allclose(wide(view[[1, 2], [p - 1]].materialize()), z[np.ix_([1, 2], [p - 1])], atol=1e-9)


def test_std_is_stable_and_guards_constants(spark):
    df = spark.createDataFrame([(46.231 + 1.5e-4 * k, 1.0) for k in (-1, 0, 1)], "x double, one double")
    _, _, stds = g.dense(df, ["x", "one"]).standardize(F.lit(1.0))
    np.testing.assert_allclose(stds[0], 1.5e-4 * np.sqrt(2 / 3), rtol=1e-6)
    view, _, _ = g.dense(df, ["one"]).standardize(F.lit(1.0))
    assert view.mult[0] == 1.0


def test_wide_gram_matches_numpy(spark):
    x = np.random.default_rng(1).normal(size=(50, 20))
    df = spark.createDataFrame([tuple(map(float, r)) for r in x], ", ".join(f"x{k} double" for k in range(20)))
    m = g.dense(df, df.columns)
    np.testing.assert_allclose(g.to_numpy(m.sandwich(F.lit(2.0)), 20, 20), 2 * x.T @ x, atol=1e-9)


def test_many_levels_use_joins(spark):
    df = spark.range(500).select((F.col("id") % 200).alias("k"), F.lit(1.0).alias("w"), "id")
    m = g.single_categorical(df, "k", row_id="id")
    assert m.n_columns == 200
    v = np.arange(200.0)
    got = m.matvec(v).toPandas().set_index("row_id")["value"]
    assert all(got[i] == i % 200 for i in range(500))
    assert g.to_numpy(m.transpose_matvec("w"), 200).sum() == 500


def test_missing_methods(spark):
    df = spark.createDataFrame([(1.0,), (2.0,), (None,), (float("nan"),), (float("inf"),)], "x double")
    with pytest.raises(ValueError):
        g.single_categorical(df, "x")
    assert g.single_categorical(df, "x", cat_missing_method="zero").n_columns == 3
    m = g.single_categorical(df, "x", cat_missing_method="convert")
    assert m.get_names()[-1] == "x[(MISSING)]" and m.n_columns == 4
    clash = spark.createDataFrame([(None,), ("(MISSING)",)], "x string")
    with pytest.raises(ValueError):
        g.single_categorical(clash, "x", cat_missing_method="convert")
    with pytest.raises(ValueError):
        g.single_categorical(clash, "x", cat_missing_method="other")
    declared = g.single_categorical(spark.createDataFrame([("b",)], "x string"), "x", levels=["c", "b"])
    assert declared.get_names() == ["x[c]", "x[b]"]
    with pytest.raises(ValueError):
        g.single_categorical(spark.createDataFrame([("z",)], "x string"), "x", levels=["c"])


def test_from_df_routing(spark):
    rows = [(float(-10 + 20 * i / 49), 0.0 if i < 44 else 1.0, 1.0 if i == 3 else 0.0, "ab"[i % 2], f"h{i:02d}") for i in range(50)]
    df = spark.createDataFrame(rows, "d double, ds double, s double, cl string, ch string")
    m = g.from_df(df, sparse_threshold=0.3, cat_threshold=4, object_as_cat=True)
    kinds = [b.kind for b in m.blocks for _ in range(b.width)]
    assert m.n_columns == 55 and kinds.count("dense") == 3 and kinds.count("sparse") == 2 and kinds.count("categorical") == 50
    end = g.from_df(df.select("ch", "d"), object_as_cat=True, cat_position="end")
    assert end.get_names()[0] == "d"
    with pytest.warns(UserWarning), pytest.raises(ValueError):
        g.from_df(df.select("ch"))
    with pytest.raises(ValueError):
        g.from_df(df, cat_position="last")
    with pytest.raises(ValueError):
        m.split_density(2)


def test_names_hstack_accumulate_coo(spark, data):
    m = matrix(data)
    named = m.set_names([None] * m.n_columns)
    assert named.get_names(missing_prefix="_c")[0] == "_c0"
    assert named.get_names(missing_prefix="_c")[2] == "_c2-4[a]"
    with pytest.raises(ValueError):
        m.get_names("other")
    with pytest.raises(ValueError):
        m.set_names(["only"] * 3)
    with pytest.raises(ValueError):
        g.hstack([])
    a = g.dense(data.select("id", "u"), ["u"], "id")
    b = g.single_categorical(data.select(F.col("id").alias("k"), "c"), "c", row_id="k")
    x = wide(matrix(data))
    np.testing.assert_allclose(wide(g.hstack([a, b])), x[:, [0, 2, 3, 4]])
    r = a.transpose_matvec(F.lit(1.0))
    np.testing.assert_allclose(g.to_numpy(g.accumulate(r, r), 1)[0], 2 * x[:, 0].sum())
    coo = matrix(data).to_coo().withColumnRenamed("row_id", "i")
    back = g.from_csc(coo, len(x), x.shape[1])
    np.testing.assert_allclose(back.to_wide().toPandas().sort_values("row").drop(columns="row").to_numpy(), x)
    c = g.from_coo(coo, *x.shape)
    one = spark.range(len(x)).select(F.col("id").alias("i"), F.lit(1.0).alias("x"))
    p = x.shape[1]
    np.testing.assert_allclose(g.to_numpy(c.sandwich(one), p, p), x.T @ x)
    np.testing.assert_allclose(g.to_numpy(c.transpose().dot(c).df, p, p), x.T @ x)
    assert matrix(data).recover_orig(2).count() == 40
    with pytest.raises(ValueError):
        g.as_design(data)
    assert g.as_design(data.select("u", "s")).n_columns == 2


def test_streaming_sums(spark, data, tmp_path):
    from gramloom.streaming import SandwichStream

    data.repartition(3).write.parquet(str(tmp_path / "in"))
    sink = SandwichStream(lambda df: g.DesignMatrix(df, g.dense(df, ["u", "s"]).blocks), "w", str(tmp_path / "out"))
    sink.start(spark.readStream.schema(data.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in")), str(tmp_path / "ck")).awaitTermination(60)
    want = g.to_numpy(g.dense(data, ["u", "s"]).sandwich("w"), 2, 2)
    np.testing.assert_allclose(g.to_numpy(sink.result(spark), 2, 2), want)


def test_many_levels_stay_in_a_table(spark):
    rows = [(i, f"k{(i * 7) % 300:03d}" if i % 50 else None, float(i % 5)) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, c string, w double")
    keys = sorted({c for _, c, _ in rows if c})
    want = {k: sum(w for _, c, w in rows if c == k) for k in keys}
    m = g.single_categorical(df, "c", cat_missing_method="zero", row_id="id")
    assert not isinstance(m.blocks[0].levels, (tuple, list)) and len(m.blocks[0].levels) == len(keys) == m.n_columns
    assert m.get_names() == [f"c[{k}]" for k in keys] and m.getcol(5).get_names() == [f"c[{keys[5]}]"]
    assert {r["j"]: r["value"] for r in m.transpose_matvec("w").collect()} == {j: want[k] for j, k in enumerate(keys)}
    assert {r["j"]: r["value"] for r in m.transpose_matvec("w", cols=[0, 7]).collect()} == {0: want[keys[0]], 7: want[keys[7]]}
    converted = g.single_categorical(df, "c", cat_missing_method="convert", row_id="id")
    assert {r["j"]: r["value"] for r in converted.transpose_matvec("w").collect()}[len(keys)] == sum(w for _, c, w in rows if c is None)
    with pytest.raises(ValueError, match="can't have missing"):
        g.single_categorical(df, "c")
    with pytest.raises(ValueError, match="already exists"):
        g.single_categorical(df, "c", cat_missing_method="convert", cat_missing_name=keys[0])
    with pytest.raises(ValueError, match="unseen categories"):
        g.single_categorical(df, "c", levels=keys[1:], cat_missing_method="zero")
    f = g.from_formula("c", df, cat_missing_method="zero", row_id="id")
    assert not isinstance(f.blocks[0].levels, (tuple, list)) and f.get_names() == m.get_names()
    again = f.spec.get_model_matrix(df.filter("id < 100"), "id")
    assert again.n_columns == len(keys) and again.transpose_matvec("w").count() == len(keys)
    with pytest.raises(ValueError, match="unseen categories"):
        f.spec.get_model_matrix(df.withColumn("c", F.lit("other")), "id")


def test_coo_queries_grow_with_the_table(spark, tmp_path):
    from gramloom import queries

    def cells(n):
        rows = [(o, (o * 13 + k * 17) % n, k + 1, float(o % 4 + k + 1)) for o in range(n) for k in range(3)]
        spark.createDataFrame(rows, "l_orderkey long, l_partkey long, l_linenumber int, l_quantity double").write.parquet(str(tmp_path / f"{n}/lineitem.parquet"))
        x = np.zeros((n, n))
        for o, p, _, q in rows:
            x[o, p] += q
        return str(tmp_path / str(n)), x

    for n in (100, 2500):
        where, x = cells(n)
        out = {r["row_id"]: r["value"] for r in queries.coo_matvec_keys(spark, where).collect()}
        assert len(out) == n and out == dict(enumerate(x @ np.arange(1, n + 1)))
        if n == 100:
            np.testing.assert_allclose(g.to_numpy(queries.coo_sandwich_keys(spark, where), n, n), x.T @ x)
            split = {r["j"]: r["is_dense"] for r in queries.density_split_keys(spark, where).collect()}
            assert split == {j: bool(d > 4.0 / n) for j, d in enumerate((x != 0).mean(axis=0))}


def test_view_names_and_products(data):
    view, _, _ = g.dense(data, ["u", "s"], "id").standardize("w")
    named = view.set_names(["a", "b"]).set_names(["t", "t"], "term")
    assert named.column_names == ["a", "b"]
    assert named.term_names == ["t", "t"]
    assert view.get_names() == ["u", "s"]
    x = wide(view)
    assert np.allclose((view @ [1.0, 2.0]).toPandas().sort_values("row_id")["value"], x @ [1.0, 2.0])
    assert np.allclose(g.to_numpy("w" @ view, 2), weights(data) @ x)
