"""Names, values and replay of formulas."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from gramloom import from_formula
from gramloom.functions.formula import parse_terms, stateful_transform


@pytest.fixture(scope="module")
def df(spark):
    return spark.createDataFrame([(0, 1.0, "a", "a"), (1, 2.0, "b", "b"), (2, 3.0, "c", "c")], "id long, a double, A string, B string".replace("A string", "`A1` string")).withColumnRenamed("a", "x").withColumnRenamed("A1", "A")


GOLDEN = {
    "x": (["Intercept", "x"], ["Intercept", "x"]),
    "A": (["Intercept", "A[b]", "A[c]"], ["Intercept", "A[a]", "A[b]", "A[c]"]),
    "C(A)": (["Intercept", "C(A)[b]", "C(A)[c]"], ["Intercept", "C(A)[a]", "C(A)[b]", "C(A)[c]"]),
    "A:x": (["Intercept", "A[a]:x", "A[b]:x", "A[c]:x"],) * 2,
    "A:B": (["Intercept", "B[b]", "B[c]", *[f"A[{i}]:B[{j}]" for j in "abc" for i in "bc"]], ["Intercept", *[f"A[{i}]:B[{j}]" for j in "abc" for i in "abc"]]),
}


@pytest.mark.parametrize("formula", GOLDEN)
def test_names(df, formula):
    for full_rank, names in zip((True, False), GOLDEN[formula]):
        assert from_formula(formula, df, ensure_full_rank=full_rank, include_intercept=True).get_names() == names


def test_parsing():
    assert parse_terms("a*b + c - b", True) == [(), ("a",), ("c",), ("a", "b")]
    assert parse_terms("0 + a", True) == [("a",)]
    assert parse_terms("a - 1", True) == [("a",)]
    assert parse_terms("(a + b):c", False) == [("a", "c"), ("b", "c")]
    for bad in ("a %in% b", "a +", "(a", "a b"):
        with pytest.raises(ValueError):
            parse_terms(bad, True)


def test_full_rank_spans_the_same_space(spark):
    rng = np.random.default_rng(3)
    rows = [(i, float(rng.normal()), str(rng.choice(list("ab"))), str(rng.choice(list("xyz"))), str(rng.choice(list("pq")))) for i in range(120)]
    data = spark.createDataFrame(rows, "id long, u double, A string, B string, C1 string")
    for formula in ("A + B", "A*B", "A:B", "A*B*C1", "A:u + B", "A:B:u", "0 + A:B + C1"):
        wide = lambda full: from_formula(formula, data, ensure_full_rank=full, include_intercept=True, row_id="id").to_wide().toPandas().sort_values("id").drop(columns="id").to_numpy()  # noqa: E731, B023
        reduced, whole = wide(True), wide(False)
        assert np.linalg.matrix_rank(reduced) == reduced.shape[1] == np.linalg.matrix_rank(whole) == np.linalg.matrix_rank(np.hstack([reduced, whole]))


def test_values_functions_and_context(df):
    m = from_formula("{x ** 2} + np.log(x) + {np.where(x > 2, x, 0)} + {k * x} + center(x) + poly(x, 2, raw=True)", df, context={"k": 3.0}, row_id="id")
    x = np.array([1.0, 2.0, 3.0])
    got = m.to_wide().toPandas().sort_values("id").drop(columns="id").to_numpy()
    np.testing.assert_allclose(got, np.column_stack([x**2, np.log(x), np.where(x > 2, x, 0), 3 * x, x - 2, x, x**2]))
    for bad in ("__import__('os')", "open(x)", "{x.real}", "nothing"):
        with pytest.raises((ValueError, KeyError)):
            from_formula(bad, df)


def test_poly_is_orthonormal_and_splines_sum_to_one(spark):
    data = spark.range(50).select("id", (F.col("id") * F.col("id") / 7.0).alias("x"))
    m = from_formula("poly(x, 3)", data, row_id="id")
    z = m.to_wide().toPandas().drop(columns="id").to_numpy()
    np.testing.assert_allclose(z.T @ z, np.eye(3), atol=1e-6)
    np.testing.assert_allclose(z.sum(axis=0), 0, atol=1e-6)
    s = from_formula("bs(x, 6)", data, row_id="id").to_wide().toPandas().sort_values("id").drop(columns="id").to_numpy()
    assert s.shape == (50, 6) and (s >= -1e-12).all() and (s.sum(axis=1) <= 1 + 1e-9).all()
    # with the basis function that is left out, they sum to one
    x = np.arange(50.0) ** 2 / 7
    first_knot = np.percentile(x, 25)
    left_out = np.where(x < first_knot, (1 - x / first_knot) ** 3, 0)
    np.testing.assert_allclose(s.sum(axis=1) + left_out, 1, atol=1e-9)
    spec = from_formula("bs(x, 6)", data, row_id="id").spec
    with pytest.raises(Exception, match="outside"):
        spec.get_model_matrix(data.withColumn("x", F.lit(1e9)), row_id="id").to_wide().collect()


def test_replay(spark, df):
    spec = from_formula("A + center(x)", df, row_id="id").spec
    again = spec.get_model_matrix(df.filter("x > 2"), row_id="id")
    assert again.get_names() == ["A[a]", "A[b]", "A[c]", "center(x)"]
    assert again.to_wide().first()["center(x)"] == 1.0
    with pytest.raises(ValueError, match="unseen"):
        spec.get_model_matrix(df.withColumn("A", F.lit("z")))
    with pytest.raises(ValueError, match="missing"):
        spec.get_model_matrix(df.withColumn("A", F.lit(None).cast("string")))


def test_missing(spark):
    data = spark.createDataFrame([(1.0, "a"), (2.0, None), (None, "c")], "x double, A string")
    with pytest.raises(ValueError):
        from_formula("A", data)
    assert from_formula("A", data, cat_missing_method="convert").get_names()[-1] == "A[(MISSING)]"
    assert from_formula("A", data, na_action="drop").get_names() == ["A[a]", "A[c]"]
    assert from_formula("x + A", data, na_action="drop").get_names() == ["x", "A[a]"]
    with pytest.raises(ValueError):
        from_formula("A", data, na_action="raise")
    spec = from_formula("C(A, missing_method='convert')", data.filter("A is not null")).spec
    with pytest.raises(ValueError, match="unseen"):
        spec.get_model_matrix(data)


def test_levels_sides_and_clusters(spark, df):
    assert from_formula("C(A, levels=['c', 'a', 'b', 'd'])", df).get_names() == [f"C(A, levels=['c', 'a', 'b', 'd'])[{x}]" for x in "cabd"]
    left, right = from_formula("x ~ A", df)
    assert left.get_names() == ["x"] and right.n_columns == 3
    assert from_formula("C(A, spans_intercept=False)", df, ensure_full_rank=True, include_intercept=True).n_columns == 4
    m = from_formula("A + x + A:x", df, cluster_by="numerical_factors")
    assert m.get_names()[:4] == ["A[a]", "A[b]", "A[c]", "x"]
    numbers = spark.createDataFrame([(10,), (2,)], "k int")
    assert from_formula("C(k)", numbers).get_names() == ["C(k)[10]", "C(k)[2]"]


def test_bs_knots_are_exact_without_one_map_of_all_values(spark, monkeypatch):
    from gramloom.functions.quantiles import percentiles

    def refuse(*a, **k):
        raise AssertionError("percentile() keeps every distinct value in one task")

    rng = np.random.default_rng(4)
    cases = [[float(v) for v in np.exp(rng.normal(0, 6, 5000))] + [None] * 5, [1.0] * 50 + [2.0] * 50, [3.0], [0.0, 5e-324, 1e-323], [-np.inf, 1.0, 2.0, 5.0, 7.0, np.inf], [-1e308, 0.0, 1e-300, 2e-300, 1e308], [0.1, 0.2, 0.7, 0.9]]
    at = [0.0, 1 / 3, 0.5, 2 / 3, 1.0]
    frames = [spark.createDataFrame([(v,) for v in c], "x double") for c in cases]
    wants = [list(f.agg(*[F.percentile("x", F.lit(p)) for p in at]).first()) for f in frames]
    monkeypatch.setattr(F, "percentile", refuse)
    for f, want in zip(frames, wants):
        low, high, got = percentiles(f, F.col("x"), at)
        assert (low, high) == (want[0], want[-1]) and got == want
    assert from_formula("bs(x, 5)", frames[0]).n_columns == 5


def test_stateful_function_of_the_context(df):
    @stateful_transform
    def share(x, state, df, times=1.0):
        if "most" not in state:
            state["most"] = df.agg(F.max(x)).first()[0]
        return x / state["most"] * times

    m = from_formula("share(x, times=2.0) + {share(x) + 1}", df, context={"share": share}, row_id="id")
    assert np.allclose(m.to_wide().toPandas().sort_values("id").drop(columns="id"), [[2 / 3, 4 / 3], [4 / 3, 5 / 3], [2, 2]])
    again = m.spec.get_model_matrix(df.filter("x < 3"), row_id="id")
    assert np.allclose(again.to_wide().toPandas().sort_values("id").drop(columns="id"), [[2 / 3, 4 / 3], [4 / 3, 5 / 3]])
