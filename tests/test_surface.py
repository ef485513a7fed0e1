"""Codes, thresholds, stored specs and the driver contract's imports."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
import gramloom as g
from gramloom.functions import levels


@pytest.fixture(scope="module")
def df(spark):
    rows = [(i, [0, 2, 1, None, -1, 2][i], float(i), "xyxyxz"[i]) for i in range(6)]
    return spark.createDataFrame(rows, "id long, k int, u double, c string")


def wide(m):
    return m.to_wide().toPandas().sort_values("id").drop(columns="id").to_numpy()


def test_codes_are_used_as_given(df):
    m = g.from_codes(df, "k", ["a", "b", "c"], cat_missing_method="zero", row_id="id")
    want = np.eye(3)[[0, 2, 1, 0, 0, 2]] * np.array([1, 1, 1, 0, 0, 1])[:, None]
    np.testing.assert_array_equal(wide(m), want)
    np.testing.assert_allclose(g.to_numpy(m.sandwich("u"), 3, 3), want.T @ (want * np.arange(6.0)[:, None]))
    converted = g.from_codes(df, "k", ["a", "b", "c"], cat_missing_method="convert", row_id="id")
    assert converted.column_names == ["k[a]", "k[b]", "k[c]", "k[(MISSING)]"]
    assert wide(converted)[:, 3].tolist() == [0, 0, 0, 1, 1, 0]
    got = {r["id"]: r["value"] for r in m.recover_orig().collect()}
    assert got == {0: "a", 1: "c", 2: "b", 3: None, 4: None, 5: "c"}


def test_codes_out_of_range(df):
    with pytest.raises(ValueError, match="code 2, but there are 2"):
        g.from_codes(df, "k", ["a", "b"], cat_missing_method="zero")
    with pytest.raises(ValueError, match="code -2"):
        g.from_codes(df.withColumn("k", F.lit(-2)), "k", ["a", "b"])
    with pytest.raises(ValueError, match="missing"):
        g.from_codes(df, "k", ["a", "b", "c"])
    assert g.from_codes(df.limit(0), "k", ["a"]).transpose_matvec("u").first()["value"] == 0


def test_formula_thresholds_change_kinds_and_no_value(df):
    plain = g.from_formula("u + c", df, row_id="id")
    m = g.from_formula("u + c", df, row_id="id", sparse_threshold=0.4, cat_threshold=4)
    assert [b.kind for b in m.blocks] == ["dense", "dense", "sparse", "sparse"]
    assert m.column_names == plain.column_names
    np.testing.assert_array_equal(wide(m), wide(plain))
    again = m.spec.get_model_matrix(df.filter("id < 2"), "id")
    assert again.column_names == m.column_names and wide(again).tolist() == wide(plain)[:2].tolist()
    tenth = g.from_formula("{u / 10}", df, row_id="id", dtype="float")
    np.testing.assert_array_equal(wide(tenth)[:, 0], (np.arange(6) / 10).astype("float32"))
    tenth = g.from_df(df.select("id", (F.col("u") / 10).alias("v")), row_id="id", dtype="float")
    np.testing.assert_array_equal(wide(tenth)[:, 0], (np.arange(6) / 10).astype("float32"))


def test_spec_is_stored_as_text(spark, df, tmp_path, monkeypatch):
    m = g.from_formula("center(u) + c + bs(u, 4)", df, row_id="id")
    again = g.Spec.from_json(spark, m.spec.to_json())
    np.testing.assert_allclose(wide(again.get_model_matrix(df, "id")), wide(m))
    with pytest.raises(ValueError, match="unseen"):
        again.get_model_matrix(df.withColumn("c", F.lit("w")), "id")
    monkeypatch.setattr(levels, "LITERAL_LEVELS", 2)
    m = g.from_formula("c", df, row_id="id")
    with pytest.raises(ValueError, match="folder"):
        m.spec.to_json()
    again = g.Spec.from_json(spark, m.spec.to_json(f"file://{tmp_path}"))
    assert again.get_model_matrix(df, "id").column_names == m.column_names
    np.testing.assert_allclose(wide(again.get_model_matrix(df, "id")), wide(m))


def test_view_parts_make_its_sandwich(df):
    m = g.from_formula("u + c", df, row_id="id")
    view = g.StandardizedView(m, np.array([0.5, -1.0, 2.0, 0.0]), np.array([2.0, 1.0, 0.5, 3.0]))
    x = wide(m) * view.mult + view.shift
    np.testing.assert_allclose(g.to_numpy(view.sandwich("u"), 4, 4), x.T @ (x * np.arange(6.0)[:, None]))
    cells, vectors, whole = view.sandwich_parts("u")
    full = g.to_numpy(cells, 4, 4)
    mult, shift, sums = np.array([v[1:] for v in vectors]).T
    edge = np.outer(mult * sums, shift)
    np.testing.assert_allclose(np.outer(mult, mult) * full + edge + edge.T + whole * np.outer(shift, shift), x.T @ (x * np.arange(6.0)[:, None]))


def test_combined_and_separate_groupings_agree(df, monkeypatch):
    from gramloom.operators import matrix

    m = g.from_formula("u + c + C(id)", df).multiply("u")
    want = g.to_numpy(m.sandwich(F.lit(2.0)), m.n_columns, m.n_columns), g.to_numpy(m.transpose_matvec("u"), m.n_columns)
    monkeypatch.setattr(matrix, "COMBINED", 0)
    np.testing.assert_allclose(g.to_numpy(m.sandwich(F.lit(2.0)), m.n_columns, m.n_columns), want[0])
    np.testing.assert_allclose(g.to_numpy(m.transpose_matvec("u"), m.n_columns), want[1])


def test_results_of_other_shapes_are_not_added(df):
    m = g.from_formula("u", df)
    with pytest.raises(ValueError, match="shapes"):
        g.accumulate(m.transpose_matvec("u"), m.sandwich("u"))


def test_only_a_missing_subpackage_is_passed_over():
    assert entry._is_llm(ModuleNotFoundError("x", name="corpus_pipeline"))
    assert entry._is_llm(ModuleNotFoundError("x", name="gramloom.llm"))
    assert not entry._is_llm(ModuleNotFoundError("x", name="tokenizers"))
