"""Partitions that grow with the rows, and the same results through them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gramloom as g
from gramloom.functions import formula, levels
from gramloom.operators import matrix
from gramloom.operators.pairs import interaction
from gramloom.plans import spread


@pytest.fixture
def small(monkeypatch):
    for module in (spread, levels, matrix, formula):
        monkeypatch.setattr(module, "TASK_ROWS", 40)


def filled(df, *shape):
    out = np.zeros(shape)
    for r in df.collect():
        out[tuple(r[:-1])] = r[-1]
    return out


def test_products_of_triplets_grow_in_partitions(spark, small):
    x = np.where(np.random.default_rng(3).random((50, 20)) < 0.2, 3.0, 0.0)
    m = g.from_coo(spark.createDataFrame([(int(i), int(j), float(x[i, j])) for i, j in zip(*np.nonzero(x))], "i long, j int, value double"), 50, 20).stored()
    met = int((x != 0).sum(1) @ (x != 0).sum(1))
    for result in (m.sandwich(spark.range(50).select(F.col("id").alias("i"), F.lit(1.0).alias("x"))), m.transpose().dot(m).df):
        assert result.rdd.getNumPartitions() >= min(met, 400) // 40 > 4
        np.testing.assert_allclose(filled(result, 20, 20), x.T @ x)


def test_levels_and_sums_grow_in_partitions(spark, small):
    df = spark.range(600).select((F.col("id") % 19).alias("a"), (F.col("id") % 23).alias("b"), F.lit(2.0).alias("w"))
    m = interaction(df, ["a", "b"])
    assert m.blocks[0].levels.df.select(F.input_file_name()).distinct().count() > 4
    pairs = sorted({(k % 19, k % 23) for k in range(600)})
    wanted = [2.0 * sum((k % 19, k % 23) == p for k in range(600)) for p in pairs]
    result = m.transpose_matvec("w")
    np.testing.assert_allclose(filled(result, len(pairs)), wanted)


def test_sums_of_a_formula_join_no_combinations(spark, small):
    df = spark.range(600).select(F.format_string("%02d", F.col("id") % 19).alias("a"), F.format_string("%02d", F.col("id") % 23).alias("b"), F.lit(2.0).alias("w"))
    m = g.from_formula("a:b", df, interactions="observed")
    assert m.base.columns != m.df.columns and set(m.base.columns) < set(m.df.columns)
    np.testing.assert_allclose(filled(m.transpose_matvec("w"), m.n_columns).sum(), 1200)
