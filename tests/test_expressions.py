"""Expressions against NumPy, term operators, and replay that brings columns back into their structure."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

import gramloom as g
from gramloom.functions.expressions import StructureError
from gramloom.functions.formula import parse_terms

X = pd.DataFrame({"x": [1.5, -2.5, 0.0, np.nan, 7.0, -7.0], "y": [2.0, 3.0, -3.0, 1.0, np.nan, -3.0], "k": [1, 2, 3, 4, 5, 6], "b": [True, False, True, True, False, False]})


@pytest.fixture(scope="module")
def frame(spark):
    return spark.createDataFrame(X.assign(i=range(len(X))))


EXPRESSIONS = {
    "x % y": lambda d: np.where(np.isnan(d.y), np.nan, np.mod(d.x, d.y)),
    "k % 3 - x": lambda d: d.k % 3 - d.x,
    "x // y": lambda d: np.floor_divide(d.x, d.y),
    "-x ** 2": lambda d: -(d.x**2),
    "np.minimum(x, y)": lambda d: np.minimum(d.x, d.y),
    "np.maximum(x, 1)": lambda d: np.where(np.isnan(d.x), np.nan, np.maximum(d.x, 1)),
    "np.clip(x, -1, 2)": lambda d: np.clip(d.x, -1, 2),
    "(x > 0) & (y > 0)": lambda d: (d.x > 0) & (d.y > 0),
    "(x > 0) | ~(y > 0)": lambda d: (d.x > 0) | ~(d.y > 0),
    "(x > 0) ^ b": lambda d: (d.x > 0) ^ d.b,
    "x != 7 and not b": lambda d: (d.x != 7) & ~d.b,
    "-3 < x <= 1.5": lambda d: (-3 < d.x) & (d.x <= 1.5),
    "k in [1, 5]": lambda d: d.k.isin([1, 5]),
    "k not in [1, 5]": lambda d: ~d.k.isin([1, 5]),
    "(x > 0) * k + b": lambda d: (d.x > 0) * d.k + d.b,
    "np.where((x > 0) & b, k, -k)": lambda d: np.where((d.x > 0) & d.b, d.k, -d.k),
    "k if b else 0": lambda d: np.where(d.b, d.k, 0),
    "np.isnan(x) | b": lambda d: np.isnan(d.x) | d.b,
    "np.logical_not(np.logical_and(b, k > 1))": lambda d: ~(d.b & (d.k > 1)),
    "np.power(k, 2) + np.square(x)": lambda d: d.k**2 + d.x**2,
    "np.log2(k) + np.log10(k) + np.expm1(x)": lambda d: np.log2(d.k) + np.log10(d.k) + np.expm1(d.x),
    "np.floor(x) - np.ceil(x) + np.rint(x)": lambda d: np.floor(d.x) - np.ceil(d.x) + np.rint(d.x),
    "np.sign(x) * np.sin(k) + np.tanh(k)": lambda d: np.sign(d.x) * np.sin(d.k) + np.tanh(d.k),
    "I(x * 2)": lambda d: d.x * 2,
    "x / 0": lambda d: np.full(len(d), np.nan),
    "7 % 4 + 2 ** 3 + x - 7 // 2": lambda d: 3 + 8 + d.x - 3,
}


@pytest.mark.parametrize("text", EXPRESSIONS)
def test_expressions(frame, text):
    out = g.from_formula("{" + text + "}", frame, row_id="i").set_names(["v"]).to_wide().orderBy("i").collect()
    got = [np.nan if r["v"] is None else r["v"] for r in out]
    np.testing.assert_allclose(got, np.asarray(EXPRESSIONS[text](X), dtype=float), rtol=1e-12)


@pytest.mark.parametrize("text", ["x & y", "~x", "not k", "x << 2", "[1] + x", "unknown(x)", "lambda: x", "x.y", "'a' * 2", "k in x", "x @ y"])
def test_what_is_refused(frame, text):
    with pytest.raises(ValueError):
        g.from_formula("{" + text + "}", frame)


@pytest.mark.parametrize(
    ("text", "terms"),
    [
        ("(a + b) ** 2", ["a", "b", "a:b"]),
        ("(a + b + c)**2", ["a", "b", "c", "a:b", "a:c", "b:c"]),
        ("(a + b + c)^3", ["a", "b", "c", "a:b", "a:c", "b:c", "a:b:c"]),
        ("(a + b) ** 1", ["a", "b"]),
        ("a / b", ["a", "a:b"]),
        ("a / (b + c)", ["a", "a:b", "a:c"]),
        ("(a + b) / c", ["a", "b", "a:b:c"]),
        ("a / b / c", ["a", "a:b", "a:b:c"]),
        ("a ** 2", ["a"]),
        ("(a + b) ** 2 - a:b", ["a", "b"]),
        ("a:b ** 2", ["a:b"]),
        (". - d", ["a", "b", "c"]),
        (".:d", ["d", "a:d", "b:d", "c:d"]),
    ],
)
def test_term_operators(text, terms):
    assert [":".join(t) for t in parse_terms(text, False, ["a", "b", "c", "d"])] == terms


@pytest.mark.parametrize("text", ["a **", "a ** b", "a ** 0", "a / ", "/ a", "** 2", "a ** 1.5"])
def test_bad_term_operators(text):
    with pytest.raises(ValueError):
        parse_terms(text, False)


def test_dot_leaves_out_the_left_side(spark, frame):
    left, right = g.from_formula("np.log(k) ~ . - i", frame)
    assert right.get_names() == ["x", "y", "b"]
    again = g.Spec.from_json(spark, right.spec.to_json())
    assert again.get_model_matrix(frame.withColumn("more", F.lit(1.0))).get_names() == ["x", "y", "b"]


# -- replay -------------------------------------------------------------------------


def columns(made):
    """A function of the context that gives so many columns when it learns, and others later."""

    @g.stateful_transform
    def f(x, state, df):
        n = made[1] if "learned" in state else made[0]
        state["learned"] = True
        return [(str(k), x * (k + 1)) for k in n] if isinstance(n, list) else x * n

    return f


@pytest.mark.parametrize(("made", "want"), [(([0, 1], []), [0, 0]), (([0, 1, 2], [0]), [1, 1, 1]), (([0, 1], [0, 1]), [1, 2]), ((2, 2), [2])])
def test_replay_repairs(frame, made, want):
    m = g.from_formula("k + f(x)", frame, context={"f": columns(made)}, row_id="i")
    again = m.spec.get_model_matrix(frame)
    assert again.get_names() == m.get_names() and len(want) == m.n_columns - 1
    got = again.to_wide().orderBy("i").collect()[0]
    assert [got[n] for n in m.get_names()[1:]] == [1.5 * w for w in want]


@pytest.mark.parametrize("made", [([0], [0, 1]), ([0, 1], [0, 2]), ([0, 1, 2], [0, 1])])
def test_replay_refuses(frame, made):
    m = g.from_formula("k + f(x)", frame, context={"f": columns(made)})
    with pytest.raises(StructureError, match="f\\(x\\)"):
        m.spec.get_model_matrix(frame)


def test_dropped_levels_stay_dropped(spark):
    df = spark.createDataFrame([("A", 1.0)] * 3, "c string, x double")
    m = g.from_formula("C(c) + 1", df, ensure_full_rank=True)
    assert m.get_names() == m.spec.get_model_matrix(df).get_names() == ["Intercept"]
