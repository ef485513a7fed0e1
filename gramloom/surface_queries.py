"""More operators as queries with DuckDB SQL: rows, columns, views, triplets and formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import as_design, from_codes, from_csc, from_df, from_formula, hstack, single_categorical, stateful_transform
from .queries import CODE_FLAG, CODE_STATUS, D, FLAGS, NUM, NUM_SQL, QUERIES, S, SPLIT_CATS, SQL, _BRANDS, _KEYED, _KIND, _MEANS, _SPARSE, _STD, _TRIPLES
from .queries import _coo, _cross, _keyed, _rounded, _view, catalog, code_sql, lineitem, query, rmatvec_sql, sparse_tax, split, table
from .sources import dense

ORDERS = ["o_totalprice", "o_custkey"]


def _orders(spark, sf_dir):
    return dense(table(spark, sf_dir, "orders"), ORDERS, "o_orderkey")


# -- rows and columns ----------------------------------------------------------


@query("SELECT unnest(range(0, 7))::INTEGER AS j, 0.0::DOUBLE AS value FROM (SELECT count(*) FROM lineitem)")
def empty_rows_rmatvec(spark, sf_dir):
    return split(spark, sf_dir).transpose_matvec(D, rows=[], exact=True)


@query("SELECT i, j, value FROM (SELECT 0::INTEGER AS i, 0::INTEGER AS j, sum(o_totalprice) AS value FROM orders) WHERE false")
def empty_cols_sandwich(spark, sf_dir):
    return _orders(spark, sf_dir).sandwich(F.lit(1.0), cols=[])


@query(rmatvec_sql({0: "o_totalprice", 1: "o_custkey"}, [], "1", "(SELECT * FROM orders WHERE o_orderkey IN (3, 7, 11))"))
def repeated_rows_count_once(spark, sf_dir):
    return _orders(spark, sf_dir).transpose_matvec(F.lit(1.0), rows=[3, 7, 7, 11, 3], exact=True)


@query("SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey, o_totalprice FROM orders WHERE o_orderkey >= 1 AND (o_orderkey - 1) % 3 = 0")
def row_slice(spark, sf_dir):
    return _orders(spark, sf_dir)[1::3, [1, 0]].to_wide()


@query("SELECT o_orderkey, o_totalprice::FLOAT::DOUBLE AS o_totalprice, o_custkey::FLOAT::DOUBLE AS o_custkey FROM orders")
def astype_float(spark, sf_dir):
    return _orders(spark, sf_dir).astype("float").to_wide()


@query(_rounded(rmatvec_sql(NUM_SQL, SPLIT_CATS, D, "lineitem")))
def row_vector_times_matrix(spark, sf_dir):
    return (F.col(D) @ split(spark, sf_dir)).withColumn("value", F.round("value", 5))


@query(_cross("i <= 1", "j BETWEEN 2 AND 4"))
def cross_dense_cat(spark, sf_dir):
    return split(spark, sf_dir).cross_sandwich(D, [0, 1], [2, 3, 4], exact=True)


# -- standard deviations and views ---------------------------------------------


@query(_STD.replace("l_tax", "sp").replace("FROM lineitem", f"FROM {_SPARSE}"))
def col_stds_sparse(spark, sf_dir):
    return dense(sparse_tax(spark, sf_dir), ["l_discount", "sp"], kind="sparse").col_stds(D, exact=True)


@query(f"{_STD} UNION ALL SELECT j, sqrt(greatest(value - value * value, 0)) AS value FROM ({_MEANS}) WHERE j >= 2")
def col_stds_split(spark, sf_dir):
    return split(spark, sf_dir).col_stds(D, exact=True)


@query("SELECT o_orderkey AS row_id, o_totalprice * 0.5::DOUBLE + o_custkey::DOUBLE * (-2.0)::DOUBLE AS value FROM orders")
def unstandardize(spark, sf_dir):
    return _view(_orders(spark, sf_dir), [0.3, 0.2], [1.67, 0.6]).unstandardize() @ [0.5, -2.0]


@query("SELECT o_orderkey, o_custkey::DOUBLE * 0.6::DOUBLE + 0.2::DOUBLE AS o_custkey FROM orders WHERE o_orderkey % 2 = 0")
def view_rows_and_columns(spark, sf_dir):
    return _view(_orders(spark, sf_dir), [0.3, 0.2], [1.67, 0.6])[::2, [1]].to_wide()


# -- triplets ------------------------------------------------------------------


@query(f"SELECT j::INTEGER AS j, {S('value * (i % 7 + 1)')} AS value FROM {_KEYED} GROUP BY j")
def coo_rmatvec_keys(spark, sf_dir):
    m = _keyed(spark, sf_dir)
    return m.transpose_matvec(spark.range(m.n_rows).select(F.col("id").alias("i"), (F.col("id") % 7 + 1.0).alias("x")), exact=True)


@query(f"SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, sum(a.value * b.value) AS value FROM {_KEYED} a JOIN {_KEYED} b ON a.i = b.i GROUP BY 1, 2")
def coo_dot_keys(spark, sf_dir):
    """Parts by parts over the orders that have both; quantities are whole numbers, so sums are exact."""
    m = _keyed(spark, sf_dir)
    return m.transpose().dot(m).df


@query(f"SELECT i::BIGINT AS row_id, j::INTEGER AS j, value FROM {_TRIPLES} WHERE value <> 0")
def from_csc_coo(spark, sf_dir):
    return from_csc(_coo(spark, sf_dir).df, 1000, 7).to_coo()


# -- construction --------------------------------------------------------------


@query(rmatvec_sql(NUM_SQL, [], D, "lineitem"))
def as_design_rmatvec(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    m = as_design(df.select(*NUM, D))
    return m.transpose_matvec(D, cols=[0, 1], exact=True)


@query(rmatvec_sql({}, [("l_linenumber - 1", 0, 7)], D, "lineitem"))
def from_codes_rmatvec(spark, sf_dir):
    df = lineitem(spark, sf_dir).withColumn("line", F.col("l_linenumber") - 1)
    return from_codes(df, "line", [f"line {k}" for k in range(1, 8)]).transpose_matvec(D, exact=True)


@query(rmatvec_sql({}, [("CASE WHEN l_linenumber > 3 THEN 3 ELSE l_linenumber - 1 END", 0, 4)], D, "lineitem"))
def from_codes_missing(spark, sf_dir):
    """Lines after the third are missing, and get a column of their own."""
    df = lineitem(spark, sf_dir).withColumn("line", F.expr("CASE WHEN l_linenumber > 3 THEN -1 ELSE l_linenumber - 1 END"))
    return from_codes(df, "line", ["first", "second", "third"], cat_missing_method="convert").transpose_matvec(D, exact=True)


@query(f"WITH b AS ({_BRANDS}), n AS (SELECT count(*) AS n FROM b) SELECT (k - 1)::INTEGER AS j, replace(name, 'p_brand', 'brand') AS name, 'of' AS term, kind FROM b UNION ALL SELECT n::INTEGER, 'size', 'size', (SELECT {_KIND.format('p_size')} FROM part) FROM n")
def set_names_catalog(spark, sf_dir):
    m = from_df(table(spark, sf_dir, "part").select("p_brand", "p_size"), object_as_cat=True)
    return catalog(m.set_names(["brand", "size"]).set_names(["of", "size"], "term"))


@query(f"SELECT j, value FROM ({rmatvec_sql({0: 'l_tax', 6: 'l_discount'}, [(CODE_FLAG.replace('THEN 2', 'THEN 1').replace('THEN 3', 'THEN 2').replace('THEN 4', 'THEN 3'), 1, 3), (CODE_STATUS.replace('THEN 5', 'THEN 4').replace('THEN 6', 'THEN 5'), 4, 2)], D, 'lineitem')})")
def hstack_nested(spark, sf_dir):
    """A matrix of several blocks inside of another one; blocks stand side by side."""
    df = lineitem(spark, sf_dir)
    inner = hstack([single_categorical(df, "l_returnflag", FLAGS), single_categorical(df, "l_linestatus", ("F", "O"))])
    return hstack([dense(df, ["l_tax"]), inner, dense(df, ["l_discount"])]).transpose_matvec(D, exact=True)


# -- formulas ------------------------------------------------------------------


@query(rmatvec_sql({}, [("l_linenumber - 1", 0, 7)], D, "lineitem"))
def formula_as_categorical(spark, sf_dir):
    return from_formula("C(l_linenumber)", lineitem(spark, sf_dir)).transpose_matvec(D, exact=True)


@query(rmatvec_sql({0: "(l_discount * l_tax)"}, [], D, "lineitem"))
def formula_interaction_num_num(spark, sf_dir):
    return from_formula("l_discount:l_tax", lineitem(spark, sf_dir)).transpose_matvec(D, exact=True)


@query("SELECT o_orderkey, round(ln(o_totalprice), 9) AS x FROM orders")
def formula_log(spark, sf_dir):
    m = from_formula("np.log(o_totalprice)", table(spark, sf_dir, "orders"), row_id="o_orderkey")
    return m.set_names(["x"]).to_wide().withColumn("x", F.round("x", 9))


@query(rmatvec_sql({0: "(l_tax / 2)"}, [], D, "lineitem"))
def formula_callable(spark, sf_dir):
    return from_formula("half(l_tax)", lineitem(spark, sf_dir), context={"half": lambda x: x / 2}).transpose_matvec(D, exact=True)


@stateful_transform
def _share_of_greatest(x, state, df):
    if "greatest" not in state:
        state["greatest"] = df.agg(F.max(x)).first()[0]
    return x / F.lit(state["greatest"])


@query("SELECT o_orderkey, o_totalprice / (SELECT max(o_totalprice) FROM orders) AS x FROM orders WHERE o_orderstatus <> 'O'")
def formula_stateful(spark, sf_dir):
    """What the function learned from all orders is used again on some."""
    df = table(spark, sf_dir, "orders")
    spec = from_formula("share(o_totalprice)", df, context={"share": _share_of_greatest}).spec
    return spec.get_model_matrix(df.filter("o_orderstatus <> 'O'"), "o_orderkey").set_names(["x"]).to_wide()


@query(f"SELECT j, CASE j WHEN 0 THEN 'l_tax' ELSE 'l_returnflag[' || x || ']' END AS name, CASE j WHEN 0 THEN 'l_tax' ELSE 'l_returnflag' END AS term, CASE WHEN share > 0.3 THEN 'dense' ELSE 'sparse' END AS kind FROM (SELECT 0::INTEGER AS j, '' AS x, avg((l_tax <> 0)::INTEGER) AS share FROM lineitem UNION ALL SELECT ({code_sql('x', FLAGS, 1)})::INTEGER, x, (SELECT avg((l_returnflag = x)::INTEGER) FROM lineitem) FROM (SELECT unnest(['A', 'N', 'R']) AS x))")
def formula_thresholds(spark, sf_dir):
    return catalog(from_formula("l_tax + l_returnflag", lineitem(spark, sf_dir), sparse_threshold=0.3, cat_threshold=4))


# -- splines and polynomials in closed form ------------------------------------


def _spline_sql(x: str, knots: list[str], degree: int) -> list[str]:
    """Cox and de Boor's recursion as SQL over knots given by name, first basis left out; inner knots are single."""
    last, inner = len(knots) - 1, range(degree, len(knots) - degree - 1)

    def basis(k: int, d: int) -> str | None:
        if d == 0:
            if k not in inner:
                return None
            upper = "<=" if k == inner[-1] else "<"
            return f"(CASE WHEN {x} >= {knots[k]} AND {x} {upper} {knots[k + 1]} THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)"
        a, b = basis(k, d - 1), basis(k + 1, d - 1)
        parts = [f"({x} - {knots[k]}) / ({knots[k + d]} - {knots[k]}) * {a}"] if a else []
        parts += [f"({knots[k + d + 1]} - {x}) / ({knots[k + d + 1]} - {knots[k + 1]}) * {b}"] if b else []
        return f"({' + '.join(parts)})" if parts else None

    return [basis(k, degree) or "0.0::DOUBLE" for k in range(1, last - degree)]


_KNOTS = "SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi, quantile_cont(o_totalprice, 1.0 / 3) AS k1, quantile_cont(o_totalprice, 2.0 / 3) AS k2 FROM orders"
_BASES = _spline_sql("o_totalprice", ["lo"] * 4 + ["k1", "k2"] + ["hi"] * 4, 3)


@query(f"SELECT o_orderkey, {', '.join(f'round({b}, 6) AS b{k}' for k, b in enumerate(_BASES, 1))} FROM orders, ({_KNOTS})")
def bspline_values(spark, sf_dir):
    wide = QUERIES["bspline"](spark, sf_dir)
    return wide.select("o_orderkey", *[F.round(F.col(f"b{k}"), 6).alias(f"b{k}") for k in range(1, 6)])


_POLY = """
WITH c AS (SELECT o_orderkey, o_totalprice - (SELECT avg(o_totalprice) FROM orders) AS c FROM orders),
m AS (SELECT count(*)::DOUBLE AS n, sum(c * c) AS s2, sum(c * c * c) AS s3 FROM c),
q AS (SELECT o_orderkey, c / sqrt(s2) AS p1, c * c - s3 / s2 * c - s2 / n AS r FROM c, m)
"""


@query(f"{_POLY} SELECT o_orderkey, round(p1, 7) AS p1, round(r / sqrt((SELECT sum(r * r) FROM q)), 7) AS p2 FROM q")
def poly_orthogonal_values(spark, sf_dir):
    m = from_formula("poly(o_totalprice, 2)", table(spark, sf_dir, "orders"), row_id="o_orderkey")
    return m.set_names(["p1", "p2"]).to_wide().select("o_orderkey", *[F.round(F.col(f"p{k}"), 7).alias(f"p{k}") for k in (1, 2)])
