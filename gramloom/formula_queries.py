"""Queries for expressions, term operators and replay of formulas."""

from __future__ import annotations

from pyspark.sql import functions as F

from . import from_formula, stateful_transform
from .queries import CODE_FLAG, CODE_STATUS, D, S, lineitem, query, rmatvec_sql, table

_EXPRESSIONS = {
    "{(l_quantity > 25) & ~(l_discount < 0.05)}": "(l_quantity > 25 AND NOT l_discount < 0.05)::DOUBLE",
    "{l_quantity % 7}": "l_quantity % 7",
    "{-l_quantity % 7}": "(7 - l_quantity % 7) % 7",
    "{l_quantity // 10}": "floor(l_quantity / 10)",
    "np.minimum(l_tax, l_discount)": "least(l_tax, l_discount)",
    "np.maximum(l_tax, {l_discount / 2})": "greatest(l_tax, l_discount / 2)",
    "np.power(l_discount, 2)": "l_discount * l_discount",
    "np.log10(l_extendedprice)": "log10(l_extendedprice)",
    "I(l_tax * (l_quantity >= 10))": "CASE WHEN l_quantity >= 10 THEN l_tax ELSE 0 END",
    "{0.02 < l_tax <= 0.05 or l_returnflag in ['A', 'N']}": "((0.02 < l_tax AND l_tax <= 0.05) OR l_returnflag IN ('A', 'N'))::DOUBLE",
    "np.clip(l_quantity, 5, 40)": "least(greatest(l_quantity, 5), 40)",
}


@query(f"SELECT l_orderkey, {', '.join(f'round({x}, 9) AS x{k}' for k, x in enumerate(_EXPRESSIONS.values()))} FROM lineitem")
def formula_expressions(spark, sf_dir):
    """Booleans, remainders, element-wise extremes and more, one column each."""
    m = from_formula(" + ".join(f.replace("{l_discount / 2}", "l_discount / 2") for f in _EXPRESSIONS), lineitem(spark, sf_dir), row_id="l_orderkey")
    wide = m.set_names([f"x{k}" for k in range(len(_EXPRESSIONS))]).to_wide()
    return wide.select("l_orderkey", *[F.round(F.col(f"x{k}"), 9).alias(f"x{k}") for k in range(len(_EXPRESSIONS))])


@query(
    "WITH p AS (SELECT *, CASE WHEN p_size = 10 OR p_size IS NULL THEN NULL ELSE p_size END AS s FROM part) "
    "SELECT p_partkey, CASE WHEN s IS NULL THEN NULL ELSE least(s, 20) END::DOUBLE AS least_, (s > 5 AND s IS NOT NULL)::DOUBLE AS over, (s IS NULL OR s <> 7)::DOUBLE AS other, (s % 4)::DOUBLE AS rest FROM p"
)
def formula_missing_values(spark, sf_dir):
    """What is missing stays missing in numbers, and makes comparisons false."""
    df = table(spark, sf_dir, "part").withColumn("s", F.when(F.col("p_size") == 10, F.lit(float("nan"))).otherwise(F.col("p_size").cast("double")))
    m = from_formula("np.minimum(s, 20) + {s > 5} + {s != 7} + {s % 4}", df, row_id="p_partkey")
    return m.set_names(["least_", "over", "other", "rest"]).to_wide()


# (l_discount + l_tax + l_linestatus) ** 2: columns 0 l_discount, 1 l_tax, 2-3 status, 4 l_discount:l_tax, 5-6 l_discount:status, 7-8 l_tax:status
_STATUS = CODE_STATUS.replace("THEN 5", "THEN 2").replace("THEN 6", "THEN 3")


@query(
    f"SELECT j::INTEGER AS j, value FROM ({rmatvec_sql({0: 'l_discount', 1: 'l_tax', 4: 'l_discount * l_tax'}, [(_STATUS, 2, 2)], D, 'lineitem')} "
    f"UNION ALL {rmatvec_sql({}, [(_STATUS.replace('THEN 2', 'THEN 5').replace('THEN 3', 'THEN 6'), 5, 2)], f'{D} * l_discount', 'lineitem')} "
    f"UNION ALL {rmatvec_sql({}, [(_STATUS.replace('THEN 2', 'THEN 7').replace('THEN 3', 'THEN 8'), 7, 2)], f'{D} * l_tax', 'lineitem')})"
)
def formula_power_of_terms(spark, sf_dir):
    return from_formula("(l_discount + l_tax + l_linestatus) ** 2", lineitem(spark, sf_dir)).transpose_matvec(D, exact=True)


_FLAG = CODE_FLAG.replace("THEN 2", "THEN 0").replace("THEN 3", "THEN 1").replace("THEN 4", "THEN 2")


@query(f"SELECT j::INTEGER AS j, value FROM ({rmatvec_sql({}, [(_FLAG, 0, 3)], D, 'lineitem')} UNION ALL {rmatvec_sql({}, [(CODE_FLAG.replace('THEN 4', 'THEN 5').replace('THEN 3', 'THEN 4').replace('THEN 2', 'THEN 3'), 3, 3)], f'{D} * l_tax', 'lineitem')})")
def formula_nested_terms(spark, sf_dir):
    """a / b is a + a:b."""
    return from_formula("l_returnflag / l_tax", lineitem(spark, sf_dir)).transpose_matvec(D, exact=True)


@query(f"SELECT j::INTEGER AS j, value FROM ({rmatvec_sql({0: 'l_discount', 1: 'l_tax'}, [(_STATUS, 2, 2)], D, 'lineitem')}) UNION ALL SELECT -1, {S(f'{D} * l_extendedprice')} FROM lineitem")
def formula_all_other_columns(spark, sf_dir):
    """. stands for the columns that the left side leaves."""
    df = lineitem(spark, sf_dir).select("l_extendedprice", "l_discount", "l_tax", "l_linestatus", F.col(D).alias("w"))
    left, right = from_formula("l_extendedprice ~ . - w", df)
    sums = right.transpose_matvec("w", exact=True)
    return sums.unionAll(left.transpose_matvec("w", exact=True).withColumn("j", F.lit(-1)))


@stateful_transform
def _years(x, state, df):
    """Indicators of the years with data, of the first frame it sees; none once all of them are over."""
    found = sorted(r[0] for r in df.select(F.year(x)).distinct().collect() if r[0] is not None)
    if "years" not in state:
        state["years"] = found
    return [(str(y), (F.year(x) == y).cast("double")) for y in state["years"]] if set(found) & set(state["years"]) else []


@query(f"WITH y AS (SELECT count(DISTINCT year(o_orderdate)) AS n FROM orders) SELECT 0 AS j, {S('o_totalprice')} AS value FROM orders UNION ALL SELECT unnest(range(1, n + 1))::INTEGER, 0.0 FROM y")
def formula_replay_emptied_term(spark, sf_dir):
    """A term that gives no column on new rows is zero in the columns that it had."""
    orders = table(spark, sf_dir, "orders")
    trained = from_formula("o_totalprice + years(o_orderdate)", orders, context={"years": _years})
    later = orders.withColumn("o_orderdate", F.expr("o_orderdate + INTERVAL 100 YEAR"))
    return trained.spec.get_model_matrix(later).transpose_matvec(F.lit(1.0), exact=True)
