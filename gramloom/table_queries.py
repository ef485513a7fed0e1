"""Queries for rows by place, vectors as tables, masks of blocks, one-pass moments and several vectors at once."""

from __future__ import annotations

import warnings
from dataclasses import replace

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from . import accumulate, arranged, from_csc, from_formula, from_pandas, hstack, single_categorical
from .operators.moments import moments
from .operators.pairs import interaction, product_numbers, with_interaction
from .operators.tiles import TiledMatrix
from .operators.vectors import matvec_table, standardize_table
from .plans.spread import spread
from .queries import CODE_FLAG, CODE_STATUS, D, NUM_SQL, S, cells_sql, lineitem, query, rmatvec_sql, split, table
from .sources import dense, packed

# -- rows by place ---------------------------------------------------------------

_PLACED = "e AS (SELECT row_number() OVER (ORDER BY ts, event_id) - 1 AS r, count(*) OVER () AS n, value, user_id, event_type FROM events)"


def _placed_events(spark, sf_dir):
    """value, user_id and the event types, in order of time."""
    df = table(spark, sf_dir, "events")
    m = hstack([dense(df, ["value", "user_id"]), single_categorical(df, "event_type")])
    return m.numbered(["ts", "event_id"])


@query(f"""WITH {_PLACED}, p AS (SELECT r AS place, n - 1 - r AS "row" FROM e UNION ALL SELECT n + r, r // 2 FROM e)
SELECT place, CASE WHEN event_type = (SELECT min(event_type) FROM events) THEN 1.0 ELSE 0.0 END AS first_type, user_id::DOUBLE AS user_id, value FROM p JOIN e ON p."row" = e.r""")
def take_rows_outer(spark, sf_dir):
    """All rows backwards, then each row of the first half twice, for columns out of order."""
    m = _placed_events(spark, sf_dir)
    n = m.df.count()
    places = spark.range(2 * n).select(F.col("id").alias("place"), F.when(F.col("id") < n, n - 1 - F.col("id")).otherwise(F.expr(f"(id - {n}) DIV 2")).alias("row"))
    return m.take(places, [2, 1, 0]).set_names(["first_type", "user_id", "value"]).to_wide().withColumnRenamed("_row", "place")


@query(f"WITH {_PLACED}, p AS (SELECT unnest([0, 1, 2, 3]) AS place, unnest([7, 3, 3, -1]) AS k) SELECT place::BIGINT AS place, value FROM p, e WHERE r = CASE WHEN k < 0 THEN n + k ELSE k END")
def take_rows_list(spark, sf_dir):
    return _placed_events(spark, sf_dir)[[7, 3, 3, -1], [0]].to_wide().withColumnRenamed("_row", "place")


@query(f"WITH {_PLACED}, x AS (SELECT r, value FROM e WHERE r % 3 = 0) SELECT 0 AS i, 0 AS j, {S('(r % 10) * value * value')} AS value FROM x")
def take_rows_sandwich(spark, sf_dir):
    """Every third row by place, weighted by a vector that is given by the new places."""
    m = _placed_events(spark, sf_dir)
    n = m.df.count()
    third = m.take(spark.range((n + 2) // 3).select(F.col("id").alias("place"), (3 * F.col("id")).alias("row")), [0])
    weights = spark.range((n + 2) // 3).select("id", (3 * F.col("id") % 10).cast("double").alias("value"))
    return third.with_row_vector(weights, "weight").sandwich("weight", exact=True)


@query("""WITH a AS (SELECT row_number() OVER (ORDER BY o_orderkey) - 1 AS r, o_totalprice FROM orders), b AS (SELECT row_number() OVER (ORDER BY o_orderkey DESC) - 1 AS r, o_custkey FROM orders)
SELECT r AS row_id, 2.0 * o_totalprice - o_custkey AS value FROM a JOIN b USING (r)""")
def hstack_by_place(spark, sf_dir):
    """Two matrices without common ids side by side, by place."""
    orders = table(spark, sf_dir, "orders")
    a = dense(orders.select("o_orderkey", "o_totalprice"), ["o_totalprice"]).numbered(["o_orderkey"], "row_a")
    b = dense(orders.select("o_orderkey", "o_custkey"), ["o_custkey"]).numbered([F.desc("o_orderkey")], "row_b")
    return hstack([a, b], by_place=True).matvec([2.0, -1.0])


# -- vectors as tables --------------------------------------------------------------


@query(f"SELECT 0 AS j, {S('o_totalprice * coalesce(c_acctbal, 0)')} AS value FROM orders LEFT JOIN customer ON o_custkey = c_custkey")
def row_vector_from_table(spark, sf_dir):
    orders, customer = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    vector = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"), "left").select("o_orderkey", F.coalesce("c_acctbal", F.lit(0.0)))
    m = dense(orders, ["o_totalprice"], "o_orderkey").with_row_vector(vector, "balance")
    return m.transpose_matvec("balance", exact=True)


@query("SELECT l_orderkey AS row_id, 3.0 * l_discount + coalesce(p_retailprice, 0) + CASE WHEN l_linestatus = 'O' THEN 2.0 ELSE 0.0 END AS value FROM lineitem LEFT JOIN part ON l_partkey = p_partkey")
def matvec_from_table(spark, sf_dir):
    """A vector with an entry for every part: none of it on the driver but those of the other columns."""
    df = lineitem(spark, sf_dir).withColumn("discount", F.col("l_discount"))
    m = replace(hstack([dense(df, ["l_discount"]), single_categorical(df, "l_linestatus", ("F", "O"))]), row_id="l_orderkey")
    parts = single_categorical(df, "l_partkey")
    m = replace(parts, blocks=(*m.blocks, *parts.blocks), row_id="l_orderkey")
    price = parts.blocks[0].levels.df.join(table(spark, sf_dir, "part"), F.col("level") == F.col("p_partkey"), "left").select((F.col("code") + 3).alias("j"), F.coalesce("p_retailprice", F.lit(0.0)).alias("value"))
    return matvec_table(m, price.unionAll(spark.createDataFrame([(0, 3.0), (1, 0.0), (2, 2.0)], "j int, value double")))


_SUPP = "c AS (SELECT l_suppkey AS k, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS code, l_extendedprice, l_tax, l_quantity FROM lineitem)"


@query(f"""WITH {_SUPP}, w AS (SELECT sum(l_quantity) AS w FROM c),
m AS (SELECT code + 1 AS j, sum(l_quantity) / any_value(w) AS mean FROM c, w GROUP BY code),
n AS (SELECT 0 AS j, sum(l_quantity * l_tax) / any_value(w) AS mean FROM c, w),
s AS (SELECT j, mean, sqrt(mean - mean * mean) AS std FROM m UNION ALL SELECT 0, any_value(mean), sqrt(sum(l_quantity * (l_tax - mean) ** 2) / any_value(w)) FROM c, n, w),
x AS (SELECT code + 1 AS j, sum(l_discount) AS x FROM (SELECT *, l_tax * 2 AS l_discount FROM c) GROUP BY code UNION ALL SELECT 0, sum(l_tax * l_tax * 2) FROM c)
SELECT j::INTEGER AS j, round((x - mean * (SELECT sum(l_tax * 2) FROM c)) / std, 4) AS value FROM s JOIN x USING (j)""")
def standardize_by_table(spark, sf_dir):
    """Means and deviations of a long factor stay a table, and so does the view made of them."""
    df = lineitem(spark, sf_dir)
    keys = single_categorical(df, "l_suppkey")
    m = replace(keys, blocks=(*dense(df, ["l_tax"]).blocks, *keys.blocks))
    view, _ = standardize_table(m, D)
    return view.transpose_matvec(F.col("l_tax") * 2).withColumn("value", F.round("value", 4))


@query(f"""WITH c AS (SELECT n_regionkey AS k, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS code, s_acctbal FROM supplier JOIN nation ON s_nationkey = n_nationkey),
m AS (SELECT code + 1 AS j, count(*) / (SELECT count(*) FROM c) AS mean FROM c GROUP BY code UNION ALL SELECT 0, avg(s_acctbal) FROM c),
s AS (SELECT j, mean, CASE WHEN j = 0 THEN (SELECT stddev_pop(s_acctbal) FROM c) ELSE sqrt(mean - mean * mean) END AS std FROM m),
z AS (SELECT row_number() OVER () AS r, j, ((CASE WHEN j = 0 THEN s_acctbal WHEN code + 1 = j THEN 1 ELSE 0 END) - mean) / std AS v FROM c, s)
SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, round(sum(a.v * b.v), 4) AS value
FROM (SELECT s_suppkey, j, ((CASE WHEN j = 0 THEN s_acctbal WHEN code + 1 = j THEN 1 ELSE 0 END) - mean) / std AS v FROM (SELECT s_suppkey, s_acctbal, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey), s) a
JOIN (SELECT s_suppkey, j, ((CASE WHEN j = 0 THEN s_acctbal WHEN code + 1 = j THEN 1 ELSE 0 END) - mean) / std AS v FROM (SELECT s_suppkey, s_acctbal, dense_rank() OVER (ORDER BY n_regionkey) - 1 AS code FROM supplier JOIN nation ON s_nationkey = n_nationkey), s) b USING (s_suppkey) GROUP BY 1, 2""")
def standardized_sandwich_by_table(spark, sf_dir):
    df = table(spark, sf_dir, "supplier").join(table(spark, sf_dir, "nation"), F.col("s_nationkey") == F.col("n_nationkey")).withColumn("one", F.lit(1.0))
    keys = single_categorical(df, "n_regionkey")
    m = replace(keys, blocks=(*dense(df, ["s_acctbal"]).blocks, *keys.blocks))
    view, _ = standardize_table(m, "one")
    return view.sandwich("one").withColumn("value", F.round("value", 4))


# -- moments in one pass --------------------------------------------------------------


@query(f"""WITH {_SUPP}, w AS (SELECT sum(l_quantity) AS w FROM c),
m AS (SELECT code, sum(l_quantity) AS here, sum(l_quantity * l_tax) / any_value(w) AS mean FROM c, w GROUP BY code),
t AS (SELECT code, sum(l_quantity * (l_tax - mean) ** 2) + any_value(mean) ** 2 * (any_value(w) - any_value(here)) AS m2 FROM c JOIN m USING (code), w GROUP BY code)
SELECT code::INTEGER AS j, round(sqrt(m2 / w), 9) AS value FROM t, w""")
def col_stds_scaled_levels(spark, sf_dir):
    """Deviations of every column of a long factor times l_tax: one pass."""
    m = single_categorical(lineitem(spark, sf_dir), "l_suppkey").multiply("l_tax")
    return m.col_stds(D).withColumn("value", F.round("value", 9))


@query("""WITH w AS (SELECT sum(l_quantity) AS w FROM lineitem), x AS (SELECT l_quantity, 1000000 + l_discount AS a, CASE WHEN l_returnflag = 'A' THEN 1.0 ELSE 0.0 END AS b, CASE WHEN l_returnflag = 'N' THEN 1.0 ELSE 0.0 END AS c, CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE 0.0 END AS d FROM lineitem),
l AS (UNPIVOT (SELECT l_quantity, a, b, c, d FROM x) ON a, b, c, d INTO NAME n VALUE v), m AS (SELECT n, sum(l_quantity * v) / any_value(w) AS mean FROM l, w GROUP BY n)
SELECT (ascii(n) - 97)::INTEGER AS j, round(any_value(w), 3) AS weight, round(any_value(mean), 7) AS mean, round(sum(l_quantity * (v - mean) ** 2) / any_value(w), 9) AS variance FROM l JOIN m USING (n), w GROUP BY n""")
def moments_far_from_zero(spark, sf_dir):
    """Weight, mean and variance of a column far from zero and of a factor; nothing cancels."""
    df = lineitem(spark, sf_dir).withColumn("far", F.col("l_discount") + 1_000_000)
    m = hstack([dense(df, ["far"]), single_categorical(df, "l_returnflag")])
    return moments(m, D).select("j", F.round("weight", 3).alias("weight"), F.round("mean", 7).alias("mean"), F.round(F.col("m2") / F.col("weight"), 9).alias("variance"))


# -- several vectors in one pass -------------------------------------------------------

_VECTORS = [f"l_tax * {k + 1}" for k in range(8)]


@query("WITH c AS (SELECT *, dense_rank() OVER (ORDER BY l_partkey) - 1 AS code FROM lineitem) " + " UNION ALL ".join(f"SELECT (code + 4)::INTEGER AS j, {k} AS k, {S(v)} AS value FROM c GROUP BY code UNION ALL SELECT 0, {k}, {S(f'l_discount * ({v})')} FROM c UNION ALL SELECT {CODE_FLAG.replace('THEN 2', 'THEN 1').replace('THEN 3', 'THEN 2').replace('THEN 4', 'THEN 3')}, {k}, {S(v)} FROM c GROUP BY 1" for k, v in enumerate(_VECTORS)))
def rmatvec_eight_vectors(spark, sf_dir):
    """X'V for eight vectors over a number, a short and a long factor: three passes, as for one vector."""
    df = lineitem(spark, sf_dir)
    parts = single_categorical(df, "l_partkey")
    m = replace(parts, blocks=(*dense(df, ["l_discount"]).blocks, *single_categorical(df, "l_returnflag").blocks, *parts.blocks))
    return m.transpose_matmul([F.expr(v) for v in _VECTORS], exact=True)


_LOOK = {k: [0.5 * (j + 1) - k for j in range(7)] for k in range(3)}


@query(" UNION ALL ".join(f"SELECT l_orderkey AS row_id, {k} AS k, round({v[0]} * l_discount + {v[1]} * l_tax + CASE {CODE_FLAG} WHEN 2 THEN {v[2]} WHEN 3 THEN {v[3]} ELSE {v[4]} END + CASE {CODE_STATUS} WHEN 5 THEN {v[5]} ELSE {v[6]} END, 9) AS value FROM lineitem" for k, v in _LOOK.items()))
def matmul_one_pass(spark, sf_dir):
    m = replace(split(spark, sf_dir), row_id="l_orderkey")
    return m.matmul(np.array([_LOOK[k] for k in range(3)]).T).withColumn("value", F.round("value", 9))


# -- masks of categorical blocks ----------------------------------------------------------

_PARTS = "c AS (SELECT *, dense_rank() OVER (ORDER BY l_partkey) - 1 AS code FROM lineitem), p AS (SELECT max(code) + 1 AS p FROM c)"


@query(f"WITH {_PARTS} SELECT (CASE WHEN code >= 50 THEN code - 50 ELSE p - 100 + code END)::INTEGER AS j, {S('l_quantity * l_tax')} AS value FROM c, p WHERE code < 50 OR code BETWEEN 50 AND p - 51 GROUP BY 1")
def select_level_ranges(spark, sf_dir):
    """Columns of a long factor by ranges, out of order: one block with moved codes."""
    m = single_categorical(lineitem(spark, sf_dir), "l_partkey")
    return m.select([*range(50, m.n_columns - 50), *range(50)]).transpose_matvec(F.col("l_quantity") * F.col("l_tax"), exact=True)


@query(f"WITH {_PARTS} SELECT (code // 3)::INTEGER AS i, (code // 3)::INTEGER AS j, {S('l_quantity')} AS value FROM c WHERE code % 3 = 0 GROUP BY code")
def select_level_list(spark, sf_dir):
    """Every third column of a long factor: more runs than an expression holds, so codes are joined."""
    m = single_categorical(lineitem(spark, sf_dir), "l_partkey")
    return m.select(range(0, m.n_columns, 3)).sandwich(D, exact=True)


@query(f"WITH {_PARTS} SELECT l_orderkey AS row_id, CASE WHEN code = 7 THEN 1.0 ELSE 0.0 END AS value FROM c")
def getcol_long_factor(spark, sf_dir):
    m = replace(single_categorical(lineitem(spark, sf_dir), "l_partkey"), row_id="l_orderkey")
    return m.getcol(7).matvec([1.0])

# -- sparse matrices in tiles ------------------------------------------------------------


def _tiled(spark, sf_dir, **how):
    """Order keys by part keys, both growing with the table, the sum of discounts in each cell."""
    df = lineitem(spark, sf_dir)
    cells = spread(df, df.count(), "l_orderkey").groupBy(F.col("l_orderkey").alias("i"), F.col("l_partkey").alias("j")).agg(F.sum("l_discount").alias("value"))
    n, p = df.agg(F.max("l_orderkey") + 1, F.max("l_partkey") + 1).first()
    return TiledMatrix.from_coo(cells, n, p, **how)


_CELLS_SQL = "x AS (SELECT l_orderkey AS i, l_partkey AS j, sum(l_discount) AS value FROM lineitem GROUP BY 1, 2 HAVING sum(l_discount) <> 0)"


@query(f"WITH {_CELLS_SQL}, d AS (SELECT o_orderkey AS i, o_totalprice AS x FROM orders) SELECT a.j AS i, b.j AS j, round(sum(a.value * b.value * x), 6) AS value FROM x a JOIN x b USING (i) JOIN d USING (i) GROUP BY 1, 2")
def tiled_sandwich(spark, sf_dir):
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    return _tiled(spark, sf_dir).sandwich(d).withColumn("value", F.round("value", 6))


@query(f"WITH {_CELLS_SQL}, d AS (SELECT o_orderkey AS i, o_totalprice AS x FROM orders WHERE o_orderstatus = 'F') SELECT a.j AS i, b.j AS j, round(sum(a.value * b.value * x), 6) AS value FROM x a JOIN x b USING (i) JOIN d USING (i) WHERE a.j IN (SELECT p_partkey FROM part WHERE p_size < 10) AND b.j IN (SELECT p_partkey FROM part WHERE p_size < 10) GROUP BY 1, 2")
def tiled_sandwich_rows_cols(spark, sf_dir):
    """Columns cut into blocks, and both restrictions as tables."""
    d = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    m = _tiled(spark, sf_dir, col_block=500)
    rows = table(spark, sf_dir, "orders").filter("o_orderstatus = 'F'").select("o_orderkey")
    cols = table(spark, sf_dir, "part").filter("p_size < 10").select("p_partkey")
    return m.sandwich(d, rows, cols).withColumn("value", F.round("value", 6))


@query(f"WITH {_CELLS_SQL}, y AS (SELECT p_partkey AS j, p_size AS k, p_retailprice AS r FROM part) SELECT i, k::BIGINT AS j, round(sum(value * r), 4) AS value FROM x JOIN y USING (j) GROUP BY 1, 2")
def tiled_dot(spark, sf_dir):
    """Orders by parts times parts by sizes."""
    part = table(spark, sf_dir, "part")
    p = part.agg(F.max("p_partkey")).first()[0] + 1
    m = _tiled(spark, sf_dir)
    sizes = TiledMatrix.from_coo(part.select(F.col("p_partkey").alias("i"), F.col("p_size").alias("j"), F.col("p_retailprice").alias("value")), max(p, m.n_columns), 100)
    wide = TiledMatrix(m.tiles, m.n_rows, sizes.n_rows, m.row_block, m.col_block)
    return wide.dot(sizes).withColumn("value", F.round("value", 4))


@query(f"WITH {_CELLS_SQL} SELECT i AS row_id, round(sum(value * p_retailprice), 4) AS value FROM x JOIN part ON j = p_partkey WHERE i % 2 = 0 AND p_size > 25 GROUP BY 1")
def tiled_matvec_rows_cols(spark, sf_dir):
    part = table(spark, sf_dir, "part")
    even = table(spark, sf_dir, "orders").filter("o_orderkey % 2 = 0").select("o_orderkey").unionAll(lineitem(spark, sf_dir).filter("l_orderkey % 2 = 0").select("l_orderkey"))
    return _tiled(spark, sf_dir).matvec(part.select("p_partkey", "p_retailprice"), even, part.filter("p_size > 25").select("p_partkey")).withColumn("value", F.round("value", 4))


@query(f"WITH {_CELLS_SQL} SELECT j, round(sum(value * o_totalprice), 4) AS value FROM x JOIN orders ON i = o_orderkey GROUP BY 1")
def tiled_rmatvec(spark, sf_dir):
    return _tiled(spark, sf_dir).transpose_matvec(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")).withColumn("value", F.round("value", 4))

# -- interactions of factors with many levels ------------------------------------------------

_PAIRS = "c AS (SELECT *, dense_rank() OVER (ORDER BY l_suppkey, l_partkey) - 1 AS code, dense_rank() OVER (ORDER BY l_partkey) - 1 AS p, dense_rank() OVER (ORDER BY l_suppkey) - 1 AS s FROM lineitem)"


@query(f"WITH {_PAIRS} SELECT code::BIGINT AS j, {S('l_quantity * l_tax')} AS value FROM c GROUP BY code")
def interaction_rmatvec(spark, sf_dir):
    """Suppliers by parts: a column for each pair that occurs, summed by the pair."""
    return interaction(lineitem(spark, sf_dir), ["l_suppkey", "l_partkey"]).transpose_matvec(F.col("l_quantity") * F.col("l_tax"), exact=True)


@query(f"WITH {_PAIRS} SELECT (s + p * (SELECT max(s) + 1 FROM c))::BIGINT AS full, {S(D)} AS value FROM c GROUP BY s, p")
def interaction_product_numbers(spark, sf_dir):
    """The same sums under the numbers that the full product has."""
    df = lineitem(spark, sf_dir)
    m = interaction(df, ["l_suppkey", "l_partkey"])
    factors = [single_categorical(df, c).blocks[0].levels for c in ("l_suppkey", "l_partkey")]
    return spread(m.transpose_matvec(D, exact=True), m.n_columns, "j").join(product_numbers(m, factors), "j").select("full", "value")


@query(f"""WITH f AS (SELECT *, l_suppkey > (SELECT min(l_suppkey) FROM lineitem) AS kept FROM lineitem),
k AS (SELECT l_suppkey, l_returnflag, row_number() OVER (ORDER BY l_suppkey, l_returnflag) AS j FROM (SELECT DISTINCT l_suppkey, l_returnflag FROM f WHERE kept)),
x AS (SELECT f.*, k.j FROM f LEFT JOIN k USING (l_suppkey, l_returnflag))
SELECT 0 AS i, 0 AS j, {S(f'{D} * l_tax * l_tax')} AS value FROM x UNION ALL SELECT j, j, {S(D)} FROM x WHERE j IS NOT NULL GROUP BY j
UNION ALL SELECT 0, j, {S(f'{D} * l_tax')} FROM x WHERE j IS NOT NULL GROUP BY j UNION ALL SELECT j, 0, {S(f'{D} * l_tax')} FROM x WHERE j IS NOT NULL GROUP BY j""")
def interaction_sandwich(spark, sf_dir):
    """A number beside a reduced interaction."""
    m = with_interaction(dense(lineitem(spark, sf_dir), ["l_tax"]), ["l_suppkey", "l_returnflag"], reduced=["l_suppkey"])
    return m.sandwich(D, exact=True)


@query(f"""WITH {_PAIRS}, k AS (SELECT s, p, row_number() OVER (ORDER BY p, s) AS j FROM (SELECT DISTINCT s, p FROM c))
SELECT 0::BIGINT AS j, {S(f'{D} * l_discount')} AS value FROM c UNION ALL SELECT any_value(j)::BIGINT, {S(f'{D} * l_tax')} FROM c JOIN k USING (s, p) GROUP BY s, p""")
def formula_observed_interaction(spark, sf_dir):
    """A formula's interaction of two long factors and a number, for pairs that occur only."""
    df = lineitem(spark, sf_dir)
    m = from_formula("l_discount + C(l_suppkey):C(l_partkey):l_tax", df.withColumn("l_suppkey", F.format_string("%09d", "l_suppkey")).withColumn("l_partkey", F.format_string("%09d", "l_partkey")), interactions="observed")
    return m.transpose_matvec(D, exact=True)

# -- packed columns, places of columns ---------------------------------------------------------


@query("""WITH e AS (SELECT vec_id, label, unnest(embedding)::DOUBLE AS x, unnest(range(0, len(embedding))) AS j FROM embeddings)
SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, round(sum(a.x * b.x * (1 + a.label % 3)), 6) AS value FROM e a JOIN e b USING (vec_id) GROUP BY 1, 2""")
def packed_gram(spark, sf_dir):
    """The weighted Gram of an array column, read as one buffer."""
    df = table(spark, sf_dir, "embeddings").withColumn("weight", (1 + F.col("label") % 3).cast("double"))
    return packed(df, "embedding", row_id="vec_id").sandwich("weight").withColumn("value", F.round("value", 6))


_ARRANGED = "CASE l_returnflag WHEN 'A' THEN 0 WHEN 'N' THEN 2 WHEN 'R' THEN 3 END"


@query(rmatvec_sql({1: "l_tax", 4: "l_discount"}, [(_ARRANGED.replace("WHEN 'N' THEN 2 WHEN 'R' THEN 3 ", ""), 0, 1), (_ARRANGED.replace("WHEN 'A' THEN 0 ", ""), 2, 2)], D, "lineitem"))
def arranged_columns(spark, sf_dir):
    """A number between the columns of a factor, and one behind them."""
    df = lineitem(spark, sf_dir)
    return arranged([dense(df, ["l_discount", "l_tax"]), single_categorical(df, "l_returnflag", ("A", "N", "R"))], [[4, 1], [0, 2, 3]]).transpose_matvec(D, exact=True)


@query(f"SELECT 0 AS j, {S('s_acctbal * s_acctbal')} AS value FROM supplier UNION ALL SELECT 1 + s_nationkey, {S('s_acctbal')} FROM supplier GROUP BY s_nationkey UNION ALL SELECT 1 + n_nationkey, 0 FROM nation WHERE n_nationkey NOT IN (SELECT s_nationkey FROM supplier)")
def from_pandas_frame(spark, sf_dir):
    """A pandas frame with a declared categorical."""
    pdf = table(spark, sf_dir, "supplier").select("s_acctbal", F.format_string("n%02d", "s_nationkey").alias("nation")).toPandas()
    nations = sorted(r[0] for r in table(spark, sf_dir, "nation").select(F.format_string("n%02d", "n_nationkey")).collect())
    pdf["nation"] = pd.Categorical(pdf["nation"], categories=nations)
    with warnings.catch_warnings():
        warnings.simplefilter("ignore", DeprecationWarning)
        m = from_pandas(spark, pdf)
    return m.transpose_matvec("s_acctbal", exact=True)


# -- triplets as dense rows -----------------------------------------------------------------------


@query(f"WITH x AS (SELECT l_orderkey AS i, l_linenumber AS j, sum(l_discount) AS v FROM lineitem GROUP BY 1, 2) SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, {S('(a.i % 5) * a.v * b.v')} AS value FROM x a JOIN x b USING (i) GROUP BY 1, 2")
def from_csc_keys(spark, sf_dir):
    """Order keys by line numbers: one row for each order key."""
    cells = lineitem(spark, sf_dir).select(F.col("l_orderkey").alias("i"), F.col("l_linenumber").alias("j"), F.col("l_discount").alias("value"))
    n, p = (cells.agg(F.max(c)).first()[0] + 1 for c in ("i", "j"))
    return from_csc(cells, n, p).sandwich((F.col("row") % 5).cast("double"), exact=True).filter("i > 0 AND j > 0")

# -- restrictions that leave nothing ----------------------------------------------------------------


@query(f"SELECT j::INTEGER AS j, coalesce((SELECT {S('l_quantity * l_tax')} FROM lineitem WHERE l_quantity > 1e6), 0) AS value FROM (SELECT unnest(range(0, 7)) AS j)")
def rmatvec_no_row_passes(spark, sf_dir):
    """A predicate that no row of the table meets leaves zeros in every column."""
    return split(spark, sf_dir).transpose_matvec(F.col("l_quantity") * F.col("l_tax"), rows="l_quantity > 1e6", exact=True)


@query(cells_sql(NUM_SQL, [CODE_FLAG, CODE_STATUS], D, "lineitem"))
def sandwich_and_no_columns(spark, sf_dir):
    """A sandwich of no columns adds nothing to one of all."""
    m = split(spark, sf_dir)
    return accumulate(m.sandwich(D, exact=True), m.sandwich(D, cols=[], exact=True), exact=True)
