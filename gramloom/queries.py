"""Every operator as a query over the given tables, with the same result as DuckDB SQL.

Reductions run with ``exact=True`` here, so that sums match whatever the order of rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import accumulate, from_csc, from_coo, from_df, from_formula, hstack, single_categorical
from .functions.levels import observe
from .operators import DesignMatrix, StandardizedView
from .plans.spread import spread
from .sources import dense

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

D = "l_quantity"
NUM = ("l_discount", "l_tax")
FLAGS, STATUS = ("A", "N", "R"), ("F", "O")
EVENTS = ("click", "error", "purchase", "signup", "view")
V5 = (0.5, -1.25, 2.0, 3.5, -0.75)


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lineitem(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem")


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events")


def event_types(df: DataFrame) -> list[str]:
    """The levels of event_type as observed."""
    return observe(df, ["event_type"])["event_type"][0]


def split(spark: SparkSession, sf_dir: str, drop_first: bool = False) -> DesignMatrix:
    """discount, tax, return flag (3 columns), line status (2 columns)."""
    df = lineitem(spark, sf_dir)
    a = single_categorical(df, "l_returnflag", FLAGS, drop_first)
    b = single_categorical(df, "l_linestatus", STATUS, drop_first)
    return hstack([dense(df, NUM), a, b])


# -- SQL helpers ---------------------------------------------------------------


def S(x: str) -> str:
    return f"sum(({x})::DECIMAL(24,6))::DOUBLE"


def code_sql(column: str, levels: tuple, first: int) -> str:
    return "CASE " + column + " " + " ".join(f"WHEN '{x}' THEN {first + i}" for i, x in enumerate(levels)) + " END"


def cells_sql(numeric: dict[int, str], cats: list[str], d: str, source: str) -> str:
    """Both triangles of a sandwich; ``cats`` are code expressions already offset."""
    out = []
    for i, x in numeric.items():
        out += [f"SELECT {i} AS i, {j} AS j, coalesce({S(f'{d} * {x} * {y}' if i <= j else f'{d} * {y} * {x}')}, 0) AS value FROM {source}" for j, y in numeric.items()]
    for k, c in enumerate(cats):
        out.append(f"SELECT {c} AS i, {c} AS j, {S(d)} AS value FROM {source} WHERE {c} IS NOT NULL GROUP BY 1, 2")
        for j, x in numeric.items():
            out.append(f"SELECT {c} AS i, {j} AS j, {S(f'{d} * {x}')} AS value FROM {source} WHERE {c} IS NOT NULL GROUP BY 1")
            out.append(f"SELECT {j} AS i, {c} AS j, {S(f'{d} * {x}')} AS value FROM {source} WHERE {c} IS NOT NULL GROUP BY 2")
        for h, e in enumerate(cats):
            if h != k:
                out.append(f"SELECT {c} AS i, {e} AS j, {S(d)} AS value FROM {source} WHERE {c} IS NOT NULL AND {e} IS NOT NULL GROUP BY 1, 2")
    return "SELECT i::INTEGER AS i, j::INTEGER AS j, value FROM (" + " UNION ALL ".join(out) + ")"


def rmatvec_sql(numeric: dict[int, str], cats: list[tuple[str, int, int]], v: str, source: str) -> str:
    """(j, value); ``cats`` are (code expression, first number, width), absent levels 0."""
    out = [f"SELECT {j} AS j, coalesce({S(f'{x} * {v}')}, 0) AS value FROM {source}" for j, x in numeric.items()]
    for c, first, width in cats:
        out.append(f"SELECT r.j, coalesce(g.value, 0) AS value FROM (SELECT unnest(range({first}, {first + width})) AS j) r LEFT JOIN (SELECT {c} AS j, {S(v)} AS value FROM {source} GROUP BY 1) g ON r.j = g.j")
    return "SELECT j::INTEGER AS j, value::DOUBLE AS value FROM (" + " UNION ALL ".join(out) + ")"


NUM_SQL = {0: "l_discount", 1: "l_tax"}
CODE_FLAG, CODE_STATUS = code_sql("l_returnflag", FLAGS, 2), code_sql("l_linestatus", STATUS, 5)
SPLIT_CATS = [(CODE_FLAG, 2, 3), (CODE_STATUS, 5, 2)]


# -- matvec --------------------------------------------------------------------


@query("SELECT o_orderkey AS row_id, o_totalprice * 0.5::DOUBLE + o_custkey::DOUBLE * (-2.0)::DOUBLE AS value FROM orders")
def dense_matvec(spark, sf_dir):
    return dense(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey").matvec([0.5, -2.0])


@query("SELECT o_orderkey AS row_id, o_custkey::DOUBLE * (-2.0)::DOUBLE AS value FROM orders")
def dense_matvec_cols(spark, sf_dir):
    return dense(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey").matvec([0.5, -2.0], cols=[1])


_RANKED = "(SELECT e.*, r.code FROM events e LEFT JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events)) r USING (event_type))"
_LOOK = "CASE code " + " ".join(f"WHEN {i} THEN {v}" for i, v in enumerate(V5)) + " ELSE 0 END"


def _weights(levels: list, drop: int = 0) -> list[float]:
    return [V5[i] if i < len(V5) else 0.0 for i in range(len(levels))][drop:]


@query(f"SELECT event_id AS row_id, ({_LOOK})::DOUBLE AS value FROM {_RANKED}")
def cat_matvec(spark, sf_dir):
    m = single_categorical(events(spark, sf_dir), "event_type", row_id="event_id")
    return m.matvec(_weights(m.blocks[0].levels))


@query(f"SELECT event_id AS row_id, (CASE WHEN code = 0 THEN 0 ELSE {_LOOK} END)::DOUBLE AS value FROM {_RANKED}")
def cat_matvec_drop_first(spark, sf_dir):
    m = single_categorical(events(spark, sf_dir), "event_type", drop_first=True, row_id="event_id")
    return m.matvec(_weights(m.blocks[0].levels, 1))


@query("SELECT event_id AS row_id, (CASE WHEN event_type = 'error' THEN 0 ELSE 1.5 END)::DOUBLE AS value FROM events")
def cat_matvec_missing_zero(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("kind", F.expr("nullif(event_type, 'error')"))
    m = single_categorical(df, "kind", cat_missing_method="zero", row_id="event_id")
    return m.matvec([1.5] * m.n_columns)


@query(f"SELECT event_id AS row_id, value * 0.25::DOUBLE + ({_LOOK})::DOUBLE AS value FROM {_RANKED}")
def split_matvec(spark, sf_dir):
    df = events(spark, sf_dir)
    m = hstack([dense(df, ["value"], "event_id"), single_categorical(df, "event_type", row_id="event_id")])
    return m.matvec([0.25, *_weights(m.blocks[1].levels)])


@query("SELECT o_orderkey AS row_id, o_totalprice * (0.5::DOUBLE * 1.67::DOUBLE) + o_custkey::DOUBLE * (-2.0::DOUBLE * 0.6::DOUBLE) + (0.3::DOUBLE * 0.5::DOUBLE + 0.2::DOUBLE * -2.0::DOUBLE) AS value FROM orders")
def standardized_matvec(spark, sf_dir):
    m = dense(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey")
    return _view(m, [0.3, 0.2], [1.67, 0.6]).matvec([0.5, -2.0])


def _view(m: DesignMatrix, shift: list[float], mult: list[float]) -> StandardizedView:
    import numpy as np

    return StandardizedView(m, np.array(shift), np.array(mult))


# -- transpose_matvec ----------------------------------------------------------


@query(rmatvec_sql(NUM_SQL, [], D, "lineitem"))
def dense_rmatvec(spark, sf_dir):
    return dense(lineitem(spark, sf_dir), NUM).transpose_matvec(D, exact=True)


_ROWS = "l_shipdate < TIMESTAMP '1997-01-01 00:00:00'"


@query(rmatvec_sql(NUM_SQL, [], D, f"(SELECT * FROM lineitem WHERE {_ROWS})"))
def dense_rmatvec_rows(spark, sf_dir):
    return dense(lineitem(spark, sf_dir), NUM).transpose_matvec(D, rows=F.expr("l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'"), exact=True)


@query(rmatvec_sql({1: "l_tax"}, [], D, f"(SELECT * FROM lineitem WHERE {_ROWS})"))
def dense_rmatvec_rows_cols(spark, sf_dir):
    return dense(lineitem(spark, sf_dir), NUM).transpose_matvec(D, rows=F.expr("l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'"), cols=[1], exact=True)


@query(rmatvec_sql({}, [(code_sql("l_returnflag", FLAGS, 0), 0, 3)], D, "lineitem"))
def cat_rmatvec(spark, sf_dir):
    return single_categorical(lineitem(spark, sf_dir), "l_returnflag").transpose_matvec(D, exact=True)


@query(rmatvec_sql({}, [(code_sql("l_returnflag", FLAGS[1:], 0), 0, 2)], D, "lineitem"))
def cat_rmatvec_drop_first(spark, sf_dir):
    return single_categorical(lineitem(spark, sf_dir), "l_returnflag", drop_first=True).transpose_matvec(D, exact=True)


@query(f"SELECT (dense_rank() OVER (ORDER BY l_partkey) - 1)::INTEGER AS j, value FROM (SELECT l_partkey, {S(D)} AS value FROM lineitem GROUP BY 1)")
def cat_rmatvec_high_card(spark, sf_dir):
    return single_categorical(lineitem(spark, sf_dir), "l_partkey").transpose_matvec(D, exact=True)


@query(rmatvec_sql(NUM_SQL, SPLIT_CATS, D, "lineitem"))
def split_rmatvec(spark, sf_dir):
    return split(spark, sf_dir).transpose_matvec(D, exact=True)


SHIFT, MULT = [0.3, 0.2, 0.1, -0.1, 0.4, 0.5, -0.5], [0.6, 1.67, 1.5, 0.5, 0.75, 2.0, 1.25]
_SM = "(SELECT unnest(range(0, 7)) AS k, unnest([" + ", ".join(f"{m}::DOUBLE" for m in MULT) + "]) AS m, unnest([" + ", ".join(f"{s}::DOUBLE" for s in SHIFT) + "]) AS s)"


@query(f"SELECT j, m * value + s * (SELECT {S(D)} FROM lineitem) AS value FROM ({rmatvec_sql(NUM_SQL, SPLIT_CATS, D, 'lineitem')}) JOIN {_SM} ON j = k")
def standardized_rmatvec(spark, sf_dir):
    return _view(split(spark, sf_dir), SHIFT, MULT).transpose_matvec(D, exact=True)


# -- sandwich ------------------------------------------------------------------


@query(cells_sql(NUM_SQL, [], D, "lineitem"))
def dense_sandwich(spark, sf_dir):
    return dense(lineitem(spark, sf_dir), NUM).sandwich(D, exact=True)


@query(cells_sql({0: "l_discount", 2: "l_quantity"}, [], D, f"(SELECT * FROM lineitem WHERE {_ROWS})"))
def dense_sandwich_rows_cols(spark, sf_dir):
    return dense(lineitem(spark, sf_dir), [*NUM, D]).sandwich(D, rows=F.expr("l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'"), cols=[0, 2], exact=True)


_WIDE = [f"pow(l_discount + {0.01 * k!r}::DOUBLE, 2)" for k in range(16)]
_WIDE_SUMS = ", ".join(f"sum(l_quantity * x{i} * x{j}) AS g{i}_{j}" for i in range(16) for j in range(i, 16))
_WIDE_CELLS = " UNION ALL ".join(f"SELECT {i} AS i, {j} AS j, g{min(i, j)}_{max(i, j)} AS value FROM w" for i in range(16) for j in range(16))


@query(f"WITH x AS (SELECT l_quantity, {', '.join(f'{x} AS x{k}' for k, x in enumerate(_WIDE))} FROM lineitem), w AS (SELECT {_WIDE_SUMS} FROM x) SELECT i::INTEGER AS i, j::INTEGER AS j, round(value, 3) AS value FROM ({_WIDE_CELLS})")
def dense_sandwich_wide(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    wide = df.select("l_quantity", *[F.pow(F.col("l_discount") + 0.01 * k, F.lit(2)).alias(f"x{k}") for k in range(16)])
    return dense(wide, [f"x{k}" for k in range(16)]).sandwich(D).withColumn("value", F.round("value", 3))


@query(cells_sql({}, [code_sql("l_returnflag", FLAGS, 0)], D, "lineitem"))
def cat_sandwich(spark, sf_dir):
    return single_categorical(lineitem(spark, sf_dir), "l_returnflag").sandwich(D, exact=True)


@query(cells_sql({}, [code_sql("l_returnflag", FLAGS[1:], 0)], D, "lineitem"))
def cat_sandwich_drop_first(spark, sf_dir):
    return single_categorical(lineitem(spark, sf_dir), "l_returnflag", drop_first=True).sandwich(D, exact=True)


_CONVERT = "(SELECT e.*, coalesce(r.code, (SELECT count(DISTINCT event_type) - 1 FROM events)) AS k FROM events e LEFT JOIN (SELECT event_type, row_number() OVER (ORDER BY event_type) - 1 AS code FROM (SELECT DISTINCT event_type FROM events WHERE event_type <> 'error')) r USING (event_type))"


@query(cells_sql({}, ["k"], "value", _CONVERT))
def cat_sandwich_missing_convert(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("kind", F.expr("nullif(event_type, 'error')"))
    return single_categorical(df, "kind", cat_missing_method="convert").sandwich("value", exact=True)


def _cross(i: str, j: str) -> str:
    return f"SELECT * FROM ({cells_sql(NUM_SQL, [CODE_FLAG, CODE_STATUS], D, 'lineitem')}) WHERE {i} AND {j}"


@query(_cross("i BETWEEN 2 AND 4", "j BETWEEN 5 AND 6"))
def cross_cat_cat(spark, sf_dir):
    return split(spark, sf_dir).cross_sandwich(D, [2, 3, 4], [5, 6], exact=True)


@query(f"SELECT (p.k - 1)::INTEGER AS i, ((SELECT count(DISTINCT l_partkey) FROM lineitem) + s.k - 1)::INTEGER AS j, value FROM (SELECT l_partkey, l_suppkey, {S(D)} AS value FROM lineitem GROUP BY 1, 2) g JOIN (SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) AS k FROM (SELECT DISTINCT l_partkey FROM lineitem)) p USING (l_partkey) JOIN (SELECT l_suppkey, row_number() OVER (ORDER BY l_suppkey) AS k FROM (SELECT DISTINCT l_suppkey FROM lineitem)) s USING (l_suppkey)")
def cross_cat_cat_sparse(spark, sf_dir):
    m = _parts_and_suppliers(spark, sf_dir)
    cut = m.blocks[0].width
    return m.cross_sandwich(D, range(cut), range(cut, m.n_columns), exact=True)


def _parts_and_suppliers(spark, sf_dir) -> DesignMatrix:
    a = single_categorical(lineitem(spark, sf_dir), "l_partkey")
    b = single_categorical(a.df, "l_suppkey")
    return DesignMatrix(b.df, a.blocks + b.blocks, base=a.base)


_RANKED_PARTS = "(SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS k FROM (SELECT DISTINCT l_partkey FROM lineitem))"


@query(f"SELECT k::INTEGER AS i, k::INTEGER AS j, {S(D)} AS value FROM lineitem JOIN {_RANKED_PARTS} USING (l_partkey) GROUP BY k")
def cat_sandwich_high_card(spark, sf_dir):
    return single_categorical(lineitem(spark, sf_dir), "l_partkey").sandwich(D, exact=True)


@query(f"WITH p AS {_RANKED_PARTS}, x AS (SELECT k + 1 AS k, l_discount, {D} FROM lineitem JOIN p USING (l_partkey) WHERE k > 0) SELECT i::INTEGER AS i, j::INTEGER AS j, value FROM (SELECT 0 AS i, 0 AS j, {S(f'{D} * l_discount * l_discount')} AS value FROM lineitem UNION ALL SELECT k, k, {S(D)} FROM x GROUP BY k UNION ALL SELECT 0, k, {S(f'{D} * l_discount')} FROM x GROUP BY k UNION ALL SELECT k, 0, {S(f'{D} * l_discount')} FROM x GROUP BY k)")
def sandwich_active_cols(spark, sf_dir):
    """All columns of discount and parts but the first part's."""
    c = single_categorical(lineitem(spark, sf_dir), "l_partkey")
    m = DesignMatrix(c.df, (*dense(c.df, NUM[:1]).blocks, *c.blocks), base=c.base)
    return m.sandwich(D, cols=[0, *range(2, m.n_columns)], exact=True)


@query(f"SELECT j, k::INTEGER AS k, value FROM (SELECT j, 0 AS k, value FROM ({rmatvec_sql(NUM_SQL, SPLIT_CATS, D, 'lineitem')}) UNION ALL SELECT j, 1, value FROM ({rmatvec_sql(NUM_SQL, SPLIT_CATS, '(l_quantity * l_quantity)', 'lineitem')}))")
def split_rmatmul(spark, sf_dir):
    return split(spark, sf_dir).transpose_matmul([D, F.col(D) * F.col(D)], exact=True)


@query("SELECT o_orderkey AS row_id, k::INTEGER AS k, o_totalprice * a + o_custkey::DOUBLE * b AS value FROM orders CROSS JOIN (SELECT 0 AS k, 0.5::DOUBLE AS a, (-2.0)::DOUBLE AS b UNION ALL SELECT 1, 1.0, 4.0)")
def dense_matmul(spark, sf_dir):
    return dense(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey") @ [[0.5, 1.0], [-2.0, 4.0]]


def _rounded(sql: str) -> str:
    """The same sums in doubles, to five places: terms have four, so no order of adding meets a tie."""
    return f"SELECT * REPLACE (round(value, 5) AS value) FROM ({sql.replace('::DECIMAL(24,6)', '')})"


@query(_rounded(cells_sql(NUM_SQL, [CODE_FLAG, CODE_STATUS], D, "lineitem")))
def split_sandwich_double(spark, sf_dir):
    return split(spark, sf_dir).sandwich(D).withColumn("value", F.round("value", 5))


@query(_rounded(rmatvec_sql(NUM_SQL, SPLIT_CATS, D, "lineitem")))
def split_rmatvec_double(spark, sf_dir):
    return split(spark, sf_dir).transpose_matvec(D).withColumn("value", F.round("value", 5))


@query(_rounded(cells_sql({}, [code_sql("l_returnflag", FLAGS, 0)], "(l_quantity * l_tax * l_tax)", "lineitem")))
def cat_sandwich_scaled(spark, sf_dir):
    """Rows times tax: a categorical with a multiplier."""
    return single_categorical(lineitem(spark, sf_dir), "l_returnflag").multiply("l_tax").sandwich(D).withColumn("value", F.round("value", 5))


@query(_cross("i BETWEEN 2 AND 4", "j <= 1"))
def cross_cat_dense(spark, sf_dir):
    return split(spark, sf_dir).cross_sandwich(D, [2, 3, 4], [0, 1], exact=True)


_SPARSE = "(SELECT *, CASE WHEN l_quantity = 1 THEN l_tax ELSE 0 END AS sp FROM lineitem)"


def sparse_tax(spark, sf_dir) -> DataFrame:
    return lineitem(spark, sf_dir).withColumn("sp", F.expr("CASE WHEN l_quantity = 1 THEN l_tax ELSE 0D END"))


@query(f"SELECT * FROM ({cells_sql({0: 'l_discount', 1: 'sp'}, [], D, _SPARSE)}) WHERE i = 1 AND j = 0")
def cross_sparse_dense(spark, sf_dir):
    m = dense(sparse_tax(spark, sf_dir), ["l_discount", "sp"]).split_density(0.1)
    return m.cross_sandwich(D, [1], [0], exact=True)


@query(f"SELECT * FROM ({cells_sql({0: 'sp'}, [code_sql('l_returnflag', FLAGS, 1)], D, _SPARSE)}) WHERE i > 0 AND j = 0")
def cross_cat_sparse(spark, sf_dir):
    df = sparse_tax(spark, sf_dir)
    return hstack([dense(df, ["sp"]), single_categorical(df, "l_returnflag")]).cross_sandwich(D, [1, 2, 3], [0], exact=True)


@query(cells_sql(NUM_SQL, [CODE_FLAG, CODE_STATUS], D, "lineitem"))
def split_sandwich(spark, sf_dir):
    return split(spark, sf_dir).sandwich(D, exact=True)


@query(f"WITH g AS ({cells_sql(NUM_SQL, [CODE_FLAG, CODE_STATUS], D, 'lineitem')}), t AS (SELECT j, value AS t, m, s FROM ({rmatvec_sql(NUM_SQL, SPLIT_CATS, D, 'lineitem')}) JOIN {_SM} ON j = k), w AS (SELECT {S(D)} AS w FROM lineitem) SELECT a.j AS i, b.j AS j, a.m * b.m * coalesce(g.value, 0) + a.m * a.t * b.s + a.s * b.m * b.t + a.s * b.s * w.w AS value FROM t a, t b, w LEFT JOIN g ON g.i = a.j AND g.j = b.j".replace("FROM t a, t b, w LEFT JOIN g", "FROM t a CROSS JOIN t b CROSS JOIN w LEFT JOIN g"))
def standardized_sandwich(spark, sf_dir):
    return _view(split(spark, sf_dir), SHIFT, MULT).sandwich(D, exact=True)


# -- means, standard deviations ------------------------------------------------

_MEANS = f"SELECT j, value / (SELECT {S(D)} FROM lineitem) AS value FROM ({rmatvec_sql(NUM_SQL, SPLIT_CATS, D, 'lineitem')})"


@query(_MEANS)
def col_means(spark, sf_dir):
    return split(spark, sf_dir).col_means(D, exact=True)


_MU = "(SELECT " + ", ".join(f"{S(f'{x} * {D}')} / {S(D)} AS mu{j}" for j, x in NUM_SQL.items()) + " FROM lineitem)"
_STD = "SELECT j::INTEGER AS j, value FROM (" + " UNION ALL ".join(f"SELECT {j} AS j, sqrt(greatest({S(f'{D} * ({x} - mu{j}) * ({x} - mu{j})')} / {S(D)}, 0)) AS value FROM lineitem, {_MU}" for j, x in NUM_SQL.items()) + ")"


@query(_STD)
def col_stds_dense(spark, sf_dir):
    return dense(lineitem(spark, sf_dir), NUM).col_stds(D, exact=True)


@query(f"SELECT (j - 2)::INTEGER AS j, sqrt(greatest(value - value * value, 0)) AS value FROM ({_MEANS}) WHERE j BETWEEN 2 AND 4")
def col_stds_cat(spark, sf_dir):
    return single_categorical(lineitem(spark, sf_dir), "l_returnflag").col_stds(D, exact=True)


@query("SELECT o_orderkey, round((o_totalprice - m) / s, 6) AS o_totalprice FROM orders, (SELECT avg(o_totalprice) AS m, stddev_pop(o_totalprice) AS s FROM orders)")
def standardize_values(spark, sf_dir):
    m = dense(table(spark, sf_dir, "orders"), ["o_totalprice"], "o_orderkey")
    return m.standardize(F.lit(1.0))[0].to_wide().withColumn("o_totalprice", F.round("o_totalprice", 6))


# -- rows, columns, conversions ------------------------------------------------


@query("SELECT o_orderkey, o_totalprice * o_custkey AS o_totalprice FROM orders")
def multiply_dense(spark, sf_dir):
    return dense(table(spark, sf_dir, "orders"), ["o_totalprice"], "o_orderkey").multiply("o_custkey").to_wide()


@query(f"SELECT event_id AS row_id, code::INTEGER AS j, value FROM {_RANKED} WHERE value <> 0")
def multiply_cat_coo(spark, sf_dir):
    return single_categorical(events(spark, sf_dir), "event_type", row_id="event_id").multiply("value").to_coo()


@query("SELECT o_orderkey, o_custkey::DOUBLE AS o_custkey FROM orders")
def getcol_dense(spark, sf_dir):
    return dense(table(spark, sf_dir, "orders"), ["o_totalprice", "o_custkey"], "o_orderkey").getcol(-1).to_wide()


@query(f"SELECT event_id, (code = 1)::INTEGER::DOUBLE AS value FROM {_RANKED}")
def getcol_cat(spark, sf_dir):
    m = single_categorical(events(spark, sf_dir), "event_type", row_id="event_id").getcol(1)
    return m.set_names(["value"]).to_wide()


@query("SELECT event_id, value FROM events WHERE event_type = 'view'")
def index_rows_cols(spark, sf_dir):
    df = events(spark, sf_dir)
    m = hstack([single_categorical(df, "event_type", row_id="event_id"), dense(df, ["value"], "event_id")])
    return m[F.col("event_type") == "view", [m.n_columns - 1]].to_wide()


@query(f"SELECT event_id AS row_id, j, value FROM (SELECT event_id, 0 AS j, value FROM events WHERE value <> 0 UNION ALL SELECT event_id, (code + 1)::INTEGER, 1.0::DOUBLE FROM {_RANKED})")
def to_coo(spark, sf_dir):
    df = events(spark, sf_dir)
    return hstack([dense(df, ["value"], "event_id"), single_categorical(df, "event_type", row_id="event_id")]).to_coo()


@query(f"SELECT event_id, value, {', '.join(f'(code = {k})::INTEGER::DOUBLE AS t{k}' for k in range(5))} FROM {_RANKED}")
def to_wide(spark, sf_dir):
    df = events(spark, sf_dir)
    m = hstack([dense(df, ["value"], "event_id"), single_categorical(df, "event_type", row_id="event_id")])
    return m.set_names(["value", *[f"t{k}" for k in range(m.n_columns - 1)]]).to_wide()


@query("SELECT event_id, event_type AS value FROM events")
def recover_orig(spark, sf_dir):
    return single_categorical(events(spark, sf_dir), "event_type", row_id="event_id").recover_orig()


@query("SELECT o_orderkey, o_totalprice, o_custkey::DOUBLE AS o_custkey FROM orders")
def hstack_rows(spark, sf_dir):
    a = dense(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), ["o_totalprice"], "o_orderkey")
    b = dense(table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), "o_custkey"), ["o_custkey"], "k")
    return hstack([a, b]).to_wide()


@query(f"SELECT code::INTEGER AS j, event_id AS row_id, 1.0::DOUBLE AS value FROM {_RANKED}")
def transpose_coo(spark, sf_dir):
    return single_categorical(events(spark, sf_dir), "event_type", row_id="event_id").transpose_coo()


@query(f"SELECT j, {S('value * 2')} AS value FROM ({rmatvec_sql(NUM_SQL, [], D, 'lineitem')}) GROUP BY j")
def accumulate_out(spark, sf_dir):
    r = dense(lineitem(spark, sf_dir), NUM).transpose_matvec(D, exact=True)
    return accumulate(r, r, exact=True)


_TRIPLES = "(SELECT (l_orderkey % 1000) AS i, (l_linenumber - 1) AS j, sum(l_quantity) AS value FROM lineitem GROUP BY 1, 2)"


def _coo(spark, sf_dir):
    df = lineitem(spark, sf_dir).groupBy((F.col("l_orderkey") % 1000).alias("i"), (F.col("l_linenumber") - 1).alias("j")).agg(F.sum("l_quantity").alias("value"))
    return from_coo(df, 1000, 7)


@query(f"SELECT i AS row_id, {S('value * (j + 1)')} AS value FROM {_TRIPLES} GROUP BY i")
def coo_matvec(spark, sf_dir):
    v = spark.createDataFrame([(j, float(j + 1)) for j in range(7)], "j int, x double")
    return _coo(spark, sf_dir).matvec(v, exact=True)


@query(f"SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, {S('a.value * b.value')} AS value FROM {_TRIPLES} a JOIN {_TRIPLES} b ON a.i = b.i GROUP BY 1, 2")
def coo_sandwich(spark, sf_dir):
    return _coo(spark, sf_dir).sandwich(spark.range(1000).select(F.col("id").alias("i"), F.lit(1.0).alias("x")), exact=True)


@query(f"SELECT j::INTEGER AS j, count(*) FILTER (value <> 0) / 1000.0::DOUBLE > 0.5 AS is_dense FROM {_TRIPLES} GROUP BY j")
def density_split(spark, sf_dir):
    m = from_csc(_coo(spark, sf_dir).df, 1000, 7, threshold=0.5)
    return spark.createDataFrame([(j, b.kind == "dense") for j, b in enumerate(m.blocks)], "j int, is_dense boolean")


# the same operators on the real keys: rows and columns both grow with the table

_PARTS = "(SELECT l_partkey, row_number() OVER (ORDER BY l_partkey) - 1 AS j FROM (SELECT DISTINCT l_partkey FROM lineitem))"
_KEYED = f"(SELECT l_orderkey AS i, p.j, sum(l_quantity) AS value FROM lineitem JOIN {_PARTS} p USING (l_partkey) GROUP BY 1, 2)"
_N_KEYED = "(SELECT max(l_orderkey) + 1 FROM lineitem)"


def _keyed(spark, sf_dir):
    """Orders by parts; a row number is an order key."""
    m = single_categorical(lineitem(spark, sf_dir), "l_partkey")
    df = spread(m.df, lineitem(spark, sf_dir).count(), "l_orderkey").groupBy(F.col("l_orderkey").alias("i"), m.blocks[0].code.alias("j")).agg(F.sum("l_quantity").alias("value"))
    return from_coo(df, lineitem(spark, sf_dir).agg(F.max("l_orderkey") + 1).first()[0] or 0, m.n_columns).stored()


@query(f"SELECT i AS row_id, {S('value * (j + 1)')} AS value FROM {_KEYED} GROUP BY i")
def coo_matvec_keys(spark, sf_dir):
    m = _keyed(spark, sf_dir)
    return m.matvec(spark.range(m.n_columns).select(F.col("id").cast("int").alias("j"), (F.col("id") + 1.0).alias("x")), exact=True)


@query(f"SELECT a.j::INTEGER AS i, b.j::INTEGER AS j, {S('a.value * b.value')} AS value FROM {_KEYED} a JOIN {_KEYED} b ON a.i = b.i GROUP BY 1, 2")
def coo_sandwich_keys(spark, sf_dir):
    m = _keyed(spark, sf_dir)
    return m.sandwich(spark.range(m.n_rows).select(F.col("id").alias("i"), F.lit(1.0).alias("x")), exact=True)


@query(f"SELECT j::INTEGER AS j, count(*) FILTER (value <> 0) / {_N_KEYED}::DOUBLE > 4.0::DOUBLE / (SELECT count(DISTINCT l_partkey) FROM lineitem)::DOUBLE AS is_dense FROM {_KEYED} GROUP BY j")
def density_split_keys(spark, sf_dir):
    m = _keyed(spark, sf_dir)
    return m.split_density(4.0 / max(1, m.n_columns))


# -- construction --------------------------------------------------------------


def catalog(m: DesignMatrix) -> DataFrame:
    kinds = [b.kind for b in m.blocks for _ in range(b.width)]
    return m.df.sparkSession.createDataFrame(list(zip(range(m.n_columns), m.get_names(), m.get_names("term"), kinds)), "j int, name string, term string, kind string")


_BRANDS = "SELECT 'p_brand[' || p_brand || ']' AS name, 'p_brand' AS term, 'categorical' AS kind, row_number() OVER (ORDER BY p_brand) AS k FROM (SELECT DISTINCT p_brand FROM part)"
_KIND = "CASE WHEN avg(({} <> 0)::INTEGER) > 0.1 THEN 'dense' ELSE 'sparse' END"


@query(f"WITH b AS ({_BRANDS}), n AS (SELECT count(*) AS n FROM b) SELECT (k - 1)::INTEGER AS j, name, term, kind FROM b UNION ALL SELECT n::INTEGER, 'p_size', 'p_size', (SELECT {_KIND.format('p_size')} FROM part) FROM n UNION ALL SELECT (n + 1)::INTEGER, 'p_retailprice', 'p_retailprice', (SELECT {_KIND.format('p_retailprice')} FROM part) FROM n")
def from_df_catalog(spark, sf_dir):
    return catalog(from_df(table(spark, sf_dir, "part").select("p_brand", "p_size", "p_retailprice"), object_as_cat=True))


@query(f"WITH b AS ({_BRANDS}) SELECT 0 AS j, 'p_size' AS name, 'p_size' AS term, (SELECT {_KIND.format('p_size')} FROM part) AS kind UNION ALL SELECT k::INTEGER, name, term, kind FROM b")
def cat_position_end(spark, sf_dir):
    return catalog(from_df(table(spark, sf_dir, "part").select("p_brand", "p_size"), object_as_cat=True, cat_position="end"))


# -- formulas ------------------------------------------------------------------


def normal_equations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weighted normal equations of l_discount + l_tax + return flag, with intercept."""
    return from_formula("l_discount + l_tax + l_returnflag", lineitem(spark, sf_dir), include_intercept=True).sandwich(D, exact=True)


QUERIES["formula_main"] = normal_equations
SQL["formula_main"] = cells_sql({0: "1", 1: "l_discount", 2: "l_tax"}, [code_sql("l_returnflag", FLAGS, 3)], D, "lineitem")


@query(rmatvec_sql({}, [], D, "lineitem").replace("FROM ()", "FROM (" + " UNION ALL ".join(f"SELECT {j} AS j, {S(f'CASE WHEN l_returnflag = {chr(39)}{x}{chr(39)} THEN {D} * l_discount END')} AS value FROM lineitem" for j, x in enumerate(FLAGS)) + ")"))
def formula_interaction_cat_num(spark, sf_dir):
    return from_formula("0 + l_returnflag:l_discount", lineitem(spark, sf_dir)).transpose_matvec(D, exact=True)


@query(rmatvec_sql({}, [(f"({code_sql('l_linestatus', STATUS, 0)}) * 3 + ({code_sql('l_returnflag', FLAGS, 0)})", 0, 6)], D, "lineitem"))
def formula_cat_cat(spark, sf_dir):
    return from_formula("0 + l_returnflag:l_linestatus", lineitem(spark, sf_dir)).transpose_matvec(D, exact=True)


@query(rmatvec_sql({0: "1"}, [(code_sql("l_linestatus", ("O",), 1), 1, 1), (f"({code_sql('l_linestatus', STATUS, 0)}) * 2 + ({code_sql('l_returnflag', FLAGS[1:], 2)})", 2, 4)], D, "lineitem"))
def formula_full_rank(spark, sf_dir):
    return from_formula("l_returnflag:l_linestatus", lineitem(spark, sf_dir), include_intercept=True, ensure_full_rank=True).transpose_matvec(D, exact=True)


@query(rmatvec_sql({0: "l_tax"}, [(code_sql("l_returnflag", FLAGS, 1), 1, 3)], D, "lineitem"))
def formula_no_intercept(spark, sf_dir):
    return from_formula("l_tax + l_returnflag - 1", lineitem(spark, sf_dir), include_intercept=True, ensure_full_rank=True).transpose_matvec(D, exact=True)


@query(rmatvec_sql({0: "l_quantity * l_quantity", 1: "(CASE WHEN l_discount > 0.05 THEN 1 ELSE 0 END)", 2: "(l_tax + 2 * l_discount)"}, [], D, "lineitem"))
def formula_functions(spark, sf_dir):
    return from_formula("{l_quantity ** 2} + {np.where(l_discount > 0.05, 1, 0)} + {l_tax + k * l_discount}", lineitem(spark, sf_dir), context={"k": 2.0}).transpose_matvec(D, exact=True)


@query(rmatvec_sql({}, [("k", 0, 5)], "value", _CONVERT))
def formula_missing(spark, sf_dir):
    df = events(spark, sf_dir).withColumn("kind", F.expr("nullif(event_type, 'error')"))
    return from_formula("kind", df, cat_missing_method="convert").transpose_matvec("value", exact=True)


@query(f"SELECT j, value FROM ({rmatvec_sql({}, [(code_sql('l_returnflag', FLAGS, 0), 0, 3)], D, f'(SELECT * FROM lineitem WHERE {_ROWS})')})")
def formula_replay(spark, sf_dir):
    df = lineitem(spark, sf_dir)
    spec = from_formula("l_returnflag", df).spec
    return spec.get_model_matrix(df.filter(F.expr("l_shipdate < TIMESTAMP_NTZ '1997-01-01 00:00:00'"))).transpose_matvec(D, exact=True)


@query(rmatvec_sql({0: "l_quantity", 1: "l_quantity * l_quantity"}, [], "1", "lineitem"))
def poly_raw(spark, sf_dir):
    return from_formula("poly(l_quantity, 2, raw=True)", lineitem(spark, sf_dir)).transpose_matvec(F.lit(1.0), exact=True)


@query("SELECT o_orderkey, round(o_totalprice - (SELECT avg(o_totalprice) FROM orders), 4) AS x FROM orders")
def center(spark, sf_dir):
    m = from_formula("center(o_totalprice)", table(spark, sf_dir, "orders"), row_id="o_orderkey")
    return m.set_names(["x"]).to_wide().withColumn("x", F.round("x", 4))


@query()
def poly_orthogonal(spark, sf_dir):
    m = from_formula("poly(o_totalprice, 2)", table(spark, sf_dir, "orders"), row_id="o_orderkey")
    return m.sandwich(F.lit(1.0))


@query()
def bspline(spark, sf_dir):
    return from_formula("bs(o_totalprice, 5)", table(spark, sf_dir, "orders"), row_id="o_orderkey").set_names([f"b{k}" for k in range(1, 6)]).to_wide()
