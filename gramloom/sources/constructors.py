"""Matrices from DataFrames and triplets.

``from_df`` routes every column by its type: numbers and booleans become numeric columns
(dense or sparse by their share of non-zeros), strings become categoricals where asked
for or where levels are declared, and other types are left out with a warning.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator, Mapping, Sequence
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.levels import LITERAL_LEVELS, clean, observe, resolve, with_code
from ..operators.coo import CooMatrix
from ..operators.matrix import DesignMatrix
from ..plans.catalog import DENSE, SPARSE, Categorical, Numeric


#: Columns of a matrix that triplets are made dense for at most, and cells that a task fills at once.
WIDEST, CELLS_AT_ONCE = 10_000, 1 << 20


def dense(df: DataFrame, columns: Sequence[str], row_id: str | None = None, kind: str = DENSE) -> DesignMatrix:
    """Numeric columns as they are."""
    return DesignMatrix(df, tuple(Numeric(F.col(f"`{c}`").cast("double"), c, c, kind) for c in columns), row_id)


def packed(df: DataFrame, column: str, names: Sequence[str] | None = None, row_id: str | None = None) -> DesignMatrix:
    """The entries of an array column as numeric columns; wide Grams read the array as one buffer.

    All arrays must be of one length, without nulls: one pass looks at that.
    """
    c = F.col(f"`{column}`")
    low, high, nulls = df.agg(F.min(F.size(c)), F.max(F.size(c)), F.count_if(c.isNull() | F.exists(c, lambda x: x.isNull()))).first()
    if low is not None and (low != high or nulls):
        raise ValueError(f"arrays of {column} are not all of one length and whole: {low} to {high} entries, {nulls} with nulls")
    width = low or 0
    if names is not None and len(names) != width:
        raise ValueError(f"{len(names)} names for arrays of {width}")
    names = [f"{column}[{k}]" for k in range(width)] if names is None else list(names)
    return DesignMatrix(df, tuple(Numeric(F.get(c, F.lit(k)).cast("double"), names[k], column, DENSE, (column, k)) for k in range(width)), row_id)


def single_categorical(df: DataFrame, column: str, levels: Sequence | None = None, drop_first: bool = False, name: str | None = None, term: str | None = None, categorical_format: str = "{name}[{category}]", cat_missing_method: str = "fail", cat_missing_name: str = "(MISSING)", row_id: str | None = None) -> DesignMatrix:
    """One categorical variable; ``levels`` declares them in order, also unused ones."""
    seen, missing = observe(df, [column], {column: levels})[column]
    all_levels, last = resolve(column, seen, missing, levels, cat_missing_method, cat_missing_name)
    base, value = df, clean(df, column)
    df, code = with_code(df, value, all_levels, last, column)
    name = column if name is None else name
    return DesignMatrix(df, (Categorical(code, all_levels, name, term or name, drop_first, None, categorical_format, None, value),), row_id, base=base)


def from_codes(
    df: DataFrame,
    column: str,
    categories: Sequence,
    drop_first: bool = False,
    name: str | None = None,
    term: str | None = None,
    categorical_format: str = "{name}[{category}]",
    cat_missing_method: str = "fail",
    cat_missing_name: str = "(MISSING)",
    row_id: str | None = None,
) -> DesignMatrix:
    """One categorical variable from a column of codes: places in ``categories``, null or -1 where missing.

    Codes are used as they are, without a join, however many categories there are.
    """
    c, n = F.col(f"`{column}`").cast("int"), len(categories)
    given = F.coalesce(c, F.lit(-1))
    seen = df.agg(F.max(given).alias("high"), F.min(given).alias("low")).first()
    if seen["high"] is not None and seen["high"] >= n:
        raise ValueError(f"column {column} has code {seen['high']}, but there are {n} categories")
    if seen["low"] is not None and seen["low"] < -1:
        raise ValueError(f"column {column} has code {seen['low']}; only -1 stands for a missing value")
    levels, last = resolve(column, [], seen["low"] == -1, list(categories), cat_missing_method, cat_missing_name)
    code = F.when(c >= 0, c)
    code = F.coalesce(code, F.lit(n)) if last else code
    name = column if name is None else name
    return DesignMatrix(df, (Categorical(code, levels, name, term or name, drop_first, None, categorical_format),), row_id)


def from_df(
    df: DataFrame,
    sparse_threshold: float = 0.1,
    cat_threshold: int = 4,
    object_as_cat: bool = False,
    cat_position: str = "expand",
    drop_first: bool = False,
    categorical_format: str = "{name}[{category}]",
    cat_missing_method: str = "fail",
    cat_missing_name: str = "(MISSING)",
    levels: Mapping[str, Sequence] | None = None,
    row_id: str | None = None,
    dtype: str | None = None,
) -> DesignMatrix:
    """A matrix of all usable columns of ``df`` but ``row_id``, of doubles or of ``dtype``.

    Columns named in ``levels`` are categorical with these levels (Spark has no categorical
    type).  Categoricals of fewer than ``cat_threshold`` levels become numeric indicator
    columns.  ``cat_position`` "end" moves the other categoricals behind all else.  Passes
    over the data: one for densities, one for counts of nulls and levels, one for short
    lists of levels, and one for each long list.
    """
    if cat_position not in ("expand", "end"):
        raise ValueError("cat_position must be 'expand' or 'end'")
    levels = dict(levels or {})
    routes: list[tuple[str, str]] = []
    for f in df.schema:
        if f.name == row_id:
            continue
        if f.name in levels or (object_as_cat and isinstance(f.dataType, T.StringType)):
            routes.append((f.name, "cat"))
        elif isinstance(f.dataType, (T.NumericType, T.BooleanType)):
            routes.append((f.name, "num"))
        else:
            warnings.warn(f"left out: column {f.name}, of type {f.dataType.simpleString()}", stacklevel=2)
    if not routes:
        raise ValueError("no column of the DataFrame can be used")
    observed, base = observe(df, [c for c, r in routes if r == "cat"], levels), df
    placed: list = []
    later: list = []
    for c, route in routes:
        if route == "num":
            placed.append(Numeric(F.col(f"`{c}`").cast("double"), c, c))
            continue
        found, last = resolve(c, *observed[c], levels.get(c), cat_missing_method, cat_missing_name)
        value = clean(base, c)
        df, code = with_code(df, value, found, last, c)
        block = Categorical(code, found, c, c, drop_first, None, categorical_format, None, value)
        if len(found) < cat_threshold:
            placed += [block.column(k) for k in range(block.width)]
        elif cat_position == "end":
            later.append(block)
        else:
            placed.append(block)
    # indicator columns of many levels need the joined code
    made = DesignMatrix(df, tuple(b for b in placed + later if b.width), row_id, base=base if cat_threshold <= LITERAL_LEVELS else None).split_density(sparse_threshold)
    return made if dtype is None else made.astype(dtype)


def from_pandas(spark: SparkSession, pdf, **how) -> DesignMatrix:
    """Deprecated: from_df on a pandas frame; declared categories are kept in their order."""
    warnings.warn("from_pandas is deprecated, use from_df", DeprecationWarning, stacklevel=2)
    levels = {c: list(pdf[c].cat.categories) for c in pdf.columns if str(pdf[c].dtype) == "category"} | dict(how.pop("levels", {}) or {})
    plain = pdf.astype({c: object for c in levels}) if levels else pdf
    return from_df(spark.createDataFrame(plain), levels=levels, **how)


def from_coo(df: DataFrame, n_rows: int, n_columns: int, column_names: Sequence[str | None] | None = None, term_names: Sequence[str | None] | None = None) -> CooMatrix:
    """Triplets i, j, value."""
    names, terms = (None if x is None else tuple(x) for x in (column_names, term_names or column_names))
    return CooMatrix(df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("int").alias("j"), F.col("value").cast("double").alias("value")), n_rows, n_columns, names, terms)


def from_csc(df: DataFrame, n_rows: int, n_columns: int, threshold: float = 0.1, column_names: Sequence[str | None] | None = None, term_names: Sequence[str | None] | None = None) -> DesignMatrix:
    """Triplets as a matrix of up to ``WIDEST`` columns, each row one array, split by density.

    Rows without an entry are zero rows, so row ids run over 0 .. n_rows - 1.  Entries that
    repeat a cell are added up.  Wider matrices stay triplets: ``from_coo`` and its tiles.
    """
    if not 0 <= threshold <= 1:
        raise ValueError(f"a share from 0 to 1 is needed, not {threshold}")
    if n_columns > WIDEST:
        raise ValueError(f"{n_columns} columns are too many for dense rows (at most {WIDEST}); use from_coo")
    coo = from_coo(df, n_rows, n_columns, column_names, term_names)
    share = {r["j"]: r["density"] for r in coo.densities().collect()}
    entries = coo.df.groupBy("i").agg(F.collect_list(F.struct("j", "value")).alias("e"))

    def filled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, max(1, CELLS_AT_ONCE // n_columns)):
                batch = whole.slice(at, max(1, CELLS_AT_ONCE // n_columns))
                lists = batch.column(1)
                cells, row = lists.flatten(), np.repeat(np.arange(len(batch)), np.asarray(lists.value_lengths()))
                out = np.zeros((len(batch), n_columns))
                np.add.at(out, (row, cells.field("j").to_numpy(zero_copy_only=False)), cells.field("value").to_numpy(zero_copy_only=False))
                bounds = pa.array(np.arange(len(batch) + 1) * n_columns, pa.int32())
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(bounds, pa.array(out.ravel()))], ["i", "x"])

    arrays = entries.mapInArrow(filled, "i long, x array<double>")
    rows = df.sparkSession.range(n_rows).withColumnRenamed("id", "row").join(arrays, F.col("row") == F.col("i"), "left").select("row", F.coalesce("x", F.array_repeat(F.lit(0.0), n_columns)).alias("x"))
    blocks = []
    for j in range(n_columns):
        name = column_names[j] if column_names else None
        blocks.append(Numeric(F.get(F.col("x"), F.lit(j)), name, term_names[j] if term_names else name, DENSE if share.get(j, 0.0) > threshold else SPARSE, ("x", j)))
    return DesignMatrix(rows, tuple(blocks), "row")


def as_design(a, row_id: str | None = None) -> DesignMatrix:
    """A matrix as it is, or a DataFrame of numeric columns."""
    if isinstance(a, DesignMatrix):
        return a if row_id is None else replace(a, row_id=row_id)
    if isinstance(a, DataFrame):
        bad = [f.name for f in a.schema if not isinstance(f.dataType, (T.NumericType, T.BooleanType)) and f.name != row_id]
        if bad:
            raise ValueError(f"columns {bad} are not numeric")
        return dense(a, [c for c in a.columns if c != row_id], row_id)
    raise ValueError(f"cannot make a design matrix of {type(a).__name__}")
