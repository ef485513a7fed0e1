"""Rows by place: global numbering, rows in any order and as often as asked, vectors from other tables.

Spark's rows have no places, so places are made: rows are written once with their place in
their part, and the sizes of the parts before it, one number a part, are added when they
are read.  Nothing but those sizes comes to the driver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace
from itertools import accumulate
from typing import TYPE_CHECKING

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written

if TYPE_CHECKING:
    from .matrix import DesignMatrix

_IN_PART = (1 << 33) - 1


def number_rows(df: DataFrame, name: str = "row", order_by: Sequence[Column | str] = ()) -> DataFrame:
    """``df`` with a column ``name``: 0 .. n - 1 in the order of ``order_by``, else as the parts of ``df`` follow each other.

    Two passes: one writes (after a sort by range where an order is given), one counts the
    parts.  Equal keys of ``order_by`` are numbered in any order.
    """
    if name in df.columns:
        raise ValueError(f"there is a column {name} already")
    if order_by:
        df = df.repartitionByRange(*order_by).sortWithinPartitions(*order_by)
    placed = written(df.withColumn(name, F.monotonically_increasing_id()), "rows")
    part, at = F.shiftright(name, 33).cast("int"), F.col(name).bitwiseAND(F.lit(_IN_PART))
    sizes = sorted((r["part"], r["count"]) for r in placed.groupBy(part.alias("part")).count().collect())
    starts = list(zip((k for k, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    first = df.sparkSession.createDataFrame(starts, "_part int, _first long")
    joined = placed.join(F.broadcast(first), part == F.col("_part"))  # a row for each part
    return joined.select(*[F.col(f"`{c}`") for c in df.columns], (at + F.col("_first")).alias(name))


def numbered(m: DesignMatrix, order_by: Sequence[Column | str] = (), name: str = "_row") -> DesignMatrix:
    """The matrix over numbered rows: its row ids are places, and its rows can be taken by place."""
    df = number_rows(m.df, name, order_by)
    return replace(m, df=df, base=None if m.base is None else df, row_id=name, placed=True)


def place_table(m: DesignMatrix, rows: Sequence[int] | DataFrame, limit: int) -> DataFrame:
    """(_place, _of): which row stands at which place of the result; negative rows count from the end."""
    n = m.df.count()
    if isinstance(rows, DataFrame):
        table = rows.select(F.col("place").cast("long").alias("_place"), F.col("row").cast("long").alias("_of"))
        low, high = table.agg(F.min("_of"), F.max("_of")).first()
        if low is not None and not (-n <= low and high < n):
            raise IndexError(f"row index out of range for {n} rows: {low} to {high}")
        return table.withColumn("_of", F.when(F.col("_of") < 0, F.col("_of") + n).otherwise(F.col("_of")))
    rows = [int(r) for r in rows]
    if bad := [r for r in rows if not -n <= r < n]:
        raise IndexError(f"row index out of range for {n} rows: {bad[:5]}")
    table = m.df.sparkSession.createDataFrame([(k, r % n) for k, r in enumerate(rows)], "_place long, _of long")
    return F.broadcast(table) if len(rows) <= limit else table


def take(m: DesignMatrix, rows: Sequence[int] | DataFrame, limit: int) -> DesignMatrix:
    """Rows by place, in the order given and as often as given; a join with (place, row).

    ``rows`` is a list, or a DataFrame with columns place and row, each place once.  Row ids of
    the result are the places in ``rows``.
    """
    if not m.placed:
        raise ValueError("rows have no places: call numbered() first")
    table = place_table(m, rows, limit)
    own = m.row_id

    def on(df: DataFrame) -> DataFrame:
        met = df.join(table, F.col(own) == F.col("_of"))
        return met.select(*[F.col(f"`{c}`") for c in df.columns if c != own], F.col("_place").alias(own))

    df = on(m.df)
    return replace(m, df=df, base=None if m.base is None else df if m.base is m.df else on(m.base))


def check_ids(left: DataFrame, right: DataFrame, what: str) -> None:
    """Both have one column of ids: each id once on either side, or ValueError with what is wrong."""
    a, b = (d.toDF("id").withColumn("l", F.lit(s)).withColumn("r", F.lit(1 - s)) for d, s in ((left, 1), (right, 0)))
    sides = a.unionAll(b).groupBy("id").agg(F.sum("l").alias("l"), F.sum("r").alias("r"))
    wrong = lambda c: F.count_if(c)
    none, over, again = sides.agg(wrong(F.col("r") == 0), wrong(F.col("l") == 0), wrong((F.col("l") > 1) | (F.col("r") > 1) | F.col("id").isNull())).first()
    if none or over or again:
        raise ValueError(f"{what} does not fit: {none} rows have no value, {over} values have no row, {again} ids repeat or are null")


def with_row_vector(m: DesignMatrix, vector: DataFrame, name: str, checked: bool = True) -> DesignMatrix:
    """The matrix with a column ``name`` beside it, from a table (id, value) that has each row's id once.

    ``checked`` compares the ids of both sides first, in one pass over the ids alone.
    """
    if m.row_id is None:
        raise ValueError("a vector from another table needs row ids")
    if name in m.df.columns:
        raise ValueError(f"there is a column {name} already")
    key, _ = vector.columns
    if checked:
        check_ids(m.df.select(F.col(f"`{m.row_id}`")), vector.select(F.col(f"`{key}`")), f"row vector {name}")
    other = vector.toDF("_vector_id", name)

    def on(df: DataFrame) -> DataFrame:
        return df.join(other, F.col(m.row_id) == F.col("_vector_id")).drop("_vector_id")

    df = on(m.df)
    return replace(m, df=df, base=None if m.base is None else df if m.base is m.df else on(m.base))


def by_place(matrices: Sequence[DesignMatrix]) -> list[DesignMatrix]:
    """Matrices over different DataFrames, each numbered as its rows stand, for hstack; they must be equally long."""
    frames: dict[int, DataFrame] = {}
    out = []
    for k, m in enumerate(matrices):
        if m.placed:
            out.append(m)
            continue
        if id(m.df) not in frames:
            frames[id(m.df)] = number_rows(m.df, f"_row_{k}")
        df = frames[id(m.df)]
        out.append(replace(m, df=df, base=None if m.base is None else df, row_id=df.columns[-1], placed=True))
    sizes = [m.df.count() for m in out]
    if len(set(sizes)) > 1:
        raise ValueError(f"matrices of {', '.join(map(str, sizes))} rows cannot stand side by side")
    return out
