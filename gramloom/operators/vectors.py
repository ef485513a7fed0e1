"""Column vectors as tables, and affine views whose shifts and multipliers are a table.

A column vector of many columns is a DataFrame (j, value), one row a column of the matrix.
Only what belongs to numeric columns and short categoricals, which are expressions anyway,
comes to the driver; entries of long categoricals are joined to the level table and,
by level, to the rows.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LevelTable
from ..plans.catalog import Numeric
from ..plans.scratch import written
from .matrix import DesignMatrix, _only, total

#: Columns whose standard deviation is below this are not scaled.
FLAT = 1e-7


def check_column_vector(v: DataFrame, p: int) -> DataFrame:
    """(j int, value double) of a vector that has each of the columns 0 .. p - 1 once, or ValueError."""
    v = v.toDF("j", "value").select(F.col("j").cast("int"), F.col("value").cast("double"))
    n, distinct, low, high = v.agg(F.count(F.lit(1)), F.count_distinct("j"), F.min("j"), F.max("j")).first()
    if (n, distinct) != (p, p) or p and (low, high) != (0, p - 1):
        raise ValueError(f"shapes not aligned: {p} columns, a vector of {n} entries over {distinct} columns from {low} to {high}")
    return v


def matvec_table(m: DesignMatrix, v: DataFrame, cols: Sequence[int] | None = None, checked: bool = True) -> DataFrame:
    """X[:, cols] @ v[cols] as (row id, value), for v as a table (j, value)."""
    p = m.n_columns
    v = check_column_vector(v, p) if checked else v.toDF("j", "value")
    on = m._check_cols(cols)
    if cols is not None:
        v = _only(v, "j", sorted(set(on)), p)
    placed = list(zip(m.blocks, m.offsets()))
    long = [(b, a) for b, a in placed if isinstance(getattr(b, "levels", None), LevelTable)]
    # what is not of a long block is about as long as the list of blocks
    is_long = reduce(lambda x, y: x | y, [F.col("j").between(a, a + b.width - 1 - len(b.levels.extra)) for b, a in long], F.lit(False))
    few = {r["j"]: r["value"] for r in v.filter(~is_long).toLocalIterator()}
    by_value = all(m._by_value(b) for b, _ in long)
    df, terms = m._rows if by_value else m.df, []
    for k, (b, a) in enumerate(placed):
        if isinstance(b, Numeric):
            if a in few:
                terms.append(b.value * F.lit(few[a]))
            continue
        if isinstance(b.levels, LevelTable):
            known, missing = b.width - len(b.levels.extra), F.lit(few.get(a + b.width - 1, 0.0))
            entries = v.filter(F.col("j").between(a, a + known - 1)).select((F.col("j") - a).alias("_at"), F.col("value").alias(f"_x{k}"))
            if by_value:
                table = b.levels.df.select(F.col("level").alias(f"_l{k}"), (F.col("code") - int(b.drop_first)).alias("_code"))
                df = df.join(table.join(entries, F.col("_code") == F.col("_at")).drop("_at", "_code"), b.source == F.col(f"_l{k}"), "left").drop(f"_l{k}")
                hit = F.col(f"_x{k}") if not b.levels.extra else F.when(b.source.isNull(), missing).otherwise(F.col(f"_x{k}"))
            else:
                df = df.join(entries.withColumnRenamed("_at", f"_at{k}"), b.position == F.col(f"_at{k}"), "left").drop(f"_at{k}")
                hit = F.col(f"_x{k}") if not b.levels.extra else F.when(b.position == known, missing).otherwise(F.col(f"_x{k}"))
        else:
            hit = F.get(F.array(*[F.lit(few.get(a + i, 0.0)) for i in range(b.width)]), b.position) if b.width else F.lit(0.0)
        terms.append(F.coalesce(hit if b.multiplier is None else hit * b.weight, F.lit(0.0)))
    value = reduce(lambda x, y: x + y, terms) if terms else F.lit(0.0)
    return df.select(*[F.col(c).alias("row_id") for c in m._ids()], value.cast("double").alias("value"))


@dataclass(frozen=True)
class TableView:
    """mult * X + shift with ``stats`` as a table (j, mult, shift) of all columns; nothing of p entries is on the driver."""

    base: DesignMatrix
    stats: DataFrame

    def unstandardize(self) -> DesignMatrix:
        return self.base

    def matvec(self, v: DataFrame, cols: Sequence[int] | None = None) -> DataFrame:
        """The multipliers go into v, the shifts into one number."""
        p = self.base.n_columns
        v = check_column_vector(v, p)
        on = sorted(set(self.base._check_cols(cols)))
        met = _only(v, "j", on, p).join(self.stats, "j")
        constant = met.agg(F.coalesce(F.sum(F.col("shift") * F.col("value")), F.lit(0.0))).first()[0]
        inner = matvec_table(self.base, met.select("j", (F.col("mult") * F.col("value")).alias("value")), checked=False)
        return inner.withColumn("value", F.col("value") + F.lit(constant))

    def transpose_matvec(self, v: Column | str, rows=None, cols: Sequence[int] | None = None, exact: bool = False) -> DataFrame:
        """mult * (X'v) + shift * sum(v) as (j, value)."""
        v = F.col(v) if isinstance(v, str) else v
        return self._with_sums(v, rows, cols, exact).select("j", (F.col("mult") * F.col("sum") + F.col("shift") * F.col("whole")).alias("value"))

    def _with_sums(self, d: Column, rows, cols: Sequence[int] | None, exact: bool) -> DataFrame:
        """j, mult, shift, sum (X'd) and whole (sum of d) for the columns asked for."""
        p = self.base.n_columns
        on = sorted(set(self.base._check_cols(cols)))
        with_ones = replace(self.base, blocks=(*self.base.blocks, Numeric(F.lit(1.0))))
        sums = written(with_ones.transpose_matvec(d, rows, [*on, p], exact), "sums")
        whole = sums.filter(F.col("j") == p).first()["value"]
        return sums.filter(F.col("j") < p).join(self.stats, "j").select("j", "mult", "shift", F.col("value").alias("sum"), F.lit(float(whole)).alias("whole"))

    def sandwich_parts(self, d: Column | str, rows=None, cols: Sequence[int] | None = None, exact: bool = False) -> tuple[DataFrame, DataFrame]:
        """X'DX in sparse cells, scaled, and (j, mult, shift, sum, whole): all that the full result follows from."""
        d = F.col(d) if isinstance(d, str) else d
        p = self.base.n_columns
        on = sorted(set(self.base._check_cols(cols)))
        # a column of ones has X'd and sum(d) come with X'DX, in one pass over the rows
        with_ones = replace(self.base, blocks=(*self.base.blocks, Numeric(F.lit(1.0))))
        every = written(with_ones.sandwich(d, rows, [*on, p], exact), "cells")
        whole = every.filter((F.col("i") == p) & (F.col("j") == p)).agg(F.coalesce(F.sum("value"), F.lit(0.0))).first()[0]
        sums = every.filter((F.col("j") == p) & (F.col("i") < p)).select(F.col("i").alias("j"), F.col("value").alias("sum"))
        stats = _only(self.stats, "j", on, p).join(sums, "j", "left")
        vectors = written(stats.select("j", "mult", "shift", F.coalesce("sum", F.lit(0.0)).alias("sum"), F.lit(float(whole)).alias("whole")), "vectors")
        mult = vectors.select("j", "mult")
        cells = every.filter((F.col("i") < p) & (F.col("j") < p)).join(mult, "j").withColumn("value", F.col("value") * F.col("mult")).drop("mult")
        cells = cells.join(mult.toDF("i", "mult"), "i").select("i", "j", (F.col("value") * F.col("mult")).alias("value"))
        return cells, vectors

    def sandwich(self, d: Column | str, rows=None, cols: Sequence[int] | None = None, exact: bool = False) -> DataFrame:
        """(i, j, value) of every pair of the columns asked for: sparse cells plus what shifts add.

        The result is full by its nature.  Each vector row is sent once to each of the other columns'
        rows by an explicit list of columns, and no vector or cell is collected.
        """
        cells, vectors = self.sandwich_parts(d, rows, cols, exact)
        on = sorted(set(self.base._check_cols(cols)))
        left = vectors.select(F.col("j").alias("i"), F.col("mult").alias("mi"), F.col("shift").alias("si"), F.col("sum").alias("ti"), "whole")
        wanted = F.sequence(F.lit(on[0]), F.lit(on[-1])) if on and on[-1] - on[0] == len(on) - 1 else F.array(*[F.lit(k) for k in on]).cast("array<int>")
        grid = left.withColumn("j", F.explode(wanted)).join(vectors.select("j", F.col("mult").alias("mj"), F.col("shift").alias("sj"), F.col("sum").alias("tj")), "j")
        added = F.col("mi") * F.col("ti") * F.col("sj") + F.col("si") * F.col("mj") * F.col("tj") + F.col("si") * F.col("sj") * F.col("whole")
        return grid.join(cells, ["i", "j"], "left").select("i", "j", (F.coalesce("value", F.lit(0.0)) + added).alias("value"))


def standardize_table(m: DesignMatrix, weights: Column | str, center: bool = True, scale: bool = True) -> tuple[TableView, DataFrame]:
    """(view, moments): like ``standardize``, but means and deviations stay a table (j, mean, std, ...), made in one pass."""
    from .moments import moments

    found = written(moments(m, weights), "moments")
    std = F.sqrt(F.greatest(F.col("m2") / F.col("weight"), F.lit(0.0)))
    mult = F.when(std < FLAT, F.lit(1.0)).otherwise(1 / std) if scale else F.lit(1.0)
    shift = -F.col("mean") * mult if center else F.lit(0.0)
    return TableView(m, found.select("j", mult.alias("mult"), shift.alias("shift"))), found.select("j", "weight", "mean", std.alias("std"))
