"""A lazy affine view: mult[j] * X[i, j] + shift[j], never materialised."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..plans.catalog import Numeric
from ..plans.scratch import written
from .matrix import BROADCAST_ROWS, DesignMatrix, total


@dataclass(frozen=True)
class StandardizedView:
    base: DesignMatrix
    shift: np.ndarray
    mult: np.ndarray | None = None

    def __post_init__(self) -> None:
        if not isinstance(self.base, DesignMatrix):
            raise TypeError("base must be a DesignMatrix")
        p = self.base.n_columns
        if np.shape(self.shift) != (p,) or (self.mult is not None and np.shape(self.mult) != (p,)):
            raise ValueError(f"shift and mult need {p} numbers")

    @property
    def _mult(self) -> np.ndarray:
        return np.ones(len(self.shift)) if self.mult is None else np.asarray(self.mult)

    def _table(self) -> DataFrame:
        rows = [(j, float(m), float(s)) for j, (m, s) in enumerate(zip(self._mult, self.shift))]
        return self.base.df.sparkSession.createDataFrame(rows, "k int, m double, s double")

    def unstandardize(self) -> DesignMatrix:
        return self.base

    def astype(self, dtype: str) -> "StandardizedView":
        return replace(self, base=self.base.astype(dtype))

    def get_names(self, *a, **k):
        return self.base.get_names(*a, **k)

    column_names = property(get_names)
    term_names = property(lambda self: self.get_names("term"))

    def set_names(self, names: Sequence[str | None] | str, type: str = "column") -> "StandardizedView":
        return replace(self, base=self.base.set_names(names, type))

    def __matmul__(self, v: Sequence[float]) -> DataFrame:
        return self.matvec(v)

    def __rmatmul__(self, v: Column | str) -> DataFrame:
        """v @ view; v is a row vector."""
        return self.transpose_matvec(v)

    def matvec(self, v: Sequence[float], cols: Sequence[int] | None = None) -> DataFrame:
        """The multipliers go into v, the shifts into one constant."""
        on = self.base._check_cols(cols)
        v = np.asarray(v, dtype=float)
        constant = float(sum(self.shift[j] * v[j] for j in dict.fromkeys(on)))
        return self.base.matvec(v * self._mult, cols).withColumn("value", F.col("value") + F.lit(constant))

    def transpose_matvec(self, v: Column | str, rows=None, cols: Sequence[int] | None = None, exact: bool = False) -> DataFrame:
        """mult * (X'v) + shift * sum(v)."""
        v = F.col(v) if isinstance(v, str) else v
        sums = self.base.transpose_matvec(v, rows, cols, exact)
        whole = self.base.filter(rows).df.agg(F.coalesce(total(v, exact), F.lit(0.0)).alias("t")).first()["t"]
        return sums.join(self._table(), F.col("j") == F.col("k")).select("j", (F.col("m") * F.col("value") + F.col("s") * F.lit(whole)).alias("value"))

    def sandwich(self, d: Column | str, rows=None, cols: Sequence[int] | None = None, exact: bool = False) -> DataFrame:
        """Four terms from X'DX, X'd and sum(d); every cell of the result is present.

        The result is full, p rows for each of p columns, and is made where it is needed;
        ``sandwich_parts`` gives the same in what is sparse and what is a vector.
        """
        cells, vectors, whole = self.sandwich_parts(d, rows, cols, exact)
        spark, n = self.base.df.sparkSession, len(vectors)
        table = spark.createDataFrame([(k, *v) for k, v in enumerate(vectors)], "k int, i int, mi double, si double, ti double")
        table = F.broadcast(table) if n <= BROADCAST_ROWS else table
        other = table.toDF("h", "j", "mj", "sj", "tj")
        grid = spark.range(n * n).select(F.expr(f"CAST(id DIV {n} AS INT)").alias("k"), (F.col("id") % n).cast("int").alias("h")).join(table, "k").join(other, "h")
        value = F.col("mi") * F.col("mj") * F.coalesce("value", F.lit(0.0)) + F.col("mi") * F.col("ti") * F.col("sj") + F.col("si") * F.col("mj") * F.col("tj") + F.col("si") * F.col("sj") * F.lit(whole)
        return grid.join(cells, ["i", "j"], "left").select("i", "j", value.alias("value"))

    def sandwich_parts(self, d: Column | str, rows=None, cols: Sequence[int] | None = None, exact: bool = False) -> tuple[DataFrame, list[tuple[int, float, float, float]], float]:
        """X'DX in sparse cells, (j, mult, shift, X'd) of every column, and sum(d): what a sandwich of the view is made of."""
        d = F.col(d) if isinstance(d, str) else d
        on, p = sorted(set(self.base._check_cols(cols))), self.base.n_columns
        # a column of ones has X'd and sum(d) come with X'DX, in one pass over the rows
        with_ones = replace(self.base, blocks=(*self.base.blocks, Numeric(F.lit(1.0))))
        every = written(with_ones.sandwich(d, rows, [*on, p], exact), "cells")
        sums = {r["i"]: r["value"] for r in every.filter(F.col("j") == p).select("i", "value").collect()}
        m, s = self._mult, self.shift
        vectors = [(j, float(m[j]), float(s[j]), float(sums.get(j) or 0.0)) for j in on]
        return every.filter((F.col("i") < p) & (F.col("j") < p)), vectors, float(sums.get(p) or 0.0)

    def multiply(self, d: Column | str) -> DesignMatrix:
        """Row scaling needs the values themselves: numeric columns."""
        return self.materialize().multiply(d)

    def materialize(self) -> DesignMatrix:
        """The view's values as numeric columns, for few columns only."""
        blocks = []
        for j in range(self.base.n_columns):
            (b,) = self.base.getcol(j).blocks
            b = b if isinstance(b, Numeric) else b.column(0)
            blocks.append(replace(b, value=b.value * F.lit(float(self._mult[j])) + F.lit(float(self.shift[j])), kind="dense", packed=None))
        return replace(self.base, blocks=tuple(blocks))

    def to_wide(self) -> DataFrame:
        return self.materialize().to_wide()

    def getcol(self, i: int) -> "StandardizedView":
        (i,) = self.base._check_cols([i])
        return StandardizedView(self.base.getcol(i), self.shift[i : i + 1], None if self.mult is None else self.mult[i : i + 1])

    def __getitem__(self, key) -> "StandardizedView":
        rows, cols = key if isinstance(key, tuple) else (key, None)
        if cols is None:
            return replace(self, base=self.base[rows])
        picked = self.base._check_cols([cols] if isinstance(cols, int) else list(range(self.base.n_columns))[cols] if isinstance(cols, slice) else cols)
        return StandardizedView(self.base[rows, picked], self.shift[picked], None if self.mult is None else self.mult[picked])
