"""Matrices given as triplets (i, j, value), for very wide or very sparse data."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from ..plans.spread import pairs_met, spread
from .matrix import total


@dataclass(frozen=True)
class CooMatrix:
    """``df`` has i, j and value, each cell once; rows and columns may be empty."""

    df: DataFrame
    n_rows: int
    n_columns: int
    column_names: tuple[str | None, ...] | None = None
    term_names: tuple[str | None, ...] | None = None

    def __post_init__(self) -> None:
        for names in (self.column_names, self.term_names):
            if names is not None and len(names) != self.n_columns:
                raise ValueError(f"{len(names)} names for {self.n_columns} columns")

    def restricted(self, rows: DataFrame | None = None, cols: DataFrame | None = None) -> "CooMatrix":
        """Entries of some rows and columns only, given as tables of numbers that are read as sets; numbers stay."""
        df = self.df
        for name, kept in (("i", rows), ("j", cols)):
            if kept is not None:
                df = df.join(kept.toDF(f"_{name}").select(F.col(f"_{name}").cast(df.schema[name].dataType).alias(name)).distinct(), name, "left_semi")
        return replace(self, df=df.select("i", "j", "value"))

    def tiled(self, row_block: int | None = None, col_block: int | None = None):
        """The matrix in tiles, for products that keep sums in tasks; one shuffle, written once."""
        from .tiles import TiledMatrix

        return TiledMatrix.from_coo(self.df, self.n_rows, self.n_columns, row_block, col_block, self.column_names)

    def stored(self) -> "CooMatrix":
        """The matrix with its triplets written, for products, which count them first."""
        return replace(self, df=written(self.df, "entries"))

    def matvec(self, v: DataFrame, exact: bool = False) -> DataFrame:
        """v is (j, x); returns (row_id, value) for rows with an entry."""
        return self.df.join(v, "j").groupBy(F.col("i").alias("row_id")).agg(total(F.col("value") * F.col("x"), exact).alias("value"))

    def transpose_matvec(self, v: DataFrame, exact: bool = False) -> DataFrame:
        """v is (i, x); returns (j, value) for columns with an entry."""
        return self.df.join(v, "i").groupBy("j").agg(total(F.col("value") * F.col("x"), exact).alias("value"))

    def sandwich(self, d: DataFrame, exact: bool = False) -> DataFrame:
        """d is (i, x): entries of a row meet each other, and are summed by cell.

        A first pass counts what meets; partitions of the join and of the sums grow with that.
        """
        met = max(self.df.count(), pairs_met(self.df, None, "i", self.df.count()))
        own = spread(self.df, met, "i")
        left = own.join(d, "i").select("i", F.col("j").alias("a"), (F.col("value") * F.col("x")).alias("l"))
        right = spread(self.df.select("i", F.col("j").alias("b"), F.col("value").alias("r")), met, "i")
        products = left.join(right, "i").select(F.col("a").alias("i"), F.col("b").alias("j"), (F.col("l") * F.col("r")).alias("p"))
        return _by_cell(products, met, self.n_columns * self.n_columns, total(F.col("p"), exact))

    def transpose(self) -> "CooMatrix":
        return CooMatrix(self.df.select(F.col("j").alias("i"), F.col("i").alias("j"), "value"), self.n_columns, self.n_rows)

    def dot(self, other: "CooMatrix") -> "CooMatrix":
        right = other.df.select(F.col("i").alias("j"), F.col("j").alias("b"), F.col("value").alias("r"))
        n = self.df.count() + right.count()
        met = max(n, pairs_met(self.df, right, "j", n))
        products = spread(self.df, met, "j").join(spread(right, met, "j"), "j").select("i", F.col("b").alias("j"), (F.col("value") * F.col("r")).alias("p"))
        return CooMatrix(_by_cell(products, met, self.n_rows * other.n_columns, F.sum("p")), self.n_rows, other.n_columns)

    def densities(self) -> DataFrame:
        """(j, density) of columns with an entry."""
        return self.df.filter("value <> 0").groupBy("j").agg((F.count(F.lit(1)) / F.lit(float(max(1, self.n_rows)))).alias("density"))

    def split_density(self, threshold: float = 0.1) -> DataFrame:
        """(j, is_dense) of every column, for any number of columns."""
        if not 0 <= threshold <= 1:
            raise ValueError(f"a share from 0 to 1 is needed, not {threshold}")
        every = self.df.sparkSession.range(self.n_columns).select(F.col("id").cast("int").alias("j"))
        return every.join(self.densities(), "j", "left").select("j", (F.coalesce("density", F.lit(0.0)) > threshold).alias("is_dense"))


def _by_cell(products: DataFrame, n: int, cells: int, sums) -> DataFrame:
    """Sums by (i, j) of ``n`` products.  Where cells are few (of ``cells`` that can be), map tasks add up first."""
    few = cells <= n // 8
    return (products if few else spread(products, min(n, cells), "i", "j")).groupBy("i", "j").agg(sums.alias("value"))
