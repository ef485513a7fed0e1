"""Interactions of factors with many levels: a dictionary of the combinations that occur.

The product of two factors of a million levels has 10^12 columns, almost all of them zero.
Here the combinations of values that occur are numbered by range, like the levels of one
factor, with long codes; sums are grouped by the values themselves and meet the numbers
afterwards.  What the full product would call a column is told by :func:`product_numbers`.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.levels import clean, level_table
from ..plans.catalog import Categorical
from ..plans.level_table import LevelTable
from .matrix import DesignMatrix


@dataclass(frozen=True)
class CombinationTable(LevelTable):
    """Levels that are structs of values; as names they read ``a[x]:b[y]``."""

    form: str = "{name}[{category}]"
    separator: str = ":"

    def _name(self, level) -> str:
        return self.separator.join(self.form.format(name=n, category=v) for n, v in level.asDict().items())

    def __iter__(self) -> Iterator:
        yield from (self._name(r["level"]) for r in self.df.orderBy("code").toLocalIterator())

    def __getitem__(self, k):
        return list(self)[k] if isinstance(k, slice) else self._name(super().__getitem__(k))


def combination(df: DataFrame, columns: Sequence[str]) -> Column:
    """The values of some columns as one, null where any of them is missing."""
    values = [clean(df, c).alias(c) for c in columns]
    whole = clean(df, columns[0]).isNotNull()
    for c in columns[1:]:
        whole = whole & clean(df, c).isNotNull()
    return F.when(whole, F.struct(*values))


def interaction(df: DataFrame, columns: Sequence[str], reduced: Sequence[str] = (), name: str | None = None, separator: str = ":", categorical_format: str = "{name}[{category}]", row_id: str | None = None) -> DesignMatrix:
    """One block with a column for each combination of values that occurs, ordered by the values.

    ``reduced`` names columns whose first level has no column, as in a full-rank coding.  A row
    where any value is missing is zero.  Passes: one for the combinations, one that counts them.
    """
    if len(columns) < 2 or len(set(columns)) < len(columns):
        raise ValueError(f"an interaction needs two or more different columns, not {list(columns)}")
    if unknown := [c for c in reduced if c not in columns]:
        raise ValueError(f"columns {unknown} are not in the interaction")
    value = combination(df, columns)
    if reduced:
        first = df.agg(*[F.min(clean(df, c)).alias(f"f{k}") for k, c in enumerate(reduced)]).first()
        for k, c in enumerate(reduced):
            value = F.when(clean(df, c) != F.lit(first[f"f{k}"]), value)
    label = f"_of_{'_'.join(columns)}"
    found = level_table(df.select(value.alias(label)), label, wide=True)
    levels = CombinationTable(found.df, found.known, (), categorical_format, separator)
    term = separator.join(columns) if name is None else name
    mark = f"_at_{'_'.join(columns)}"
    # codes beside the rows, for products with column vectors and conversions only
    coded = df.join(found.df.toDF("_combination", mark), value == F.col("_combination"), "left").drop("_combination")
    return DesignMatrix(coded, (Categorical(F.col(f"`{mark}`"), levels, term, term, False, None, "{category}", None, value),), row_id, base=df)


def product_numbers(m: DesignMatrix, levels: Sequence[Sequence], block: int = 0) -> DataFrame:
    """(j, full): which column of the full product each column of the block is, earlier factors varying fastest.

    ``levels`` are the levels of the factors, lists or tables, in the order of the interaction; numbers are long.
    """
    b = m.blocks[block]
    if not isinstance(b.levels, CombinationTable):
        raise TypeError("the block is no interaction of observed combinations")
    names = [f.name for f in b.levels.df.schema["level"].dataType]
    if len(names) != len(levels):
        raise ValueError(f"{len(levels)} level tables for {len(names)} factors")
    table, full, step = b.levels.df, F.lit(0).cast("long"), 1
    for k, (name, own) in enumerate(zip(names, levels)):
        if isinstance(own, LevelTable):
            codes = own.df.toDF(f"_l{k}", f"_n{k}")
        else:
            kind = T.StructType([T.StructField(f"_l{k}", b.levels.df.schema["level"].dataType[name].dataType), T.StructField(f"_n{k}", T.IntegerType())])
            codes = m.df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(own)], kind)
        table = table.join(codes, F.col(f"level.{name}") == F.col(f"_l{k}"))
        full = full + F.col(f"_n{k}").cast("long") * F.lit(step).cast("long")
        step *= len(own)
    if step >= 2**63:
        raise OverflowError(f"the full product has {step} columns")
    at = m.offsets()[block]
    return table.select((F.col("code") + at).alias("j"), full.alias("full"))


def with_interaction(m: DesignMatrix, columns: Sequence[str], **how) -> DesignMatrix:
    """The matrix with an interaction of columns of its own rows as the last block."""
    base = m.df if m.base is None else m.base
    own = interaction(base, columns, row_id=m.row_id, **how)
    if m.base is None or m.df is m.base:
        return replace(m, df=own.df, blocks=(*m.blocks, *own.blocks), base=base)
    joined = m.df.join(own.blocks[0].levels.df.toDF("_combination", "_code"), combination(m.df, columns) == F.col("_combination"), "left").withColumnRenamed("_code", own.df.columns[-1]).drop("_combination")
    return replace(m, df=joined, blocks=(*m.blocks, *own.blocks))
