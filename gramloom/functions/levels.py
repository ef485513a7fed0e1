"""Level dictionaries of categorical variables, and code expressions over them.

Few levels are a tuple.  More than ``LITERAL_LEVELS`` are a :class:`LevelTable`: a written
DataFrame that codes and zeros are joined from, which no single task or driver holds.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import replace
from itertools import accumulate

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..plans.level_table import LevelTable
from ..plans.scratch import written
from ..plans.spread import TASK_ROWS, parts_of, spread

MISSING_METHODS = ("fail", "zero", "convert")
#: Up to so many levels, codes come from a literal array; beyond, from a join with the level table.
LITERAL_LEVELS = 64
#: Up to so many declared levels their table is broadcast (a few MB); Spark knows no size of a table made of a list.
BROADCAST_LEVELS = 100_000


def clean(df: DataFrame, column: str) -> Column:
    """The column with NaN as null, since either is missing."""
    c = F.col(f"`{column}`")
    return F.when(~F.isnan(c), c) if isinstance(df.schema[column].dataType, (T.DoubleType, T.FloatType)) else c


def level_table(df: DataFrame, column: str, wide: bool = False, about: int | None = None) -> LevelTable:
    """Distinct values sorted by range and written; codes are positions in a part plus the parts' sizes before it.

    ``wide`` makes codes long, for more than 2^31 values.  ``about`` is the number of values or a
    bound of it, else a pass tells it: of many, tasks take a share each, and rows are dealt before any are made distinct.
    """
    values = df.select(clean(df, column).alias("level")).filter("level IS NOT NULL")
    if about is None:
        about = values.agg(F.approx_count_distinct("level")).first()[0]
    values = (spread(values, about, "level") if about > TASK_ROWS else values).distinct()
    placed = written(values.repartitionByRange(parts_of(df, about), "level").sortWithinPartitions("level").withColumn("at", F.monotonically_increasing_id()), "levels")
    table = placed.select("level", F.shiftright("at", 33).cast("int").alias("part"), F.col("at").bitwiseAND(F.lit((1 << 33) - 1)).alias("at"))
    sizes = sorted((r["part"], r["count"]) for r in table.groupBy("part").count().collect())
    before = dict(zip((k for k, _ in sizes), accumulate((n for _, n in sizes), initial=0)))
    first = F.element_at(F.create_map(*[F.lit(x) for k, v in before.items() for x in (k, v)]), F.col("part")) if before else F.lit(0)
    return LevelTable(table.select("level", (first + F.col("at")).cast("long" if wide else "int").alias("code")), sum(n for _, n in sizes))


def _unseen(df: DataFrame, column: str, declared: Sequence) -> list:
    """A few values that are not among the declared ones."""
    values = df.select(clean(df, column).alias("level")).filter("level IS NOT NULL")
    if isinstance(declared, LevelTable):
        values = values.join(declared.df, "level", "left_anti")
    elif len(declared) <= LITERAL_LEVELS:
        values = values.filter(~F.col("level").isin([x for x in declared if x is not None]))
    else:
        values = values.join(_declared(df, values.schema["level"].dataType, declared), "level", "left_anti")
    return list(dict.fromkeys(r["level"] for r in values.limit(5).collect()))


def _declared(df: DataFrame, kind: T.DataType, levels: Sequence, level: str = "level", code: str = "code") -> DataFrame:
    table = df.sparkSession.createDataFrame([(x, i) for i, x in enumerate(levels)], T.StructType([T.StructField(level, kind), T.StructField(code, T.IntegerType())]))
    return F.broadcast(table) if len(levels) <= BROADCAST_LEVELS else table


def observe(df: DataFrame, columns: Sequence[str], declared: Mapping[str, Sequence | None] | None = None) -> dict[str, tuple[Sequence, bool]]:
    """For each column its sorted distinct values and whether any is missing.

    Values come to the driver only where a first pass counts few of them.  Where levels are
    declared, only values outside of them (a few) are looked for.
    """
    if not columns:
        return {}
    declared = {c: x for c, x in (declared or {}).items() if x is not None}
    asked = [F.coalesce(F.bool_or(clean(df, c).isNull()), F.lit(False)).alias(f"m{i}") for i, c in enumerate(columns)]
    asked += [F.approx_count_distinct(clean(df, c)).alias(f"n{i}") for i, c in enumerate(columns) if c not in declared]
    # whether short declared lists hold all values is told by the same pass
    short = [i for i, c in enumerate(columns) if c in declared and not isinstance(declared[c], LevelTable) and len(declared[c]) <= LITERAL_LEVELS]
    asked += [F.coalesce(F.bool_or(~clean(df, columns[i]).isin([x for x in declared[columns[i]] if x is not None])), F.lit(False)).alias(f"u{i}") for i in short]
    row = df.agg(*asked).first()
    few = [i for i, c in enumerate(columns) if c not in declared and row[f"n{i}"] <= LITERAL_LEVELS]
    sets = df.agg(*[F.sort_array(F.collect_set(clean(df, columns[i]))).alias(f"v{i}") for i in few]).first() if few else {}

    def seen(i: int, c: str) -> Sequence:
        if c in declared:
            return [] if i in short and not row[f"u{i}"] else _unseen(df, c, declared[c])
        return list(sets[f"v{i}"]) if i in few else level_table(df, c, about=row[f"n{i}"])

    return {c: (seen(i, c), bool(row[f"m{i}"])) for i, c in enumerate(columns)}


def resolve(column: str, seen: Sequence, missing: bool, declared: Sequence | None, method: str, missing_name: str) -> tuple[Sequence, bool]:
    """The levels in force and whether a missing value has one of its own (the last)."""
    if method not in MISSING_METHODS:
        raise ValueError(f"cat_missing_method must be one of {MISSING_METHODS}, not {method!r}")
    levels = list(declared) if declared is not None else seen
    if declared is not None and (extra := [x for x in seen if x not in set(levels)]):
        raise ValueError(f"column {column} contains unseen categories: {extra[:5]}")
    if missing and method == "fail":
        raise ValueError(f"Categorical data in {column} can't have missing values if cat_missing_method='fail'")
    if missing and method == "convert":
        if missing_name in levels:
            raise ValueError(f"Missing category {missing_name} already exists in {column}")
        return replace(levels, extra=(missing_name,)) if isinstance(levels, LevelTable) else (*levels, missing_name), True
    return levels if isinstance(levels, LevelTable) else tuple(levels), False


def with_code(df: DataFrame, value: Column, levels: Sequence, missing_last: bool, name: str) -> tuple[DataFrame, Column]:
    """``df`` and an expression for the code of ``value``: null where missing or unknown."""
    n = len(levels) - missing_last
    if isinstance(levels, LevelTable) or n > LITERAL_LEVELS:
        own = (f"_lv_{name}", f"_code_{name}")
        table = levels.df.toDF(*own) if isinstance(levels, LevelTable) else _declared(df, df.select(value.alias("v")).schema["v"].dataType, levels[:n], *own)
        df = df.join(table, value == F.col(f"`_lv_{name}`"), "left").drop(f"_lv_{name}")
        code = F.col(f"`_code_{name}`")
    else:
        code = F.array_position(F.array(*[F.lit(x) for x in levels[:n]]), value) - 1 if n else F.lit(None).cast("int")
        code = F.when(code >= 0, code).cast("int")
    if missing_last:
        code = F.when(value.isNull(), F.lit(n)).otherwise(code)
    return df, code
