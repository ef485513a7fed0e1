"""Products with several vectors at once: every pass over the rows adds up all of them.

A key of a sum (a numeric column, a level) has one sum for each vector, so eight vectors cost
the passes of one.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Sequence
from functools import reduce
from typing import TYPE_CHECKING

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LevelTable
from ..plans.catalog import Categorical, Numeric

if TYPE_CHECKING:
    from .matrix import DesignMatrix

#: Up to so many vectors share a pass; more go in groups of so many.
TOGETHER = 64


def _long(sums: DataFrame, n: int, first: int) -> DataFrame:
    """(j, k, value) of rows (j, s0, s1, ...); a sum that no row reached is 0."""
    each = F.array(*[F.struct(F.lit(first + k).alias("k"), F.coalesce(F.col(f"s{k}"), F.lit(0.0)).alias("value")) for k in range(n)])
    return sums.select("j", F.explode(each).alias("e")).select("j", "e.k", "e.value")


def transpose_matmul(m: DesignMatrix, vectors: Sequence[Column], rows, cols: Sequence[int] | None, exact: bool) -> DataFrame:
    """X[rows, cols].T @ V as (j, k, value): one pass for numeric columns, one for all categoricals of few levels, one for each long one."""
    parts = [_some(m, vectors[k : k + TOGETHER], k, rows, cols, exact) for k in range(0, len(vectors), TOGETHER)]
    found = [x for p in parts for x in p]
    if not found:
        return m.df.sparkSession.createDataFrame([], "j int, k int, value double")
    return reduce(DataFrame.unionAll, found)


def _some(m: DesignMatrix, vectors: Sequence[Column], first: int, rows, cols: Sequence[int] | None, exact: bool) -> list[DataFrame]:
    from .matrix import _addend, _combined, _numbers, _only, _union, total

    m, on, n = m.filter(rows), m._check_cols(cols), len(vectors)
    on = on if cols is None else sorted(set(on))
    inside = lambda b, a: bisect_left(on, a) < bisect_left(on, a + b.width)
    placed = [(b, a) for b, a in zip(m.blocks, m.offsets()) if inside(b, a)]
    numeric = [(b, a) for b, a in placed if isinstance(b, Numeric)]
    long = [(b, a) for b, a in placed if m._by_value(b)]
    short = [(b, a) for b, a in placed if isinstance(b, Categorical) and not m._by_value(b)]
    out = []
    if numeric:
        sums = m._rows.agg(*[total(b.value * v, exact).alias(f"s{a}_{k}") for b, a in numeric for k, v in enumerate(vectors)])
        each = [F.struct(F.lit(a).alias("j"), *[F.col(f"s{a}_{k}").alias(f"s{k}") for k in range(n)]) for _, a in numeric]
        out.append(_long(sums.select(F.explode(F.array(*each)).alias("e")).select("e.*"), n, first))
    if short:
        plain = all(b.multiplier is None for b, _ in short)
        terms = {f"t0_{k}": v for k, v in enumerate(vectors)} if plain else {f"t{c}_{k}": v * b.weight for c, (b, _) in enumerate(short) for k, v in enumerate(vectors)}
        source = m.df.select(*[(b.position + a).cast("int").alias(f"c{c}") for c, (b, a) in enumerate(short)], *[_addend(t, exact).alias(x) for x, t in terms.items()])
        source = _combined(source, [b for b, _ in short], list(terms))
        each = F.array(*[F.struct(F.col(f"c{c}").alias("j"), *[F.col(f"t{0 if plain else c}_{k}").alias(f"x{k}") for k in range(n)]) for c in range(len(short))])
        sums = source.select(F.explode(each).alias("e")).filter("e.j IS NOT NULL").groupBy(F.col("e.j").alias("j")).agg(*[F.sum(f"e.x{k}").cast("double").alias(f"s{k}") for k in range(n)])
        wanted = _union([_numbers(m.df, on[bisect_left(on, a) : bisect_left(on, a + b.width)]) for b, a in short])
        out.append(_long(wanted.join(sums, "j", "left"), n, first))
    for b, a in long:
        sums = m.base.groupBy(b.source.alias("_value")).agg(*[total(v if b.multiplier is None else v * b.weight, exact).alias(f"s{k}") for k, v in enumerate(vectors)])
        table = b.levels.df.select("level", (F.col("code") + a - int(b.drop_first)).alias("j")).filter(F.col("j") >= a)
        found = table.join(sums, F.col("level") == F.col("_value"), "left").select("j", *[f"s{k}" for k in range(n)])
        if b.levels.extra:
            missing = sums.filter("_value IS NULL").agg(*[F.sum(f"s{k}").alias(f"s{k}") for k in range(n)])
            found = found.unionAll(missing.select(F.lit(a + b.width - 1).alias("j"), *[f"s{k}" for k in range(n)]))
        own = on[bisect_left(on, a) : bisect_left(on, a + b.width)]
        out.append(_long(found if len(own) == b.width else _only(found, "j", own, m.n_columns), n, first))
    return out


def matmul(m: DesignMatrix, v: np.ndarray, cols: Sequence[int] | None) -> DataFrame:
    """X @ V as (row id, k, value): each row looks up one array of V's columns a block."""
    from .matrix import BROADCAST_ROWS, LOOKUP

    on = set(m._check_cols(cols))
    n = v.shape[1]
    v = np.where(np.isin(np.arange(len(v)), list(on))[:, None], v, 0.0)
    df, terms = m.df, []
    numbers = lambda row: F.array(*[F.lit(float(x)) for x in row])
    for c, (b, a) in enumerate(zip(m.blocks, m.offsets())):
        own = v[a : a + b.width]
        if not own.any():
            continue
        if isinstance(b, Numeric):
            terms.append([b.value * F.lit(float(x)) for x in own[0]])
            continue
        if b.width <= LOOKUP and not isinstance(b.levels, LevelTable):
            hit = F.get(F.array(*[numbers(row) for row in own]), b.position)
        else:
            table = df.sparkSession.createDataFrame([(i, [float(x) for x in row]) for i, row in enumerate(own) if row.any()], f"_k{c} int, _v{c} array<double>")
            table = F.broadcast(table) if own.size <= BROADCAST_ROWS else table
            df, hit = df.join(table, b.position == F.col(f"_k{c}"), "left"), F.col(f"_v{c}")
        terms.append([F.coalesce(F.get(hit, F.lit(k)) if b.multiplier is None else F.get(hit, F.lit(k)) * b.weight, F.lit(0.0)) for k in range(n)])
    sums = [reduce(lambda x, y: x + y, [t[k] for t in terms]) if terms else F.lit(0.0) for k in range(n)]
    each = F.array(*[F.struct(F.lit(k).alias("k"), x.cast("double").alias("value")) for k, x in enumerate(sums)])
    return df.select(*[F.col(c).alias("row_id") for c in m._ids()], F.explode(each).alias("e")).select(*["row_id"] * bool(m.row_id), "e.k", "e.value")
