"""Weighted means and variances of all columns in one pass over the rows.

Tasks keep (weight, mean, M2), M2 the weighted sum of squared distances from that mean, for
each numeric column and each level that they meet, and merge them as they go; the partial
ones of tasks are merged by key.  Merging two of them,

    mean = m1 + (m2 - m1) * w2 / w,   M2 = M2_1 + M2_2 + (m2 - m1)^2 * w1 * w2 / w,

never subtracts large sums from each other, so a column far from zero keeps its digits.  A
column of a categorical is its multiplier where the row has the level and zero elsewhere: the
zeros are merged in last, as one part of their weight.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import TYPE_CHECKING

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LevelTable
from ..plans.catalog import Categorical, Numeric
from ..plans.scratch import written

if TYPE_CHECKING:
    from .matrix import DesignMatrix

#: Rows of which a task groups the levels at once.
ROWS_AT_ONCE = 500_000


def _numeric(x: np.ndarray, w: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
    whole = w.sum()
    if whole == 0:
        return 0.0, np.zeros(x.shape[1]), np.zeros(x.shape[1])
    mean = w @ x / whole
    return float(whole), mean, w @ (x - mean) ** 2


def _merged(a: tuple, b: tuple) -> tuple:
    """Of two parts of the same columns."""
    whole = a[0] + b[0]
    if whole == 0:
        return a
    apart = b[1] - a[1]
    return whole, a[1] + apart * (b[0] / whole), a[2] + b[2] + apart**2 * (a[0] * b[0] / whole)


def _by_level(key: pa.Array, x: np.ndarray | None, w: np.ndarray) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]:
    """Keys that occur, and the moments of x (ones if it is None) where each does."""
    coded = key.dictionary_encode(null_encoding="encode")
    at, n = coded.indices.to_numpy(zero_copy_only=False), len(coded.dictionary)
    whole = np.bincount(at, w, minlength=n)
    if x is None:
        return coded.dictionary, whole, np.ones(n), np.zeros(n)
    mean = np.bincount(at, w * x, minlength=n) / np.where(whole == 0, 1.0, whole)
    return coded.dictionary, whole, mean, np.bincount(at, w * (x - mean[at]) ** 2, minlength=n)


def _partials(batches: Iterator[pa.RecordBatch], k: int, scaled: list[bool], schema: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Rows (block, one key a categorical, weight, mean, m2); numeric columns are blocks from 0, categoricals from -1 down."""
    own: tuple = (0.0, np.zeros(k), np.zeros(k))
    held: list[pa.RecordBatch] = []

    def of_levels() -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(held).combine_chunks()
        w = table.column("w").to_numpy()
        for b, is_scaled in enumerate(scaled):
            x = table.column(f"x{b}").to_numpy() if is_scaled else None
            key, whole, mean, m2 = _by_level(_flat(table.column(f"k{b}")), x, w)
            columns = [pa.array(np.full(len(key), -1 - b, dtype=np.int32))]
            columns += [key.cast(schema.field(f"k{c}").type) if c == b else pa.nulls(len(key), schema.field(f"k{c}").type) for c in range(len(scaled))]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(whole), pa.array(mean), pa.array(m2)], schema=schema)

    for batch in batches:
        w = batch.column(batch.schema.get_field_index("w")).to_numpy(zero_copy_only=False)
        x = np.column_stack([batch.column(c).to_numpy(zero_copy_only=False) for c in range(k)]) if k else np.zeros((len(w), 0))
        own = _merged(own, _numeric(x, w))
        if scaled and batch.num_rows:
            held.append(batch)
            if sum(b.num_rows for b in held) >= ROWS_AT_ONCE:
                yield from of_levels()
                held = []
    if held:
        yield from of_levels()
    nothing = [pa.nulls(k + 1, schema.field(f"k{c}").type) for c in range(len(scaled))]
    # the weight of all rows is a column of its own, the last
    yield pa.RecordBatch.from_arrays([pa.array(np.arange(k + 1, dtype=np.int32)), *nothing, pa.array(np.full(k + 1, own[0])), pa.array(np.append(own[1], 1.0)), pa.array(np.append(own[2], 0.0))], schema=schema)


def _flat(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks)


def _merge(parts: DataFrame, *keys: str) -> DataFrame:
    """The parts of each key as one; each task sent a few."""
    zero = F.struct(*[F.lit(0.0).alias(c) for c in ("weight", "mean", "m2")])

    def two(a: Column, b: Column) -> Column:
        whole = a["weight"] + b["weight"]
        share = F.when(whole == 0, F.lit(0.0)).otherwise(b["weight"] / whole)
        apart = b["mean"] - a["mean"]
        return F.struct(whole.alias("weight"), (a["mean"] + apart * share).alias("mean"), (a["m2"] + b["m2"] + apart * apart * a["weight"] * share).alias("m2"))

    held = F.sort_array(F.collect_list(F.struct("weight", "mean", "m2")))
    return parts.groupBy(*keys).agg(F.aggregate(held, zero, two).alias("e")).select(*keys, "e.weight", "e.mean", "e.m2")


def moments(m: DesignMatrix, weights: Column | str) -> DataFrame:
    """(j, weight, mean, m2) of every column; m2 / weight is the population variance.

    A null or NaN makes its column's moments NaN.  Weights that sum to 0 raise ValueError.
    """
    w = F.col(weights) if isinstance(weights, str) else weights
    placed = [(b, a) for b, a in zip(m.blocks, m.offsets()) if b.width]
    numeric = [(b, a) for b, a in placed if isinstance(b, Numeric)]
    cats = [(b, a) for b, a in placed if isinstance(b, Categorical)]
    by_value = [m._by_value(b) for b, _ in cats]
    source = m.base if m.base is not None and all(v or not isinstance(b.levels, LevelTable) for v, (b, _) in zip(by_value, cats)) else m.df
    by_value = [v and source is m.base for v in by_value]
    nan = F.lit(float("nan"))
    keys = [(b.source if v else b.position.cast("int")).alias(f"k{c}") for c, (v, (b, _)) in enumerate(zip(by_value, cats))]
    scaled = [b.multiplier is not None for b, _ in cats]
    values = [F.coalesce(b.multiplier.cast("double"), nan).alias(f"x{c}") for c, (b, _) in enumerate(cats) if scaled[c]]
    rows = source.select(*[F.coalesce(b.value.cast("double"), nan).alias(f"n{c}") for c, (b, _) in enumerate(numeric)], *keys, *values, F.coalesce(w.cast("double"), F.lit(0.0)).alias("w"))
    kinds = {f.name: f.dataType for f in rows.schema}
    from pyspark.sql.pandas.types import to_arrow_type

    schema = pa.schema([("block", pa.int32()), *[(f"k{c}", to_arrow_type(kinds[f"k{c}"])) for c in range(len(cats))], ("weight", pa.float64()), ("mean", pa.float64()), ("m2", pa.float64())])
    ddl = ", ".join(["block int", *[f"k{c} {kinds[f'k{c}'].simpleString()}" for c in range(len(cats))], "weight double", "mean double", "m2 double"])
    k = len(numeric)
    parts = rows.mapInArrow(lambda batches: _partials(batches, k, scaled, schema), ddl)
    merged = written(_merge(parts, "block", *[f"k{c}" for c in range(len(cats))]), "moments-parts")
    whole = merged.filter(F.col("block") == k).agg(F.sum("weight")).first()[0]
    if not whole:
        raise ValueError("weights sum to 0")
    out = []
    if numeric:
        at = F.get(F.array(*[F.lit(a) for _, a in numeric]), F.col("block"))
        out.append(merged.filter((F.col("block") >= 0) & (F.col("block") < k)).select(at.cast("int").alias("j"), "weight", "mean", "m2"))
    for c, (b, a) in enumerate(cats):
        own = merged.filter(F.col("block") == -1 - c)
        if by_value[c]:
            known = b.levels.df.select("level", (F.col("code") - int(b.drop_first)).alias("at")).filter("at >= 0")
            found = known.join(own, F.col("level") == F.col(f"k{c}"), "left").select("at", "weight", "mean", "m2")
            if b.levels.extra:
                missing = own.filter(F.col(f"k{c}").isNull()).agg(*[F.sum(x).alias(x) for x in ("weight", "mean", "m2")])
                found = found.unionAll(missing.select(F.lit(b.width - 1).alias("at"), "weight", "mean", "m2"))
        else:
            every = source.sparkSession.range(b.width).select(F.col("id").cast("int").alias("at"))
            found = every.join(own, F.col("at") == F.col(f"k{c}"), "left").select("at", "weight", "mean", "m2")
        here = F.coalesce("weight", F.lit(0.0))
        mean, share = F.coalesce("mean", F.lit(0.0)), here / F.lit(float(whole))
        with_zeros = F.coalesce("m2", F.lit(0.0)) + mean * mean * here * (1 - share)
        out.append(found.select((F.col("at") + a).alias("j"), F.lit(float(whole)).alias("weight"), (mean * share).alias("mean"), with_zeros.alias("m2")))
    if not out:
        return source.sparkSession.createDataFrame([], "j int, weight double, mean double, m2 double")
    result = out[0]
    for x in out[1:]:
        result = result.unionAll(x)
    return result


def col_stds(m: DesignMatrix, weights: Column | str) -> DataFrame:
    """(j, value): population standard deviations, in one pass."""
    return moments(m, weights).select("j", F.sqrt(F.greatest(F.col("m2") / F.col("weight"), F.lit(0.0))).alias("value"))
