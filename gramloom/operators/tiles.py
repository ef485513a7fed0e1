"""Sparse matrices in tiles: blocks of rows by blocks of columns, multiplied in NumPy where they lie.

A tile is one row (rb, cb, i, j, value) with its entries in three arrays, numbered within the
matrix.  The matrix is dealt into tiles once and written.  Products then work tile by tile:
entries meet within a pair of tiles, sums are kept by cell in the task, and only sums are
shuffled.  Rows longer than a block of columns are cut, so no tile holds more than
``row_block * col_block`` cells.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.scratch import written
from ..plans.spread import pairs_met, spread
from .matrix import BROADCAST_ROWS, total

#: Products of entries made at once, and sums of cells that a task holds before it sends them on.
PRODUCTS_AT_ONCE, CELLS_HELD = 1 << 20, 1 << 20
#: Entries that a block of rows should hold about, and beyond which columns are cut.
TILE_ENTRIES, MOST_ENTRIES = 1 << 16, 1 << 20
#: Entries that tiles which meet in a product should hold about: a block of more is cut to pieces, each pair of them a work of its own.
PIECE = 1 << 18
#: Up to so many places a block of a vector is an array beside the tiles; beyond, entries are joined to it.
WIDE = 1 << 20
_CELLS_DDL = "i long, j long, value double"
_CELLS = pa.schema([("i", pa.int64()), ("j", pa.int64()), ("value", pa.float64())])


def _products(on_a: np.ndarray, a: np.ndarray, x: np.ndarray, on_b: np.ndarray, b: np.ndarray, y: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(a, b, x * y) for all pairs of entries with equal ``on``, some at a time; ``on_b`` is sorted."""
    low, high = np.searchsorted(on_b, on_a, "left"), np.searchsorted(on_b, on_a, "right")
    met = high - low
    edges = np.flatnonzero(np.diff(np.cumsum(met) // PRODUCTS_AT_ONCE)) + 1
    for part in np.split(np.arange(len(on_a)), edges):
        n = met[part]
        left = np.repeat(part, n)
        right = np.repeat(low[part] - (np.cumsum(n) - n), n) + np.arange(n.sum())
        yield a[left], b[right], x[left] * y[right]


class _Sums:
    """Sums by cell; products are added up when many have come."""

    def __init__(self) -> None:
        self.parts: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.held = 0

    def add(self, i: np.ndarray, j: np.ndarray, value: np.ndarray) -> None:
        self.parts.append((i, j, value))
        self.held += len(i)
        if self.held > 2 * PRODUCTS_AT_ONCE:
            self.reduce()

    def reduce(self) -> None:
        if not self.parts:
            return
        i, j, value = (np.concatenate(x) for x in zip(*self.parts))
        order = np.lexsort((j, i))
        i, j, value = i[order], j[order], value[order]
        first = np.flatnonzero(np.r_[True, (i[1:] != i[:-1]) | (j[1:] != j[:-1])]) if len(i) else np.zeros(0, dtype=np.int64)
        self.parts = [(i[first], j[first], np.add.reduceat(value, first) if len(first) else value)]
        self.held = len(first)

    def take(self, least: int) -> Iterator[pa.RecordBatch]:
        """The sums so far, if there are more than ``least``."""
        if self.held <= least:
            return
        self.reduce()
        if self.held > least and self.parts:
            i, j, value = self.parts[0]
            yield pa.RecordBatch.from_arrays([pa.array(i.astype(np.int64)), pa.array(j.astype(np.int64)), pa.array(value)], schema=_CELLS)
            self.parts, self.held = [], 0


def _lists(batch: pa.RecordBatch, name: str) -> list[np.ndarray]:
    column = batch.column(batch.schema.get_field_index(name))
    values, ends = column.flatten().to_numpy(zero_copy_only=False), np.cumsum(np.asarray(column.value_lengths()))
    return np.split(values, ends[:-1])


def _multiplied(batches: Iterator[pa.RecordBatch], gram: bool) -> Iterator[pa.RecordBatch]:
    """Products of the pairs of tiles (on_a, a, x) and (on_b, b, y); of Gram pairs those between different columns, as a < b."""
    sums = _Sums()
    for batch in batches:
        columns = [_lists(batch, c) for c in ("on_a", "a", "x", "on_b", "b", "y")]
        for on_a, a, x, on_b, b, y in zip(*columns):
            order = np.argsort(on_b, kind="stable")
            for i, j, value in _products(on_a, a, x, on_b[order], b[order], y[order]):
                sums.add(*((np.minimum(i, j), np.maximum(i, j)) if gram else (i, j)), value)
                yield from sums.take(CELLS_HELD)
    yield from sums.take(0)


def _weighted_tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """Of each tile beside its rows' weights its row, and i, j, value and weighted value: entries of rows without a weight go."""
    for batch in batches:
        if not batch.num_rows:
            continue
        at = {name: k for k, name in enumerate(batch.schema.names)}
        first, weights = batch.column(at["first"]).to_pylist(), batch.column(at["weights"])
        for k, (i, j, value) in enumerate(zip(*[_lists(batch, c) for c in ("i", "j", "value")])):
            own = weights[k].values.take(pa.array(i - first[k]))
            there = np.asarray(own.is_valid())
            yield batch.slice(k, 1), i[there], j[there], value[there], value[there] * own.to_numpy(zero_copy_only=False)[there]


def _weighted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for row, *arrays in _weighted_tiles(batches):
        ends = pa.array([0, len(arrays[0])], pa.int32())
        numbers = [row.column(row.schema.get_field_index(c)) for c in ("rb", "of", "piece")]
        yield pa.RecordBatch.from_arrays([*numbers, *[pa.ListArray.from_arrays(ends, pa.array(x)) for x in arrays]], ["rb", "of", "piece", "i", "j", "value", "x"])


def _own_products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Weighted products of the entries of a tile with those of its own: of each row the pairs a <= b."""
    sums = _Sums()
    for _, on, a, y, x in _weighted_tiles(batches):
        order = np.lexsort((a, on))
        on, a, x, y = on[order], a[order], x[order], y[order]
        here = np.arange(len(on))
        met = np.searchsorted(on, on, "right") - here  # itself and those behind it in its row
        for part in np.split(here, np.flatnonzero(np.diff(np.cumsum(met) // PRODUCTS_AT_ONCE)) + 1):
            n = met[part]
            left = np.repeat(part, n)
            right = left + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            sums.add(a[left], a[right], x[left] * y[right])
            yield from sums.take(CELLS_HELD)
    yield from sums.take(0)


@dataclass(frozen=True)
class TiledMatrix:
    """``tiles`` has rb, cb, i, j, value; blocks count from 0."""

    tiles: DataFrame
    n_rows: int
    n_columns: int
    row_block: int
    col_block: int
    column_names: tuple[str | None, ...] | None = None

    @classmethod
    def from_coo(cls, df: DataFrame, n_rows: int, n_columns: int, row_block: int | None = None, col_block: int | None = None, column_names=None) -> "TiledMatrix":
        """Triplets i, j, value, each cell once, dealt into tiles by one shuffle and written.

        Blocks of rows hold about ``TILE_ENTRIES`` entries unless told otherwise; columns are cut
        only where a block of rows holds more than ``MOST_ENTRIES``, as with long rows.
        """
        if column_names is not None and len(column_names) != n_columns:
            raise ValueError(f"{len(column_names)} names for {n_columns} columns")
        df = written(df.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), F.col("value").cast("double").alias("value")), "entries")
        bad = df.filter(~F.col("i").between(0, n_rows - 1) | ~F.col("j").between(0, n_columns - 1) | F.col("i").isNull() | F.col("j").isNull()).limit(1).collect()
        if bad:
            raise IndexError(f"entry ({bad[0]['i']}, {bad[0]['j']}) is outside of {n_rows} x {n_columns}")
        n = df.count()
        if row_block is None:
            row_block = max(1, min(n_rows, TILE_ENTRIES, TILE_ENTRIES * max(1, n_rows) // max(1, n)))
        placed = df.filter("value <> 0 OR value IS NULL").withColumn("rb", F.expr(f"i DIV {row_block}"))
        if col_block is None:
            most = placed.groupBy("rb").count().agg(F.max("count")).first()[0] or 0
            col_block = max(1, n_columns if most <= MOST_ENTRIES else n_columns * MOST_ENTRIES // most)
        return cls(_dealt(placed.withColumn("cb", F.expr(f"j DIV {col_block}")), n), n_rows, n_columns, row_block, col_block, None if column_names is None else tuple(column_names))

    @property
    def shape(self) -> tuple[int, int]:
        return self.n_rows, self.n_columns

    def entries(self) -> DataFrame:
        """The triplets again."""
        return self.tiles.select(F.explode(F.arrays_zip("i", "j", "value")).alias("e")).select("e.i", "e.j", "e.value")

    def _n_entries(self) -> int:
        return self.tiles.agg(F.sum(F.size("i").cast("long"))).first()[0] or 0

    def _limited(self, rows: DataFrame | None, cols: DataFrame | None) -> "TiledMatrix":
        """Entries in the given sets of rows (i) and columns (j) only; numbers stay."""
        if rows is None and cols is None:
            return self
        n = self._n_entries()
        placed = _within(_within(self.entries(), "i", rows, n), "j", cols, n).withColumn("rb", F.expr(f"i DIV {self.row_block}")).withColumn("cb", F.expr(f"j DIV {self.col_block}"))
        return TiledMatrix(_dealt(placed, n), self.n_rows, self.n_columns, self.row_block, self.col_block, self.column_names)

    def _pieces(self, cols: DataFrame | None) -> tuple[DataFrame, int, int]:
        """Entries in the given columns by blocks of rows alone: tiles (rb, of, piece, i, j, value), how many entries, and the most pieces.

        A block of rows is one piece, however many tiles it is cut into, unless it has more than ``PIECE`` entries.
        """
        sizes = self.tiles.groupBy("rb").agg(F.sum(F.size("i").cast("long")).alias("n"))
        n, longest, blocks = sizes.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.max("n"), F.lit(0)), F.count("rb")).first()
        if cols is None and self.col_block >= self.n_columns and longest <= MOST_ENTRIES:
            return self.tiles.select("rb", F.lit(1).cast("long").alias("of"), F.lit(0).cast("long").alias("piece"), "i", "j", "value"), n, 1
        of = (F.floor((F.col("n") - 1) / PIECE) + 1).alias("of")
        parts = sizes.select("rb", of)
        each = self.tiles.join(F.broadcast(parts) if blocks <= BROADCAST_ROWS else parts, "rb").select("rb", "of", F.explode(F.arrays_zip("i", "j", "value")).alias("e")).select("rb", "of", "e.i", "e.j", "e.value")
        placed = _within(each, "j", cols, n).withColumn("piece", F.pmod(F.xxhash64("j"), "of"))
        return _dealt(placed, n, ("rb", "of", "piece")), n, max(1, -(-longest // PIECE))

    def sandwich(self, d: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None) -> DataFrame:
        """X' diag(d) X as (i, j, value), both triangles, for d as (i, x); cells without a product are absent.

        ``rows`` and ``cols`` are tables with a column of numbers, read as sets.
        """
        pieces, n, most = self._pieces(cols)
        if rows is not None:
            d = d.toDF("at", "x").join(rows.select(F.col(rows.columns[0]).alias("at")).distinct(), "at", "left_semi")
        weights = _vector_blocks(d, self.row_block)
        weighted = spread(pieces, n, "rb").join(weights, "rb")
        weighted = weighted.withColumn("first", F.col("rb") * self.row_block)
        products = weighted.mapInArrow(_own_products, _CELLS_DDL)
        if most > 1:
            # a long block: each pair of its pieces is a work of its own, wherever it is done
            cut = weighted.filter("of > 1").mapInArrow(_weighted, "rb long, of long, piece long, i array<long>, j array<long>, value array<double>, x array<double>")
            left = cut.select("rb", F.col("piece").alias("pa"), F.explode(F.sequence(F.col("piece"), F.col("of") - 1)).alias("pb"), F.col("i").alias("on_a"), F.col("j").alias("a"), "x").filter("pa < pb")
            right = cut.filter("piece > 0").select("rb", F.col("piece").alias("pb"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("piece") - 1)).alias("pa"), F.col("i").alias("on_b"), F.col("j").alias("b"), F.col("value").alias("y"))
            products = products.unionAll(_products_of(left, right, ("rb", "pa", "pb"), n * most, True))
        met = pairs_met(self.tiles.select(F.explode("i").alias("i")), None, "i", n)
        upper = _summed(products, min((met + n) // 2, self.n_columns * (self.n_columns + 1) // 2))
        turned = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
        both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(turned)
        return upper.select(F.explode(both).alias("e"), "value").select("e.i", "e.j", "value")

    def dot(self, other: "TiledMatrix") -> DataFrame:
        """The product with another sparse matrix as (i, j, value): tiles meet on the blocks between them."""
        if self.n_columns != other.n_rows:
            raise ValueError(f"shapes not aligned: {self.shape} and {other.shape}")
        a, b = self.entries().select(F.col("j").alias("k"), F.col("i").alias("to"), "value"), other.entries().select(F.col("i").alias("k"), F.col("j").alias("to"), "value")
        n = self._n_entries() + other._n_entries()
        block = max(1, min(self.n_columns, TILE_ENTRIES * self.n_columns // max(1, n)))
        a, b = (x.withColumn("kb", F.expr(f"k DIV {block}")) for x in (a, b))
        count = lambda x, name: x.groupBy("kb").agg((F.floor((F.count(F.lit(1)) - 1) / PIECE) + 1).alias(name))
        sizes = count(a, "ga").join(count(b, "gb"), "kb")
        sent = sizes.agg(F.max(F.greatest("ga", "gb"))).first()[0] or 1
        sizes = F.broadcast(sizes)  # a row for each ``TILE_ENTRIES`` entries
        left = _dealt(a.join(sizes, "kb").withColumn("pa", F.pmod(F.xxhash64("to"), "ga")), n, ("kb", "pa", "gb"), ("k", "to", "value"))
        right = _dealt(b.join(sizes, "kb").withColumn("pb", F.pmod(F.xxhash64("to"), "gb")), n, ("kb", "pb", "ga"), ("k", "to", "value"))
        left = left.select("kb", "pa", F.explode(F.sequence(F.lit(0).cast("long"), F.col("gb") - 1)).alias("pb"), F.col("k").alias("on_a"), F.col("to").alias("a"), F.col("value").alias("x"))
        right = right.select("kb", "pb", F.explode(F.sequence(F.lit(0).cast("long"), F.col("ga") - 1)).alias("pa"), F.col("k").alias("on_b"), F.col("to").alias("b"), F.col("value").alias("y"))
        return _summed(_products_of(left, right, ("kb", "pa", "pb"), n * sent, False), min(pairs_met(a, b, "k", n), self.n_rows * other.n_columns))

    def with_blocks(self, row_block: int, col_block: int) -> "TiledMatrix":
        placed = self.entries().withColumn("rb", F.expr(f"i DIV {row_block}")).withColumn("cb", F.expr(f"j DIV {col_block}"))
        return TiledMatrix(_dealt(placed, self._n_entries()), self.n_rows, self.n_columns, row_block, col_block, self.column_names)

    def transpose(self) -> "TiledMatrix":
        tiles = self.tiles.select(F.col("cb").alias("rb"), F.col("rb").alias("cb"), F.col("j").alias("i"), F.col("i").alias("j"), "value")
        return TiledMatrix(tiles, self.n_columns, self.n_rows, self.col_block, self.row_block)

    def matvec(self, v: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None, exact: bool = False) -> DataFrame:
        """X[rows, cols] @ v[cols] as (row_id, value) for v as (j, x); rows without a product are absent."""
        m = self._limited(rows, cols)
        return m._by_vector(m.tiles, v, m.col_block, "cb", "j", "i", exact).withColumnRenamed("at", "row_id")

    def transpose_matvec(self, v: DataFrame, rows: DataFrame | None = None, cols: DataFrame | None = None, exact: bool = False) -> DataFrame:
        """X[rows, cols].T @ v[rows] as (j, value) for v as (i, x); columns without a product are absent."""
        m = self._limited(rows, cols)
        return m._by_vector(m.tiles, v, m.row_block, "rb", "i", "j", exact).withColumnRenamed("at", "j")

    @staticmethod
    def _by_vector(tiles: DataFrame, v: DataFrame, block: int, key: str, on: str, to: str, exact: bool) -> DataFrame:
        if block > WIDE:
            long = tiles.select(F.explode(F.arrays_zip("i", "j", "value")).alias("e")).select(F.col(f"e.{to}").alias("at"), F.col(f"e.{on}").alias("_on"), "e.value")
            v = v.toDF("_key", "_x").select(F.col("_key").cast("long"), F.col("_x").cast("double"))
            return long.join(v, F.col("_on") == F.col("_key")).groupBy("at").agg(total(F.col("value") * F.col("_x"), exact).alias("value"))
        met = tiles.join(_vector_blocks(v, block).withColumnRenamed("rb", key), key)
        place = lambda k: F.get(F.col("weights"), (k - F.col(key) * block).cast("int"))
        each = F.arrays_zip(F.col(to).alias("to"), F.col("value"), F.transform(on, place).alias("w"))
        long = met.select(F.explode(each).alias("e")).filter("e.w IS NOT NULL").select(F.col("e.to").alias("at"), (F.col("e.value") * F.col("e.w")).alias("p"))
        return long.groupBy("at").agg(total(F.col("p"), exact).alias("value"))

    def getcol(self, j: int) -> "TiledMatrix":
        """One column, as a matrix of one."""
        if not -self.n_columns <= j < self.n_columns:
            raise IndexError(f"column {j} of {self.n_columns}")
        j %= self.n_columns
        own = self.tiles.filter(F.col("cb") == j // self.col_block).select(F.explode(F.arrays_zip("i", "j", "value")).alias("e")).select("e.*").filter(F.col("j") == j)
        names = None if self.column_names is None else (self.column_names[j],)
        return TiledMatrix.from_coo(own.withColumn("j", F.lit(0)), self.n_rows, 1, self.row_block, 1, names)


def _within(entries: DataFrame, name: str, kept: DataFrame | None, n: int) -> DataFrame:
    """Entries whose ``name`` is in a table of numbers."""
    if kept is None:
        return entries
    return spread(entries, n, name).join(kept.select(F.col(kept.columns[0]).cast("long").alias(name)).distinct(), name, "left_semi")


def _dealt(placed: DataFrame, n: int, by: tuple[str, ...] = ("rb", "cb"), of: tuple[str, ...] = ("i", "j", "value")) -> DataFrame:
    """At most ``n`` entries with their tiles' numbers as tiles, sorted by row; a tile's cells bound its arrays."""
    tiles = spread(placed, n, *by).groupBy(*by).agg(F.sort_array(F.collect_list(F.struct(*of))).alias("e"))
    return written(tiles.select(*by, *[F.col(f"e.{c}").alias(c) for c in of]), "tiles")


def _vector_blocks(d: DataFrame, block: int) -> DataFrame:
    """A vector (number, value) as (rb, weights): for each block an array of as many places, null where there is no value."""
    d = d.toDF("at", "x").select(F.col("at").cast("long").alias("at"), F.col("x").cast("double").alias("x"))
    held = spread(d.withColumn("rb", F.expr(f"at DIV {block}")), d.count(), "rb").groupBy("rb").agg(F.sort_array(F.collect_list(F.struct("at", "x"))).alias("e"))
    return held.mapInArrow(lambda batches: _filled(batches, block), "rb long, weights array<double>")


def _filled(batches: Iterator[pa.RecordBatch], block: int) -> Iterator[pa.RecordBatch]:
    some = max(1, WIDE // block)
    for batch in (b.slice(k, some) for b in batches for k in range(0, b.num_rows, some)):
        rb = batch.column(0).to_numpy()
        pairs = batch.column(1)
        entries, sizes = pairs.flatten(), np.asarray(pairs.value_lengths())
        at, x = (entries.field(k).to_numpy(zero_copy_only=False) for k in range(2))
        places = at - np.repeat(rb * block, sizes) + np.repeat(np.arange(len(rb)) * block, sizes)
        values, there = np.zeros(len(rb) * block), np.zeros(len(rb) * block, dtype=bool)
        values[places], there[places] = x, True
        weights = pa.ListArray.from_arrays(pa.array(np.arange(len(rb) + 1) * block, pa.int32()), pa.array(values, mask=~there))
        yield pa.RecordBatch.from_arrays([batch.column(0), weights], ["rb", "weights"])


def _products_of(left: DataFrame, right: DataFrame, keys: tuple[str, ...], n: int, gram: bool) -> DataFrame:
    """Products of pairs of tiles with equal keys; ``n`` entries are sent, each as often as its tile has partners."""
    pairs = spread(left, n, *keys).join(right, list(keys)).select("on_a", "a", "x", "on_b", "b", "y")
    return pairs.mapInArrow(lambda batches: _multiplied(batches, gram), _CELLS_DDL)


def _summed(products: DataFrame, n: int) -> DataFrame:
    """Sums by cell, of ``n`` cells at most; tasks have added up what they could."""
    return spread(products, n, "i", "j").groupBy("i", "j").agg(F.sum("value").alias("value"))
