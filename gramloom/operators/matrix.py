"""DesignMatrix: blocks over one DataFrame, and the reductions on them.

Row vectors (weights ``d``, ``v`` of transpose_matvec) are columns or expressions of the
same DataFrame (``with_row_vector`` brings them from another table); column vectors are lists,
or tables (j, value).  ``rows`` is a predicate, or a list of row ids; ``numbered`` gives rows
places, by which ``take`` and indexing pick them in any order and as often as asked.
``cols`` is a list of column numbers, in any order.  Results are DataFrames in long form:
matvec (row id, value), transpose_matvec (j, value), sandwich (i, j, value).  Cells of a
sandwich that no row touches are absent; :func:`to_numpy` reads them as 0.

``exact=True`` rounds each term to six decimal places (a number: to so many) and adds up
decimals instead of doubles, so that sums do not depend on the order of rows; terms need
18 digits or fewer before the point.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.levels import LevelTable
from ..plans.catalog import DENSE, SPARSE, Block, Categorical, Numeric
from ..plans.spread import TASK_ROWS, spread
from . import moments
from . import rows as by_position
from . import several

#: Up to so many numeric columns the Gram sums are unrolled into one aggregate; wider ones go through Arrow.
UNROLLED = 12
#: Up to so many rows a table made of a list is broadcast (a few MB); Spark knows no size of it.
BROADCAST_ROWS = 100_000
#: Up to so many levels a matvec looks the vector up in a literal array; beyond, it joins.
LOOKUP = 64


#: Up to so many combinations of codes rows are first summed by all codes at once, and the sums are regrouped.
COMBINED = 4096


def _addend(term: Column, exact: bool) -> Column:
    """The term as it is added up: a double, or a decimal of so many places."""
    places = 6 if exact is True else int(exact)
    return term if exact is False else term.cast(f"decimal({18 + places},{places})")


def total(term: Column, exact: bool) -> Column:
    """The sum of a term over rows; an empty input gives null."""
    return F.sum(_addend(term, exact)).cast("double")


def _ranges(numbers: Sequence[int]) -> list[tuple[int, int]]:
    """Ascending numbers as ranges (first, last)."""
    if isinstance(numbers, range) and numbers.step == 1:
        return [(numbers[0], numbers[-1])] if len(numbers) else []
    x = np.asarray(numbers)
    cut = np.flatnonzero(np.diff(x) != 1)
    return [(int(a), int(b)) for a, b in zip(x[np.r_[0, cut + 1]], x[np.r_[cut, len(x) - 1]])] if len(x) else []


def _only(cells: DataFrame, column: str, numbers: Sequence[int], p: int) -> DataFrame:
    """Cells whose ``column`` is among the ascending numbers: by ranges if they are few, else by a join."""
    found = _ranges(numbers)
    if found == [(0, p - 1)]:
        return cells
    if len(found) <= LOOKUP:
        return cells.filter(reduce(lambda a, b: a | b, [F.col(column).between(a, b) for a, b in found], F.lit(False)))
    wanted = cells.sparkSession.createDataFrame([(int(k),) for k in numbers], f"{column} int")
    return cells.join(wanted, column, "left_semi")


def _union(parts: list[DataFrame]) -> DataFrame:
    return reduce(DataFrame.unionAll, parts)


def _numbers(df: DataFrame, on: Sequence[int]) -> DataFrame:
    """Column numbers as rows: made where they are needed if they follow each other."""
    if on[-1] - on[0] == len(on) - 1:
        return df.sparkSession.range(on[0], on[-1] + 1).select(F.col("id").cast("int").alias("j"))
    return df.sparkSession.createDataFrame([(j,) for j in on], "j int")


def to_numpy(result: DataFrame, *shape: int) -> np.ndarray:
    """A long-form result, (j, value) or (i, j, value), as an array with zeros filled in."""
    out = np.zeros(shape)
    keys = result.columns[:-1]
    for r in result.toPandas().itertuples(index=False):
        out[tuple(int(getattr(r, k)) for k in keys)] = r.value
    return out


@dataclass(frozen=True)
class DesignMatrix:
    df: DataFrame
    blocks: tuple[Block, ...]
    row_id: str | None = None
    spec: object = None
    #: The rows before codes of many levels were joined to them; sums are grouped by value on these.
    base: DataFrame | None = None
    #: Whether row ids are places 0 .. n - 1.
    placed: bool = False

    # -- shape and names -------------------------------------------------------

    @property
    def _rows(self) -> DataFrame:
        """The rows for sums that need no joined code."""
        return self.df if self.base is None else self.base

    @property
    def n_columns(self) -> int:
        return sum(b.width for b in self.blocks)

    @property
    def shape(self) -> tuple[int, int]:
        return self.df.count(), self.n_columns

    def offsets(self) -> list[int]:
        return [int(x) for x in np.cumsum([0, *[b.width for b in self.blocks]])[:-1]]

    def get_names(self, type: str = "column", missing_prefix: str | None = None) -> list[str | None]:
        if type not in ("column", "term"):
            raise ValueError(f"type is 'column' or 'term', not {type!r}")
        out: list[str | None] = []
        for b, at in zip(self.blocks, self.offsets()):
            names = b.names() if type == "column" else b.terms()
            if missing_prefix is not None and b.width and names[0] is None:
                if isinstance(b, Categorical):
                    label = f"{missing_prefix}{at}-{at + b.width - 1}"
                    names = [b.form.format(name=label, category=c) for c in b.levels[int(b.drop_first) :]] if type == "column" else [label] * b.width
                else:
                    names = [f"{missing_prefix}{at}"]
            out += names
        return out

    column_names = property(get_names)
    term_names = property(lambda self: self.get_names("term"))

    def set_names(self, names: Sequence[str | None] | str, type: str = "column") -> "DesignMatrix":
        """A matrix with other names: a full list, or one name per block."""
        if type not in ("column", "term"):
            raise ValueError(f"type is 'column' or 'term', not {type!r}")
        names = [names] if isinstance(names, str) else list(names)
        per_block = len(names) == len(self.blocks) != self.n_columns
        if not per_block and len(names) != self.n_columns:
            raise ValueError(f"{len(names)} names for {self.n_columns} columns in {len(self.blocks)} blocks")
        blocks, at = [], 0
        for k, b in enumerate(self.blocks):
            own = [names[k]] if per_block else names[at : at + b.width]
            at += b.width
            if type == "term":
                blocks.append(replace(b, term=own[0] if own else None))
            elif isinstance(b, Numeric):
                blocks.append(replace(b, name=own[0]))
            elif per_block or (len(own) > 1 and len(set(own)) == 1):
                blocks.append(replace(b, name=own[0], column_names=None))
            else:
                # full names that follow the block's format say what its variable is called
                name = b.variable_of(own)
                blocks.append(replace(b, column_names=tuple(own)) if name is None else replace(b, name=name, column_names=None))
        return replace(self, blocks=tuple(blocks))

    def __repr__(self) -> str:
        return "DesignMatrix(" + ", ".join(f"{b.kind}:{b.names()[0] if b.width == 1 else b.name}x{b.width}" for b in self.blocks) + ")"

    # -- rows and columns ------------------------------------------------------

    def filter(self, rows: Column | str | Sequence | None) -> "DesignMatrix":
        """Rows by predicate (pushed to the scan) or by a set of row ids."""
        if rows is None:
            return self

        def on_both(f) -> "DesignMatrix":
            return replace(self, df=f(self.df), base=None if self.base is None else f(self.base))

        if isinstance(rows, (Column, str)):
            return on_both(lambda df: df.filter(rows))
        if not isinstance(rows, slice):
            rows = list(dict.fromkeys(rows))
            if not rows:
                return on_both(lambda df: df.filter(F.lit(False)))
        if self.row_id is None:
            raise ValueError("row numbers need a row_id")
        number = F.col(self.row_id)
        if isinstance(rows, slice):
            # row ids run over 0 .. n - 1 here; n is counted only where the slice needs it
            plain = all(x is None or x >= 0 for x in (rows.start, rows.stop, rows.step))
            if plain and rows.step != 0:
                start, step = rows.start or 0, rows.step or 1
                inside = (number >= start) & (F.pmod(number - start, F.lit(step)) == 0)
                return on_both(lambda df: df.filter(inside if rows.stop is None else inside & (number < rows.stop)))
            return self.filter(range(self.df.count())[rows])
        if any(r < 0 for r in rows):
            n = self.df.count()
            if any(not -n <= r < n for r in rows):
                raise IndexError(f"row index out of range for {n} rows")
            rows = [r % n for r in rows]
        if len(rows) <= 1000:
            return on_both(lambda df: df.filter(number.isin(rows)))
        ids = self.df.sparkSession.createDataFrame([(r,) for r in rows], f"{self.row_id} long")
        return on_both(lambda df: df.join(ids, self.row_id, "left_semi"))

    def numbered(self, order_by: Sequence[Column | str] = (), name: str = "_row") -> "DesignMatrix":
        """The matrix with places as row ids, in the order of ``order_by`` or as the rows stand; see :mod:`rows`."""
        return by_position.numbered(self, order_by, name)

    def take(self, rows: Sequence[int] | DataFrame, cols: Sequence[int] | None = None) -> "DesignMatrix":
        """Rows by place with order and repeats kept, a list or a table (place, row), and columns in the order given."""
        return by_position.take(self, rows, BROADCAST_ROWS).select(cols)

    def with_row_vector(self, vector: DataFrame, name: str, checked: bool = True) -> "DesignMatrix":
        """A table (id, value) beside the rows, as the column ``name``; it must have each row's id once."""
        return by_position.with_row_vector(self, vector, name, checked)

    def _check_cols(self, cols: Sequence[int] | None) -> Sequence[int]:
        p = self.n_columns
        if cols is None:
            return range(p)
        cols = [int(c) for c in cols]
        if any(not -p <= c < p for c in cols):
            raise IndexError(f"column index out of range for {p} columns")
        return [c % p for c in cols]

    def getcol(self, i: int) -> "DesignMatrix":
        (i,) = self._check_cols([i])
        for b, at in zip(self.blocks, self.offsets()):
            if at <= i < at + b.width:
                if isinstance(b, Numeric):
                    return replace(self, blocks=(b,))
                # of many levels, one is a block of a single level, whose name is looked up when asked for
                return self._masked(b, [i - at]) if isinstance(b.levels, LevelTable) else replace(self, blocks=(b.column(i - at),), base=None)
        raise IndexError(i)

    def _masked(self, b: Categorical, places: Sequence[int]) -> "DesignMatrix":
        """A matrix of some distinct columns of a categorical block in a given order, as a block again."""
        block, kept = b.masked(places, LOOKUP)
        if kept is None:
            return replace(self, blocks=(block,))
        table = self.df.sparkSession.createDataFrame(kept, f"{block.marks[0]} int, {block.marks[1]} int")
        table = F.broadcast(table) if len(kept) <= BROADCAST_ROWS else table
        levels = b.levels
        if isinstance(levels, LevelTable):
            place = F.col("code") - int(b.drop_first)
            own = levels.df.join(table, place == F.col(block.marks[0])).select("level", F.col(block.marks[1]).alias("code"))
            block = replace(block, levels=replace(block.levels, df=own))
        df = self.df.join(table, b.position == F.col(block.marks[0]), "left").drop(block.marks[0])
        return replace(self, df=df, blocks=(replace(block, marks=None),))

    def select(self, cols: Sequence[int] | None) -> "DesignMatrix":
        """Columns in the order given; what is taken of a categorical block in a row stays a categorical block."""
        if cols is None:
            return self
        cols, out, k, df, indicators = self._check_cols(cols), [], 0, self.df, False
        starts = self.offsets()
        while k < len(cols):
            of = bisect_right(starts, cols[k]) - 1
            while not self.blocks[of].width:
                of -= 1
            b, at = self.blocks[of], starts[of]
            if isinstance(b, Numeric):
                out.append(b)
                k += 1
                continue
            run, seen, missing = k, set(), b.width - 1 if isinstance(b.levels, LevelTable) and b.levels.extra else None
            while run < len(cols) and at <= cols[run] < at + b.width and cols[run] not in seen and not (run > k and cols[run - 1] - at == missing):
                seen.add(cols[run])
                run += 1
            places = [c - at for c in cols[k:run]]
            if places == list(range(b.width)):
                out.append(b)
            elif len(places) == 1 and not isinstance(b.levels, LevelTable):
                out.append(b.column(places[0]))
                indicators = True
            else:
                part = replace(self, df=df)._masked(b, places)
                df, indicators = part.df, indicators or not isinstance(b.levels, LevelTable)
                out += part.blocks
            k = run
        # an indicator column needs its block's code beside it
        long = any(isinstance(getattr(b, "levels", None), LevelTable) for b in self.blocks)
        return replace(self, df=df, blocks=tuple(out), base=None if indicators and not long else self.base)

    def __getitem__(self, key) -> "DesignMatrix":
        rows, cols = key if isinstance(key, tuple) else (key, None)
        if isinstance(key, tuple) and len(key) > 2:
            raise ValueError("more than two indexers")
        rows = [rows] if isinstance(rows, int) else None if isinstance(rows, slice) and rows == slice(None) else rows
        if isinstance(rows, np.ndarray) and rows.dtype == bool or isinstance(rows, list) and rows and all(isinstance(r, bool) for r in rows):
            rows = [int(r) for r in np.flatnonzero(rows)]
        elif self.placed and isinstance(rows, (list, tuple, range, np.ndarray, DataFrame)):
            return self.take(rows, [cols] if isinstance(cols, int) else range(self.n_columns)[cols] if isinstance(cols, slice) else cols)
        if isinstance(cols, int):
            cols = [cols]
        elif isinstance(cols, slice):
            cols = range(self.n_columns)[cols]
        return self.filter(rows).select(cols) if cols is not None else self.filter(rows)

    # -- conversions -----------------------------------------------------------

    def _ids(self) -> list[str]:
        return [self.row_id] if self.row_id else []

    def to_wide(self) -> DataFrame:
        """One column per matrix column, for few columns only."""
        names = self.get_names(missing_prefix="_col_")
        values = [x for b in self.blocks for x in ([b.value.cast("double")] if isinstance(b, Numeric) else [b.column(k).value for k in range(b.width)])]
        return self.df.select(*self._ids(), *[v.alias(n) for v, n in zip(values, names)])

    def to_coo(self) -> DataFrame:
        """(row id, j, value) of the non-zero entries."""
        entries = []
        for b, at in zip(self.blocks, self.offsets()):
            j, v = (F.lit(at), b.value) if isinstance(b, Numeric) else (b.position + at, b.weight)
            entries.append(F.struct(j.cast("int").alias("j"), v.cast("double").alias("value")))
        long = self.df.select(F.col(self.row_id).alias("row_id"), F.explode(F.array(*entries)).alias("e"))
        return long.select("row_id", "e.j", "e.value").filter("j IS NOT NULL AND value <> 0")

    def transpose_coo(self) -> DataFrame:
        """The transposed matrix as (j, row id, value)."""
        return self.to_coo().select("j", "row_id", "value")

    def recover_orig(self, block: int = 0) -> DataFrame:
        """The variable behind a categorical block, missing as null."""
        b = self.blocks[block]
        if not isinstance(b, Categorical):
            raise TypeError("only categorical blocks have original values")
        if b.source is None and isinstance(b.levels, LevelTable):
            extra = F.when(b.code >= b.levels.known, F.lit(b.levels.extra[0])) if b.levels.extra else F.lit(None)
            table = b.levels.df.toDF("_level", "_level_code")
            return self.df.join(table, b.code == F.col("_level_code"), "left").select(*self._ids(), F.coalesce("_level", extra).alias("value"))
        value = F.when(b.code.isNotNull(), b.source) if b.source is not None else F.get(F.array(*[F.lit(x) for x in b.levels]), b.code)
        return self.df.select(*self._ids(), value.alias("value"))

    def astype(self, dtype: str) -> "DesignMatrix":
        """Numeric columns and multipliers cast; a new matrix."""
        cast = lambda b: replace(b, value=b.value.cast(dtype), packed=None) if isinstance(b, Numeric) else b if b.multiplier is None else replace(b, multiplier=b.multiplier.cast(dtype))
        return replace(self, blocks=tuple(map(cast, self.blocks)))

    def multiply(self, d: Column | str) -> "DesignMatrix":
        """Each row times d."""
        by = F.col(d) if isinstance(d, str) else d
        return replace(self, blocks=tuple(b.scaled(by) for b in self.blocks))

    # -- reductions ------------------------------------------------------------

    def matvec(self, v: Sequence[float] | DataFrame, cols: Sequence[int] | None = None) -> DataFrame:
        """X[:, cols] @ v[cols] as (row id, value); v has one number per column of X, in a list or a table (j, value)."""
        if isinstance(v, DataFrame):
            from .vectors import matvec_table

            return matvec_table(self, v, cols)
        if len(v) != self.n_columns:
            raise ValueError(f"shapes not aligned: {self.n_columns} columns, {len(v)} numbers")
        on = self._check_cols(cols)
        on = on if cols is None else set(on)
        df, terms = self.df, []
        for k, (b, at) in enumerate(zip(self.blocks, self.offsets())):
            own = [float(v[at + i]) if at + i in on else 0.0 for i in range(b.width)]
            if isinstance(b, Numeric):
                if at in on:
                    terms.append(b.value * F.lit(own[0]))
            elif any(own):
                if b.width <= LOOKUP:
                    hit = F.get(F.array(*[F.lit(x) for x in own]), b.position)
                else:
                    table = df.sparkSession.createDataFrame([(i, x) for i, x in enumerate(own) if x], f"_k{k} int, _v{k} double")
                    table = F.broadcast(table) if len(own) <= BROADCAST_ROWS else table
                    df, hit = df.join(table, b.position == F.col(f"_k{k}"), "left"), F.col(f"_v{k}")
                terms.append(F.coalesce(hit if b.multiplier is None else hit * b.weight, F.lit(0.0)))
        value = reduce(lambda a, b: a + b, terms) if terms else F.lit(0.0)
        return df.select(*[F.col(c).alias("row_id") for c in self._ids()], value.cast("double").alias("value"))

    def transpose_matvec(self, v: Column | str, rows=None, cols: Sequence[int] | None = None, exact: bool = False) -> DataFrame:
        """X[rows, cols].T @ v[rows] as (j, value), with zeros for levels that no row has.

        Numbers j are positions in X.  One aggregate for numeric columns, and one grouped
        by (block, level) for all categorical ones.
        """
        v = F.col(v) if isinstance(v, str) else v
        m, on = self.filter(rows), self._check_cols(cols)
        on = on if cols is None else sorted(set(on))
        at = m.offsets()
        numeric = [(b, a) for b, a in zip(m.blocks, at) if isinstance(b, Numeric) and a in on]
        cats = [(b, a) for b, a in zip(m.blocks, at) if isinstance(b, Categorical) and bisect_left(on, a) < bisect_left(on, a + b.width)]
        parts = [m._sums_by_value(b, a, v, on, exact) for b, a in cats if m._by_value(b)]
        cats = [(b, a) for b, a in cats if not m._by_value(b)]
        if numeric:
            sums = m._rows.agg(*[total(b.value * v, exact).alias(f"s{a}") for b, a in numeric])
            parts.append(sums.select(F.explode(F.array(*[F.struct(F.lit(a).alias("j"), F.col(f"s{a}").alias("value")) for _, a in numeric])).alias("e")).select("e.j", F.coalesce("e.value", F.lit(0.0)).alias("value")))
        if cats:
            plain = all(b.multiplier is None for b, _ in cats)
            terms = {"t0": v} if plain else {f"t{k}": v * b.weight for k, (b, _) in enumerate(cats)}
            rows_in = m.df.select(*[(b.position + a).cast("int").alias(f"c{k}") for k, (b, a) in enumerate(cats)], *[_addend(t, exact).alias(n) for n, t in terms.items()])
            rows_in = _combined(rows_in, [b for b, _ in cats], list(terms))
            each = F.array(*[F.struct(F.col(f"c{k}").alias("j"), F.col("t0" if plain else f"t{k}").alias("x")) for k in range(len(cats))])
            sums = rows_in.select(F.explode(each).alias("e")).filter("e.j IS NOT NULL").groupBy(F.col("e.j").alias("j")).agg(F.sum("e.x").cast("double").alias("value"))
            wanted = _union([_numbers(m.df, on[bisect_left(on, a) : bisect_left(on, a + b.width)]) for b, a in cats])
            parts.append(wanted.join(sums, "j", "left").select("j", F.coalesce("value", F.lit(0.0)).alias("value")))
        if not parts:
            return m.df.sparkSession.createDataFrame([], "j int, value double")
        return _union(parts)

    def _by_value(self, b: Block) -> bool:
        """Whether sums over a block of many levels are grouped by its value, and codes joined to the sums alone."""
        return isinstance(b, Categorical) and isinstance(b.levels, LevelTable) and b.source is not None and self.base is not None

    def _sums_by_value(self, b: Categorical, at: int, v: Column, on: Sequence[int], exact: bool) -> DataFrame:
        """(j, value) of one block: rows are summed by value in map tasks, then meet the level table."""
        term = v if b.multiplier is None else v * b.weight
        rows = self.base.select(b.source.alias("_value"), term.alias("_term"))
        if b.levels.known > TASK_ROWS:
            # sums of many levels would fill a map task, and be added up in ever larger parts
            rows = spread(rows, b.levels.known, "_value")
        sums = rows.groupBy("_value").agg(total(F.col("_term"), exact).alias("value"))
        table = b.levels.df.select("level", (F.col("code") + at - int(b.drop_first)).alias("j")).filter(F.col("j") >= at)
        found = table.join(sums, F.col("level") == F.col("_value"), "left").select("j", F.coalesce("value", F.lit(0.0)).alias("value"))
        if b.levels.extra:
            missing = sums.filter("_value IS NULL").agg(F.coalesce(F.sum("value"), F.lit(0.0)).alias("value"))
            found = found.unionAll(missing.select(F.lit(at + b.width - 1).alias("j"), "value"))
        own = on[bisect_left(on, at) : bisect_left(on, at + b.width)]
        return found if len(own) == b.width else _only(found, "j", own, self.n_columns)

    def sandwich(self, d: Column | str, rows=None, cols: Sequence[int] | None = None, exact: bool = False) -> DataFrame:
        """X[rows, cols].T @ diag(d[rows]) @ X[rows, cols] as (i, j, value), both triangles.

        Numeric cells are one aggregate (or Arrow partial sums when there are many
        columns); cells with a categorical are groupings of its codes, or of its values where
        it has many, all in one pass.  Of a categorical in ``cols`` in part, cells of the
        other levels are dropped by their numbers; it is never unrolled.
        """
        on = self._check_cols(cols)
        on = on if cols is None else sorted(set(on))
        upper = self.filter(rows)._cells(F.col(d) if isinstance(d, str) else d, exact, on, on)
        upper = _only(_only(upper, "i", on, self.n_columns), "j", on, self.n_columns)
        return _both_triangles(upper)

    def cross_sandwich(self, d: Column | str, left: Sequence[int], right: Sequence[int], rows=None, exact: bool = False) -> DataFrame:
        """X[rows, left].T @ diag(d[rows]) @ X[rows, right] as (i, j, value), numbered in X.

        Only blocks that cross are summed.
        """
        left, right = sorted(set(self._check_cols(left))), sorted(set(self._check_cols(right)))
        cells = self.filter(rows)._cells(F.col(d) if isinstance(d, str) else d, exact, left, right)
        both = _both_triangles(cells)
        return _only(_only(both, "i", left, self.n_columns), "j", right, self.n_columns)

    def _cells(self, d: Column, exact: bool, left: Sequence[int], right: Sequence[int]) -> DataFrame:
        """Cells i <= j that rows ``left`` and columns ``right`` of the result need, and some more of their blocks."""
        inside = lambda on, b, a: bisect_left(on, a) < bisect_left(on, a + b.width)
        placed = [(b, a, inside(left, b, a), inside(right, b, a)) for b, a in zip(self.blocks, self.offsets()) if b.width]
        placed = [x for x in placed if x[2] or x[3]]
        crosses = lambda x, y: x[2] and y[3] or x[3] and y[2]
        numeric = [x for x in placed if isinstance(x[0], Numeric)]
        cats = [x for x in placed if isinstance(x[0], Categorical)]
        pairs = [(x, y) for k, x in enumerate(numeric) for y in numeric[k:] if crosses(x, y)]
        parts = [_gram(self._rows, pairs, d, exact)] if pairs else []
        if any(crosses(x, y) for x in cats for y in placed):
            parts.append(_grouped(self, numeric, cats, crosses, d, exact))
        if not parts:
            return self.df.sparkSession.createDataFrame([], "i int, j int, value double")
        return _union(parts)

    def col_means(self, weights: Column | str, exact: bool = False) -> DataFrame:
        """(j, value): means by weights, which need not sum to 1."""
        w = F.col(weights) if isinstance(weights, str) else weights
        whole = self._rows.agg(total(w, exact).alias("w")).first()["w"]
        if not whole:
            raise ValueError("weights sum to 0")
        return self.transpose_matvec(w, exact=exact).select("j", (F.col("value") / F.lit(float(whole))).alias("value"))

    def col_stds(self, weights: Column | str, exact: bool = False) -> DataFrame:
        """(j, value): population standard deviations in one pass; with ``exact``, in two with decimals, for few columns."""
        if exact is False:
            return moments.col_stds(self, weights)
        w = F.col(weights) if isinstance(weights, str) else weights
        found = self.col_means(w, exact)
        plain = [(a, a + b.width) for b, a in zip(self.blocks, self.offsets()) if isinstance(b, Categorical) and b.multiplier is None and b.width]
        of_plain = reduce(lambda p, q: p | q, [F.col("j").between(a, e - 1) for a, e in plain], F.lit(False))
        scaled = [(b, a) for b, a in zip(self.blocks, self.offsets()) if isinstance(b, Categorical) and b.multiplier is not None and b.width]
        means = {r["j"]: r["value"] for r in found.filter(~of_plain).collect()}
        parts = [(a, total(w * (b.value - F.lit(means[a])) * (b.value - F.lit(means[a])), exact)) for b, a in zip(self.blocks, self.offsets()) if isinstance(b, Numeric)]
        parts += [(a + k, total(w * (b.column(k).value - F.lit(means[a + k])) ** 2, exact)) for b, a in scaled for k in range(b.width)]
        spark, out = self.df.sparkSession, []
        if parts:
            row = self.df.agg(total(w, exact).alias("w"), *[s.alias(f"s{j}") for j, s in parts])
            out.append(row.select(F.explode(F.array(*[F.struct(F.lit(j).alias("j"), F.sqrt(F.greatest(F.col(f"s{j}") / F.col("w"), F.lit(0.0))).alias("value")) for j, _ in parts])).alias("e")).select("e.j", "e.value"))
        if plain:
            out.append(found.filter(of_plain).select("j", F.sqrt(F.greatest(F.col("value") - F.col("value") * F.col("value"), F.lit(0.0))).alias("value")))
        return _union(out) if out else spark.createDataFrame([], "j int, value double")

    def standardize(self, weights: Column | str, center: bool = True, scale: bool = True, exact: bool = False):
        """(StandardizedView, means, stds or None); columns of almost no variance are not scaled."""
        from .standardized import StandardizedView

        p = self.n_columns
        means = to_numpy(self.col_means(weights, exact), p) if center else np.zeros(p)
        stds = to_numpy(self.col_stds(weights, exact), p) if scale else None
        mult = None if stds is None else np.where(np.abs(stds) < 1e-7, 1.0, 1 / np.where(np.abs(stds) < 1e-7, 1.0, stds))
        shift = -means if mult is None else -means * mult
        return StandardizedView(self, shift, mult), means, stds

    def matmul(self, v: np.ndarray, cols: Sequence[int] | None = None) -> DataFrame:
        """X @ V for V of one row per column of X: (row id, k, value), k the column of V."""
        v = np.asarray(v, dtype=float)
        if v.ndim != 2 or len(v) != self.n_columns:
            raise ValueError(f"shapes not aligned: {self.n_columns} columns, operand {v.shape}")
        return several.matmul(self, v, cols)

    def transpose_matmul(self, v: Sequence[Column | str], rows=None, cols: Sequence[int] | None = None, exact: bool = False) -> DataFrame:
        """X.T @ V for several row vectors: (j, k, value), k the place of the vector; all of them in the same passes."""
        return several.transpose_matmul(self, [F.col(x) if isinstance(x, str) else x for x in v], rows, cols, exact)

    def __matmul__(self, v) -> DataFrame:
        return self.matmul(v) if np.ndim(v) == 2 else self.matvec(v)

    def __rmatmul__(self, v) -> DataFrame:
        """v @ X; v is a row vector (a column or expression), or a list of them."""
        return self.transpose_matmul(v) if isinstance(v, (list, tuple)) else self.transpose_matvec(v)

    def densities(self) -> dict[int, float]:
        """Share of non-zero entries of every numeric column; a null counts as non-zero."""
        numeric = [(b, a) for b, a in zip(self.blocks, self.offsets()) if isinstance(b, Numeric)]
        if not numeric:
            return {}
        row = self._rows.agg(*[F.avg(F.coalesce(b.value != 0, F.lit(True)).cast("double")).alias(f"s{a}") for b, a in numeric]).first()
        return {a: row[f"s{a}"] or 0.0 for _, a in numeric}

    def split_density(self, threshold: float = 0.1) -> "DesignMatrix":
        """Numeric columns marked dense where more than ``threshold`` of their entries are not zero."""
        if not 0 <= threshold <= 1:
            raise ValueError(f"a share from 0 to 1 is needed, not {threshold}")
        share = self.densities()
        return replace(self, blocks=tuple(replace(b, kind=DENSE if share[a] > threshold else SPARSE) if isinstance(b, Numeric) else b for b, a in zip(self.blocks, self.offsets())))


def _both_triangles(upper: DataFrame) -> DataFrame:
    turned = F.array(F.struct("i", "j"), F.struct(F.col("j").alias("i"), F.col("i").alias("j")))
    both = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j"))).otherwise(turned)
    return upper.select(F.explode(both).alias("e"), "value").select("e.i", "e.j", "value")


def _gram(df: DataFrame, pairs: list, d: Column, exact: bool) -> DataFrame:
    """Cells of pairs of numeric columns."""
    numeric = list({x[1]: x for p in pairs for x in p}.values())
    if len(numeric) <= UNROLLED or exact:
        sums = df.agg(*[total(d * x[0].value * y[0].value, exact).alias(f"g{x[1]}_{y[1]}") for x, y in pairs])
        cells = [F.struct(F.lit(x[1]).alias("i"), F.lit(y[1]).alias("j"), F.coalesce(F.col(f"g{x[1]}_{y[1]}"), F.lit(0.0)).alias("value")) for x, y in pairs]
        return sums.select(F.explode(F.array(*cells)).alias("e")).select("e.i", "e.j", "e.value")
    k, at = len(numeric), np.array([x[1] for x in numeric], dtype=np.int32)
    i, j = np.triu_indices(k)

    def partial(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        gram = np.zeros((k, k))
        for batch in batches:
            rows = batch.column(0)
            x = rows.flatten().to_numpy(zero_copy_only=False).reshape(len(rows), k)  # all columns in one buffer
            gram += x.T @ (x * batch.column(1).to_numpy(zero_copy_only=False)[:, None])
        yield pa.RecordBatch.from_arrays([pa.array(np.minimum(at[i], at[j])), pa.array(np.maximum(at[i], at[j])), pa.array(gram[i, j])], ["i", "j", "value"])

    held = {x[0].packed[0] for x in numeric if x[0].packed}
    whole = len(held) == 1 and [x[0].packed and x[0].packed[1] for x in numeric] == list(range(k))
    # an array of other columns too cannot stand for these; it is cut down to them
    values = F.slice(F.col(f"`{held.pop()}`"), 1, k).cast("array<double>") if whole else F.array(*[x[0].value.cast("double") for x in numeric])
    packed = df.select(values.alias("x"), d.cast("double").alias("d"))
    return packed.mapInArrow(partial, "i int, j int, value double").groupBy("i", "j").agg(F.sum("value").alias("value"))


def _combined(rows: DataFrame, cats: Sequence[Categorical], terms: Sequence[str]) -> DataFrame:
    """Terms summed by all codes c0, c1, ... at once, if these have few combinations; else the rows as they are."""
    if math.prod(len(b.levels) + 1 for b in cats) > COMBINED:
        return rows
    return rows.groupBy(*[f"c{k}" for k in range(len(cats))]).agg(*[F.sum(t).alias(t) for t in terms])


def _grouped(m: DesignMatrix, numeric: list, cats: list, crosses, d: Column, exact: bool) -> DataFrame:
    """Cells with at least one categorical: groupings by one code and by pairs of codes, in one pass (GROUPING SETS).

    A block of many levels is grouped by its value, and its code is joined to the sums; then
    no row of the data is shuffled before it is summed.  Pairs stay in long form: only
    combinations that occur become rows.
    """
    n = len(cats)
    by_value = [m._by_value(b) for b, *_ in cats]
    source = m.base if m.base is not None and all(v or not isinstance(b.levels, LevelTable) for v, (b, *_) in zip(by_value, cats)) else m.df
    by_value = [v and source is m.base for v in by_value]
    keys = [F.col(f"c{k}") for k in range(n)]
    own = [(b.source if v else (b.position + a).cast("int")).alias(f"c{k}") for k, (v, (b, a, *_)) in enumerate(zip(by_value, cats))]

    def times(*blocks: int) -> Column:
        return reduce(lambda p, k: p * cats[k][0].multiplier if cats[k][0].multiplier is not None else p, blocks, d)

    ones = [(k,) for k in range(n) if any(crosses(cats[k], y) for y in [cats[k], *numeric])]
    pairs = [(k, h) for k in range(n) for h in range(k + 1, n) if crosses(cats[k], cats[h])]
    plain = all(b.multiplier is None for b, *_ in cats)
    terms = {"s": d} if plain else {f"s{'_'.join(map(str, s))}": times(s[0], s[-1]) for s in ones + pairs}
    met = [(k, x) for (k,) in ones for x in numeric if crosses(cats[k], x)]
    terms |= {f"x{x[1]}" if plain else f"x{k}_{x[1]}": times(k) * x[0].value for k, x in met}
    met = [(k, x[1]) for k, x in met]
    # terms are made once a row, before rows are multiplied by the groupings
    base = source.select(*own, *[_addend(t, exact).alias(f"t_{k}") for k, t in terms.items()])
    base = _combined(base, [b for b, *_ in cats], [f"t_{k}" for k in terms])
    grouped = base.groupingSets([[keys[k] for k in s] for s in ones + pairs], *keys).agg(F.grouping_id(*keys).alias("set"), *[F.sum(f"t_{k}").cast("double").alias(f"t_{k}") for k in terms])
    for k, (b, a, *_) in enumerate(cats):
        if by_value[k]:
            table = b.levels.df.select(F.col("level").alias(f"l{k}"), F.col("code").alias(f"n{k}"))
            grouped = grouped.join(table, F.col(f"c{k}") == F.col(f"l{k}"), "left")
            code = F.col(f"n{k}") if not b.levels.extra else F.when(F.col(f"c{k}").isNull(), F.lit(b.levels.known)).otherwise(F.col(f"n{k}"))
            code = F.when(code >= 1, code - 1) if b.drop_first else code
            grouped = grouped.withColumn(f"c{k}", (code + a).cast("int" if m.n_columns < 2**31 else "long")).drop(f"l{k}", f"n{k}")
    # each grouping's row carries its cells; nulls of a present key are missing rows
    number = lambda s: sum(1 << (n - 1 - k) for k in range(n) if k not in s)
    cells = None
    for s in ones + pairs:
        here = [F.col(f"c{k}") for k in s]
        made = [F.struct(F.least(here[0], here[-1]).alias("i"), F.greatest(here[0], here[-1]).alias("j"), F.col("t_s" if plain else f"t_s{'_'.join(map(str, s))}").alias("value"))]
        if len(s) == 1:
            made += [F.struct(F.least(here[0], F.lit(a)).alias("i"), F.greatest(here[0], F.lit(a)).alias("j"), F.col(f"t_x{a}" if plain else f"t_x{k}_{a}").alias("value")) for k, a in met if k == s[0]]
        chosen = (F.col("set") == number(s)) & reduce(lambda p, q: p & q, [c.isNotNull() for c in here])
        cells = F.when(chosen, F.array(*made)) if cells is None else cells.when(chosen, F.array(*made))
    return grouped.select(F.explode(cells).alias("e")).select("e.i", "e.j", "e.value")


def hstack(matrices: Sequence[DesignMatrix], by_place: bool = False) -> DesignMatrix:
    """Blocks side by side; matrices over different DataFrames are joined on their row ids, which must be the same.

    ``by_place`` numbers the rows of each first, as they stand, so that no ids are needed.
    """
    if not matrices:
        raise ValueError("hstack was given no matrix")
    if by_place and any(m.df is not matrices[0].df for m in matrices):
        matrices = by_position.by_place(matrices)
    first = matrices[0]
    blocks, df = list(first.blocks), first.df
    for k, m in enumerate(matrices[1:], 1):
        if m.df is first.df:
            blocks += m.blocks
            continue
        if not (first.row_id and m.row_id):
            raise ValueError("matrices over different DataFrames need row ids")
        own, new = [F.col(m.row_id).alias(f"_row{k}")], []
        for i, b in enumerate(m.blocks):
            if isinstance(b, Numeric):
                own.append(b.value.alias(f"_h{k}_{i}"))
                new.append(replace(b, value=F.col(f"_h{k}_{i}"), packed=None))
            else:
                own += [b.code.alias(f"_h{k}_{i}"), b.weight.alias(f"_w{k}_{i}")]
                new.append(replace(b, code=F.col(f"_h{k}_{i}"), source=None, multiplier=None if b.multiplier is None else F.col(f"_w{k}_{i}")))
        theirs = m.df.select(*own)
        pairs = df.select(F.col(first.row_id).alias("_a")).join(theirs.select(F.col(f"_row{k}").alias("_b")), F.col("_a") == F.col("_b"), "full")
        if pairs.filter("_a IS NULL OR _b IS NULL").limit(1).count():
            raise ValueError(f"matrix {k} has other rows than the first one")
        df = df.join(theirs, F.col(first.row_id) == F.col(f"_row{k}")).drop(f"_row{k}")
        blocks += new
    return replace(first, df=df, blocks=tuple(blocks), spec=None, base=first.base if df is first.df else None)


def arranged(matrices: Sequence[DesignMatrix], indices: Sequence[Sequence[int]], by_place: bool = False) -> DesignMatrix:
    """Matrices side by side with each column at a place of its own: ``indices[k]`` are the places of the k-th matrix's columns.

    The places must be 0 .. n - 1, each once.  Categorical blocks are cut where other columns
    come between, and stay blocks.
    """
    if len(indices) != len(matrices):
        raise ValueError(f"{len(indices)} lists of places for {len(matrices)} matrices")
    for k, (m, own) in enumerate(zip(matrices, indices)):
        if len(own) != m.n_columns:
            raise ValueError(f"matrix {k} has {m.n_columns} columns and {len(own)} places")
    flat = np.array([int(x) for own in indices for x in own], dtype=np.int64)
    order = np.argsort(flat, kind="stable")
    if not np.array_equal(flat[order], np.arange(len(flat))):
        raise ValueError(f"places must be 0 to {len(flat) - 1}, each once")
    return hstack(matrices, by_place).select([int(k) for k in order])


def accumulate(*results: DataFrame, exact: bool = False) -> DataFrame:
    """Sum of long-form results by their keys: what adding into an ``out`` array does.

    A result of some columns leaves the entries of all others as they are.
    """
    keys = results[0].columns[:-1]
    if any(r.columns != results[0].columns for r in results):
        raise ValueError("results of different shapes cannot be added: " + "; ".join(", ".join(r.columns) for r in results))
    return _union(list(results)).groupBy(*keys).agg(total(F.col("value"), exact).alias("value"))
