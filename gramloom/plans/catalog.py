"""Blocks of a design matrix: expressions over one DataFrame, with names.

A block is either one numeric column or all indicator columns of one categorical
variable.  A categorical block is never expanded in reductions; it is a code expression
(0-based column inside the block, null where the row is all zero) and a multiplier.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import Column
from pyspark.sql import functions as F

from .level_table import LevelTable

DENSE, SPARSE, CATEGORICAL = "dense", "sparse", "categorical"


@dataclass(frozen=True)
class Numeric:
    """One numeric column; ``kind`` records dense or sparse storage and changes no result."""

    value: Column
    name: str | None = None
    term: str | None = None
    kind: str = DENSE
    #: The array column and the place in it that hold the value as it is, if one does.
    packed: tuple[str, int] | None = None

    width = 1

    def names(self) -> list[str | None]:
        return [self.name]

    def terms(self) -> list[str | None]:
        return [self.term if self.term is not None else self.name]

    def scaled(self, by: Column) -> "Numeric":
        return replace(self, value=self.value * by, packed=None)

    def entries(self, first: int) -> list[tuple[Column, Column]]:
        return [(F.lit(first), self.value)]


@dataclass(frozen=True)
class Categorical:
    """Indicator columns of one variable (or of an interaction), times a multiplier.

    ``code`` counts levels from 0 and is null for missing rows; with ``drop_first`` the
    first level has no column.
    """

    code: Column
    levels: Sequence
    name: str | None = None
    term: str | None = None
    drop_first: bool = False
    multiplier: Column | None = None
    form: str = "{name}[{category}]"
    column_names: Sequence[str] | None = None
    source: Column | None = None
    #: Of a block that waits for a join: the columns with the old and the new places.
    marks: tuple[str, str] | None = None

    kind = CATEGORICAL

    @property
    def width(self) -> int:
        return max(len(self.levels) - self.drop_first, 0)

    @property
    def position(self) -> Column:
        """The column inside the block, or null."""
        if not self.drop_first:
            return self.code
        return F.when(self.code >= 1, self.code - 1)

    @property
    def weight(self) -> Column:
        return F.lit(1.0) if self.multiplier is None else self.multiplier

    def names(self) -> list[str | None]:
        if self.column_names is not None:
            return list(self.column_names)
        if self.name is None:
            return [None] * self.width
        return [self.form.format(name=self.name, category=c) for c in self.levels[int(self.drop_first) :]]

    def terms(self) -> list[str | None]:
        return [self.term if self.term is not None else self.name] * self.width

    def scaled(self, by: Column) -> "Categorical":
        return replace(self, multiplier=by if self.multiplier is None else self.multiplier * by)

    def variable_of(self, names: Sequence[str | None]) -> str | None:
        """The variable's name if these are its columns' names in the block's format, else None."""
        if None in names or not names or "{name}" not in self.form:
            return None
        category = self.levels[int(self.drop_first)]
        before, after = (x.format(category=category) for x in self.form.split("{name}", 1))
        first = names[0]
        if not (first.startswith(before) and first.endswith(after) and len(first) >= len(before) + len(after)):
            return None
        name = first[len(before) : len(first) - len(after)]
        made = [self.form.format(name=name, category=c) for c in self.levels[int(self.drop_first) :]]
        return name if made == list(names) else None

    def masked(self, places: Sequence[int], most: int) -> tuple["Categorical", list[tuple[int, int]] | None]:
        """Some distinct columns of the block in the order given, as a block: codes are moved, never unrolled.

        Up to ``most`` runs of consecutive places become one expression; beyond, the second
        result lists (old place, new place) for the join that ``marks`` names.  Where the
        missing level is taken, it comes last.  Names are not looked up.
        """
        runs: list[list[int]] = []  # first place, last place, first new place
        for new, old in enumerate(places):
            if runs and old == runs[-1][1] + 1:
                runs[-1][1] = old
            else:
                runs.append([old, old, new])

        def moved(place: Column) -> Column:
            out = F.when(F.lit(False), F.lit(None).cast("int"))
            for a, b, new in runs:
                out = out.when(place.between(a, b), (place - a + new).cast("int"))
            return out

        own = None if self.column_names is None else [self.column_names[k] for k in places] if isinstance(self.column_names, (list, tuple)) else None
        if isinstance(self.levels, LevelTable):
            takes_missing = bool(self.levels.extra) and self.width - 1 in places
            place = F.col("code") - int(self.drop_first)
            table = self.levels.df if len(runs) > most else self.levels.df.select("level", moved(place).alias("code")).filter("code IS NOT NULL")
            levels: Sequence = replace(self.levels, df=table, known=len(places) - takes_missing, extra=self.levels.extra if takes_missing else ())
        else:
            levels = [self.levels[k + self.drop_first] for k in places] if isinstance(self.levels, (list, tuple)) else list(self.levels[int(self.drop_first) :][k] for k in places)
        block = replace(self, levels=levels, drop_first=False, column_names=own)
        if len(runs) <= most:
            return replace(block, code=moved(self.position)), None
        marks = tuple(f"_mask{uuid.uuid4().hex[:12]}_{x}" for x in ("old", "new"))
        return replace(block, code=F.col(marks[1]), marks=marks), [(int(old), new) for new, old in enumerate(places)]

    def column(self, k: int) -> Numeric:
        """Its k-th indicator column, as a numeric block."""
        value = F.when(self.position == k, self.weight).otherwise(F.lit(0.0))
        name = self.column_names[k] if self.column_names is not None else None if self.name is None else self.form.format(name=self.name, category=self.levels[k + self.drop_first])
        return Numeric(value, name, self.term if self.term is not None else self.name, SPARSE)


Block = Numeric | Categorical
