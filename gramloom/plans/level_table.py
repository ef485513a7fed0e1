"""The levels of a categorical variable as a table, for those of many levels."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T


@dataclass(frozen=True)
class LevelTable:
    """``df`` has level and code, in order of the levels; ``extra`` is the name of the missing level."""

    df: DataFrame
    known: int
    extra: tuple = ()

    def __len__(self) -> int:
        return self.known + len(self.extra)

    def __iter__(self) -> Iterator:
        """All levels on the driver, for those who ask for names."""
        yield from (r["level"] for r in self.df.orderBy("code").toLocalIterator())
        yield from self.extra

    def __getitem__(self, k):
        if isinstance(k, slice):
            return list(self)[k]
        k = range(len(self))[k]
        return self.extra[0] if k >= self.known else self.df.filter(F.col("code") == k).first()["level"]

    def __contains__(self, level) -> bool:
        of_kind = isinstance(level, str) == isinstance(self.df.schema["level"].dataType, T.StringType)
        return level in self.extra or (of_kind and bool(self.df.filter(F.col("level") == F.lit(level)).limit(1).count()))
