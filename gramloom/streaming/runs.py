"""Running sums of a stream in compacted runs: what is read for a result does not grow with the batches.

Each batch leaves one run, its cells (i, j, value) summed.  When ``fan`` runs of one level have
come, they are summed to one run of the next level, so that n batches are about
``fan * log(n)`` runs.  A run's name tells which batches it holds, and a run counts once it is
whole (Spark's _SUCCESS file is there):

* a batch that is run again replaces its own run, or is left alone if a merged run has it
  already; only batches before the current one are merged, and Spark repeats no other;
* a merge that stops half-way leaves a run that does not count, or one beside those it was made
  of; those within another one's batches are not read, and are deleted by the next merge.
"""

from __future__ import annotations

import re
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.formula import Spec
from ..operators.matrix import DesignMatrix, accumulate

_NAME = re.compile(r"run-(\d+)-(\d+)-level-(\d+)$")


@dataclass(frozen=True)
class Run:
    first: int
    last: int
    level: int

    @property
    def name(self) -> str:
        return f"run-{self.first}-{self.last}-level-{self.level}"

    def within(self, other: "Run") -> bool:
        return self != other and other.first <= self.first and self.last <= other.last


class Runs:
    """The runs in a shared folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self._at = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._at(self.path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())

    def whole(self) -> list[Run]:
        """Runs that count, by batches; those within another one are left out."""
        if not self._fs.exists(self._at(self.path)):
            return []
        names = [s.getPath().getName() for s in self._fs.listStatus(self._at(self.path)) if s.isDirectory()]
        found = [Run(*map(int, m.groups())) for m in map(_NAME.match, names) if m]
        found = [r for r in found if self._fs.exists(self._at(f"{self.path}/{r.name}/_SUCCESS"))]
        return sorted((r for r in found if not any(r.within(o) for o in found)), key=lambda r: r.first)

    def read(self, runs: list[Run]) -> DataFrame:
        schema = "i long, j long, value double"
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{r.name}" for r in runs]) if runs else self.spark.createDataFrame([], schema)

    def write(self, run: Run, cells: DataFrame) -> None:
        cells.select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"), "value").write.mode("overwrite").parquet(f"{self.path}/{run.name}")

    def clear(self, merged: Run) -> None:
        """Delete the runs within a merged one."""
        for s in self._fs.listStatus(self._at(self.path)):
            m = _NAME.match(s.getPath().getName())
            if m and Run(*map(int, m.groups())).within(merged):
                self._fs.delete(s.getPath(), True)


class RunningSandwich:
    """``foreachBatch`` sink that keeps X' diag(d) X of all rows so far, by a frozen spec."""

    def __init__(self, spec: Spec | Callable[[DataFrame], DesignMatrix], weight: str, path: str, fan: int = 8, exact: bool = False):
        if fan < 2:
            raise ValueError("two runs at least are merged at once")
        self.build = spec.get_model_matrix if isinstance(spec, Spec) else spec
        self.weight, self.path, self.fan, self.exact = weight, path, fan, exact

    def __call__(self, batch: DataFrame, number: int) -> None:
        runs = Runs(batch.sparkSession, self.path)
        if any(r.level and r.first <= number <= r.last for r in runs.whole()):
            return
        runs.write(Run(number, number, 0), self.build(batch).sandwich(self.weight, exact=self.exact))
        self.compact(runs, number)

    def compact(self, runs: Runs, before: int) -> None:
        """Merge the oldest ``fan`` neighbours of a level, as long as there are so many before a batch."""
        level = 0
        while level <= max((r.level for r in runs.whole()), default=-1):
            same = [r for r in runs.whole() if r.level == level and r.last < before]
            if len(same) < self.fan:
                level += 1
                continue
            some = same[: self.fan]
            merged = Run(some[0].first, some[-1].last, level + 1)
            runs.write(merged, accumulate(runs.read(some), exact=self.exact))
            runs.clear(merged)

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def result(self, spark: SparkSession) -> DataFrame:
        """(i, j, value) of all batches that are whole."""
        runs = Runs(spark, self.path)
        return accumulate(runs.read(runs.whole()), exact=self.exact)


def running_moments(stream: DataFrame, spec: Spec, watermark: str, delay: str, window: str) -> DataFrame:
    """Sums of a formula's numeric columns by windows of event time, kept in Spark's state store.

    Rows (window, j, n, total, squares); a window leaves the state when the watermark has passed it.
    """
    m = spec.get_model_matrix(stream)
    numeric = [(b, a) for b, a in zip(m.blocks, m.offsets()) if hasattr(b, "value")]
    late = m.df.withWatermark(watermark, delay)
    sums = [x for b, a in numeric for x in (F.count(b.value).alias(f"n{a}"), F.sum(b.value).alias(f"t{a}"), F.sum(b.value * b.value).alias(f"q{a}"))]
    grouped = late.groupBy(F.window(watermark, window)).agg(*sums)
    rows = F.array(*[F.struct(F.lit(a).alias("j"), F.col(f"n{a}").alias("n"), F.col(f"t{a}").alias("total"), F.col(f"q{a}").alias("squares")) for _, a in numeric])
    return grouped.select("window", F.explode(rows).alias("e")).select("window", "e.*")
