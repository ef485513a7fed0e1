"""A running sandwich over a stream, with a frozen model specification."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.matrix import DesignMatrix, accumulate


class SandwichStream:
    """``foreachBatch`` sink: each batch writes its cells under its number, so a batch that
    is run again replaces its own cells and counts once."""

    def __init__(self, build: Callable[[DataFrame], DesignMatrix], weight: str, path: str, exact: bool = False):
        self.build, self.weight, self.path, self.exact = build, weight, path, exact

    def __call__(self, batch: DataFrame, number: int) -> None:
        self.build(batch).sandwich(self.weight, exact=self.exact).write.mode("overwrite").parquet(f"{self.path}/batch={number}")

    def start(self, stream: DataFrame, checkpoint: str, **trigger):
        return stream.writeStream.foreachBatch(self).option("checkpointLocation", checkpoint).trigger(**(trigger or {"availableNow": True})).start()

    def result(self, spark: SparkSession) -> DataFrame:
        cells = spark.read.schema("i int, j int, value double, batch int").parquet(self.path)
        return accumulate(cells.select("i", "j", F.col("value")), exact=self.exact)
