"""Queries over the events table as a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from . import from_formula
from .plans.scratch import shared_root
from .queries import EVENTS, S, events, query
from .streaming.runs import RunningSandwich, Runs

_CODE = "CASE event_type " + " ".join(f"WHEN '{x}' THEN {k + 1}" for k, x in enumerate(EVENTS)) + " END"


def _as_stream(spark, df, where: str, files: int):
    """The table written as some files and read as a stream, one file a batch."""
    df.repartition(files).write.parquet(f"{where}/in")
    return spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"{where}/in")


@query(
    f"SELECT 0::BIGINT AS i, 0::BIGINT AS j, {S('value * value')} AS value FROM events UNION ALL SELECT {_CODE}, {_CODE}, count(*) FROM events GROUP BY event_type "
    f"UNION ALL SELECT 0, {_CODE}, {S('value')} FROM events GROUP BY event_type UNION ALL SELECT {_CODE}, 0, {S('value')} FROM events GROUP BY event_type"
)
def running_sandwich(spark, sf_dir):
    """All events in six batches, by a spec frozen before; runs are merged by two on the way."""
    df = events(spark, sf_dir).select("value", "event_type")
    spec = from_formula("value + event_type", df).spec
    where = f"{shared_root(spark)}/running-{uuid.uuid4().hex}"
    kept = RunningSandwich(spec, "one", f"{where}/runs", fan=2, exact=True)
    stream = _as_stream(spark, df, where, 6).withColumn("one", F.lit(1.0))
    kept.start(stream, f"{where}/checkpoint").awaitTermination()
    assert len(Runs(spark, f"{where}/runs").whole()) <= 4
    return kept.result(spark)
