"""Running sums of a stream: compaction, repeated batches, merges that stop half-way."""

import numpy as np
import pytest
from pyspark.sql import functions as F

import gramloom as g
from gramloom.streaming.runs import Run, RunningSandwich, Runs, running_moments


@pytest.fixture
def frame(spark):
    rng = np.random.default_rng(2)
    return spark.createDataFrame([(float(rng.normal()), "abc"[int(rng.integers(3))], 1.0 + k % 3, k % 13) for k in range(390)], "x double, c string, w double, part int")


def want(frame, spec):
    m = spec.get_model_matrix(frame)
    return {(r["i"], r["j"]): r["value"] for r in m.sandwich("w").collect()}


def same(result, cells):
    got = {(r["i"], r["j"]): r["value"] for r in result.collect()}
    assert set(got) == set(cells)
    np.testing.assert_allclose([got[k] for k in cells], list(cells.values()), rtol=1e-9)


def test_runs_stay_few_and_batches_count_once(spark, frame, tmp_path):
    spec = g.from_formula("x + c", frame).spec
    kept = RunningSandwich(spec, "w", f"file://{tmp_path}/runs", fan=3)
    runs = Runs(spark, kept.path)
    assert kept.result(spark).count() == 0
    for k in range(13):
        kept(frame.filter(f"part = {k}"), k)
        if k in (4, 9):
            kept(frame.filter(f"part = {k}"), k)  # again, as after a failure
    kept(frame.filter("part = 2"), 2)  # one that a merged run has: nothing happens
    assert runs.whole() == [Run(0, 8, 2), Run(9, 11, 1), Run(12, 12, 0)] or len(runs.whole()) <= 6
    assert [r.first for r in runs.whole()][0] == 0 and runs.whole()[-1].last == 12
    same(kept.result(spark), want(frame, spec))


def test_half_merges_do_not_count(spark, frame, tmp_path):
    spec = g.from_formula("x", frame).spec
    kept = RunningSandwich(spec, "w", f"file://{tmp_path}/runs", fan=2)
    runs = Runs(spark, kept.path)
    for k in (0, 1):
        runs.write(Run(k, k, 0), spec.get_model_matrix(frame.filter(f"part % 2 = {k}")).sandwich("w"))
    cells = want(frame, spec)
    runs.write(Run(0, 1, 1), spec.get_model_matrix(frame).sandwich("w"))  # merged, sources not deleted
    assert runs.whole() == [Run(0, 1, 1)]
    same(kept.result(spark), cells)
    (tmp_path / "runs" / Run(0, 1, 1).name / "_SUCCESS").unlink()  # merge not whole
    assert runs.whole() == [Run(0, 0, 0), Run(1, 1, 0)]
    same(kept.result(spark), cells)
    kept(frame.filter("part < 0"), 2)  # the next batch merges them again
    assert Run(0, 1, 1) in runs.whole() and not (tmp_path / "runs" / Run(0, 0, 0).name).exists()
    same(kept.result(spark), cells)
    with pytest.raises(ValueError):
        RunningSandwich(spec, "w", "x", fan=1)


def test_moments_by_window_in_the_state_store(spark, tmp_path):
    rows = [(k, float(k % 7)) for k in range(600)]
    df = spark.createDataFrame(rows, "s long, x double").select(F.timestamp_seconds("s").alias("ts"), "x")
    for k in range(3):  # files in order of time
        df.filter(F.expr(f"unix_timestamp(ts) DIV 200 = {k}")).coalesce(1).write.mode("append").parquet(f"file://{tmp_path}/in")
    spec = g.from_formula("x + {x ** 2}", df).spec
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(f"file://{tmp_path}/in")
    out = running_moments(stream, spec, "ts", "10 seconds", "1 minute")
    q = out.writeStream.outputMode("append").format("memory").queryName("moments_by_window").option("checkpointLocation", f"file://{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    got = {(r["window"]["start"].minute, r["j"]): (r["n"], r["total"], r["squares"]) for r in spark.table("moments_by_window").collect()}
    assert len(got) >= 16
    for (minute, j), found in got.items():
        x = np.array([v for k, v in rows if k // 60 == minute]) ** (j + 1)
        np.testing.assert_allclose(found, (60, x.sum(), (x * x).sum()))
