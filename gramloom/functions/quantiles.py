"""Exact quantiles by histogram refinement: no task holds more than ``BINS`` counts for a rank."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

BINS = 1024


def _bin(a: float, b: float) -> Column:
    """The part of [a, b] that x is in; its ends are in different parts, so that each round narrows the range."""
    s = 1.0 if math.isfinite(b - a) else 0.5
    inner = F.floor((F.col("x") * s - a * s) / (b * s - a * s) * BINS).cast("int") if math.isfinite(b * s - a * s) else F.lit(1)
    return F.when(F.col("x") == a, 0).when(F.col("x") == b, BINS - 1).otherwise(F.least(F.lit(BINS - 1), inner))


def percentiles(df: DataFrame, x: Column, at: Sequence[float]) -> tuple[float, float, list[float]]:
    """Minimum, maximum and the interpolated quantiles of ``x``, nulls and NaN left out, equal to F.percentile.

    Each round counts the values of a range in equal parts and goes on with the part that
    holds the rank, until all its values are the same.  All ranks share the rounds.
    """
    values = df.select(x.cast("double").alias("x")).filter("x IS NOT NULL AND NOT isnan(x)")
    low, high, n = values.agg(F.min("x"), F.max("x"), F.count("x")).first()
    if not n:
        raise ValueError("no values to take quantiles of")
    ranks = sorted({r for p in at for r in (math.floor(p * (n - 1)), math.ceil(p * (n - 1)))})
    found: dict[int, float] = {}
    ranges = {(low, high): [(r, r) for r in ranks]}  # ranges with ranks: of all values, and inside the range
    while ranges:
        for (a, b), own in list(ranges.items()):
            if a == b:
                found |= {r: a for r, _ in own}
                del ranges[a, b]
        if not ranges:
            break
        # a part's least and greatest values bound the next range
        cut = [F.when(F.col("x").between(a, b), F.struct(F.lit(k).alias("k"), _bin(a, b).alias("bin"))) for k, (a, b) in enumerate(ranges)]
        parts = values.select("x", F.coalesce(*cut).alias("p")).filter("p IS NOT NULL").groupBy("p.k", "p.bin").agg(F.count("x").alias("c"), F.min("x").alias("low"), F.max("x").alias("high"))
        counts = sorted(tuple(r) for r in parts.collect())
        nxt: dict[tuple[float, float], list[tuple[int, int]]] = {}
        for k, own in enumerate(ranges.values()):
            for whole, inside in own:
                before = 0
                for _, _, c, a, b in (y for y in counts if y[0] == k):
                    if inside < before + c:
                        nxt.setdefault((a, b), []).append((whole, inside - before))
                        break
                    before += c
        ranges = nxt
    out = []
    for p in at:
        pos = p * (n - 1)
        under, over = math.floor(pos), math.ceil(pos)
        out.append(found[under] if under == over or found[under] == found[over] else (over - pos) * found[under] + (pos - under) * found[over])
    return float(low), float(high), [float(v) for v in out]
