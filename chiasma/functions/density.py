"""Density curves that SQL has no functions for."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F


def dgamma(x: Column, shape: float, scale: float) -> Column:
    """The gamma density; its constant is computed once, so the column is an expression."""
    log_c = -math.lgamma(shape) - shape * math.log(scale)
    return F.when(x > 0, F.exp(F.lit(log_c) + (shape - 1) * F.ln(x) - x / scale)).otherwise(0.0)


def dexp(x: Column, mean: float) -> Column:
    return F.when(x >= 0, F.exp(-x / mean) / mean).otherwise(0.0)


def curve(spark, shape: float, scale: float, top: float, points: int = 200):
    """(x, gamma, exponential) on a grid from 0 to top."""
    x = F.col("id") * (top / (points - 1))
    return spark.range(points).select(x.alias("x"), dgamma(x, shape, scale).alias("gamma"), dexp(x, shape * scale).alias("exponential"))


def fitted_curves(fits, dist, value: str = "dist_mb", least: float = 0.1, points: int = 200):
    """(chrom, x, gamma, exponential): the densities of each fit (chrom, mean, nu, theta), on a grid from `least` to the largest
    distance of all; an exponential of the same mean beside it. Fits without parameters have no curve. The gamma function's
    logarithm is taken of the fits, a few numbers, in one batch; the curves are expressions."""
    def constants(batches):
        import pyarrow as pa

        for b in batches:
            c = [None if k is None or t is None else -math.lgamma(k) - k * math.log(t) for k, t in zip(b.column("nu").to_pylist(), b.column("theta").to_pylist(), strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(c, pa.float64())], [*b.schema.names, "log_c"])

    f = fits.select("chrom", "mean", "nu", "theta").mapInArrow(constants, "chrom string, mean double, nu double, theta double, log_c double").where("log_c IS NOT NULL")
    top = dist.agg(F.max(value).alias("top"))  # one row
    x = F.lit(least) + F.col("k") * (F.col("top") - least) / (points - 1)
    grid = f.join(F.broadcast(top)).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("x", x)
    gamma = F.exp(F.col("log_c") + (F.col("nu") - 1) * F.ln("x") - F.col("x") / F.col("theta"))
    return grid.select("chrom", "x", gamma.alias("gamma"), (F.exp(-F.col("x") / F.col("mean")) / F.col("mean")).alias("exponential"))


def histogram(df, value: str, bins: int = 25):
    """(left, right, density) of equal bins from the least to the largest value."""
    ends = df.agg(F.min(value).cast("double").alias("lo"), F.max(value).cast("double").alias("hi"), F.count(value).alias("n"))
    w = (F.col("hi") - F.col("lo")) / bins
    b = F.least(F.floor(F.try_divide(F.col(value) - F.col("lo"), w)), F.lit(bins - 1))
    counts = df.join(F.broadcast(ends)).groupBy(F.coalesce(b, F.lit(0)).alias("b")).agg(F.count(value).alias("k"))
    grid = ends.select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(bins - 1).cast("long"))).alias("b"))
    return grid.join(counts, "b", "left").select((F.col("lo") + F.col("b") * w).alias("left"), (F.col("lo") + (F.col("b") + 1) * w).alias("right"), F.coalesce(F.try_divide(F.coalesce("k", F.lit(0)), F.col("n") * w), F.lit(0.0)).alias("density"))
