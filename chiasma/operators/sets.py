"""Set operations by name and null-safe membership."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def stacked(frames: list[DataFrame]) -> DataFrame:
    """UNION ALL by column name, e.g. of per-chromosome tables."""
    return reduce(lambda a, b: a.unionByName(b), frames)


def without(df: DataFrame, excluded: DataFrame, key: str) -> DataFrame:
    """Rows whose key is not among the excluded ones; rows with a null key stay."""
    return df.join(excluded.select(key).distinct(), key, "left_anti")


def within(df: DataFrame, kept: DataFrame, key: str) -> DataFrame:
    return df.join(kept.select(key).distinct(), key, "left_semi")


def member_or_all(value: Column, members: list) -> Column:
    """Membership; an empty list holds everything."""
    return value.isin(*members) if members else F.lit(True)


def extremes(df: DataFrame, value: str, name: str) -> DataFrame:
    """(smallest, largest): names of the rows with the least and the largest value, the first by name on ties."""
    least = df.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    j = df.join(F.broadcast(least), (F.col(value) == F.col("lo")) | (F.col(value) == F.col("hi")))
    return j.agg(F.min(F.when(F.col(value) == F.col("lo"), F.col(name))).alias("smallest"), F.min(F.when(F.col(value) == F.col("hi"), F.col(name))).alias("largest"))
