"""Frames behind genome-wide figures: robust scales, haplotype maps and synteny ribbons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chiasma.operators.markers import quantiles


def robust_top(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """One row, top: the quantile of the positive values, else the largest, else 1."""
    most = df.agg(F.max(value).cast("double").alias("_most"))  # one row, as the quantile
    top = F.coalesce(F.nullif("_q", F.lit(0.0)), F.nullif("_most", F.lit(0.0)), F.lit(1.0))
    return quantiles(df.where(F.col(value) > 0), value, {"_q": q}).crossJoin(most).select(top.alias("top"))


def scaled(value: Column, top: Column) -> Column:
    return F.least(F.greatest(value / top, F.lit(0.0)), F.lit(1.0))


def palette_bucket(share: Column, colours: int = 100) -> Column:
    """1 to `colours`; the product is rounded first so that whole buckets are not pushed up by binary fractions."""
    return F.greatest(F.lit(1), F.ceil(F.round(share * colours, 6))).cast("long")


def interleaved(pairs: DataFrame, first: DataFrame, second: DataFrame) -> DataFrame:
    """(chr, start, end) of a karyotype with both haplotypes in turn: pairs (hap1, hap2), first (name, size, internal_id),
    second (name, size); in order of internal_id."""
    p = pairs.join(first.withColumnRenamed("name", "hap1").withColumnRenamed("size", "s1"), "hap1").join(second.withColumnRenamed("name", "hap2").withColumnRenamed("size", "s2"), "hap2")
    each = F.posexplode(F.array(F.struct(F.col("hap1").alias("chr"), F.col("s1").alias("end")), F.struct(F.col("hap2").alias("chr"), F.col("s2").alias("end")))).alias("side", "x")
    return p.select("internal_id", each).select("internal_id", "side", F.col("x.chr").alias("chr"), F.lit(1).alias("start"), F.col("x.end").alias("end"))


def ribbons(syri: DataFrame, refs: list[str], queries: list[str], least: int, types=("SYN", "INV")) -> DataFrame:
    """Rearrangement rows of these types between known chromosomes that are long enough on either side; columns are text
    and cast after the filter on type, for other rows hold '-'."""
    kept = syri.where(F.col("type").isin(*types) & F.col("chrom_ref").isin(*refs) & F.col("chrom_qry").isin(*queries))
    cast = kept.select("chrom_ref", "chrom_qry", "type", *[F.expr(f"try_cast({c} AS BIGINT)").alias(c) for c in ("start_ref", "end_ref", "start_qry", "end_qry")])
    return cast.where((F.col("end_ref") - F.col("start_ref") >= least) | (F.col("end_qry") - F.col("start_qry") >= least))
