"""Allele counts to genotypes, switches and cell selection. Column names are parameters; one shuffle on (cell, chrom)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def ordered(cell: str = "barcode", chrom: str = "chrom", pos: str = "pos"):
    return Window.partitionBy(cell, chrom).orderBy(pos)


def informative(df: DataFrame, ref: str = "ref_count", alt: str = "alt_count") -> DataFrame:
    """Rows with a read of either allele."""
    return df.where((F.col(ref) > 0) | (F.col(alt) > 0))


def alt_fraction(ref: str = "ref_count", alt: str = "alt_count") -> Column:
    """The polarity of cell QC."""
    return F.col(alt) / (F.col(ref) + F.col(alt))


def ref_fraction(ref: str = "ref_count", alt: str = "alt_count") -> Column:
    """The polarity of crossover calling."""
    return F.col(ref) / (F.col(ref) + F.col(alt))


def tri_state(ratio: Column, ref_low: float = 0.2, alt_high: float = 0.8) -> Column:
    """0 below ref_low, 1 above alt_high, else 0.5; both strict."""
    return F.when(ratio < ref_low, 0.0).when(ratio > alt_high, 1.0).otherwise(0.5)


def block_genotype(smoothed: Column, genotype: float = 0.2) -> Column:
    """1 (reference) from 1 - genotype, 0 up to genotype, else -1."""
    return F.when(smoothed >= 1 - genotype, 1).when(smoothed <= genotype, 0).otherwise(-1)


def remaining_ref(dp: str = "dp", ad: str = "ad") -> Column:
    """Reference reads: depth less alternative reads, not below 0."""
    return F.greatest(F.col(dp) - F.col(ad), F.lit(0))


def switches(markers: DataFrame, chroms: list[str] | None = None, cell: str = "barcode", chrom: str = "chrom", pos: str = "pos",
             ref_low: float = 0.2, alt_high: float = 0.8) -> DataFrame:
    """Per (cell, chrom): informative markers and changes of the tri-state genotype between neighbours. Chromosomes outside
    `chroms` have no switches but their markers count."""
    g = informative(markers).withColumn("_g", tri_state(alt_fraction(), ref_low, alt_high))
    changed = F.col("_g") != F.lag("_g").over(ordered(cell, chrom, pos))
    if chroms is not None:
        changed = changed & F.col(chrom).isin(*chroms)
    return g.withColumn("_s", F.coalesce(changed.cast("long"), F.lit(0))).groupBy(cell, chrom).agg(F.count("*").alias("markers"), F.sum("_s").alias("switches"))


def switch_table(per_chrom: DataFrame, chroms: list[str], cell: str = "barcode", chrom: str = "chrom") -> DataFrame:
    """Per cell: total markers, switches, rate (null without markers), and the least markers on a chromosome of `chroms`,
    where an absent one counts 0. The domain is not joined: a cell with fewer chromosomes than `chroms` has a 0."""
    known = F.col(chrom).isin(*chroms)
    out = per_chrom.groupBy(cell).agg(
        F.sum("markers").alias("total_markers"), F.sum("switches").alias("total_switches"),
        F.count(F.when(known, 1)).alias("_n"), F.min(F.when(known, F.col("markers"))).alias("_min"),
    )
    return out.select(
        cell, "total_markers", "total_switches", F.try_divide("total_switches", "total_markers").alias("switch_rate"),
        F.when(F.col("_n") < len(chroms), F.lit(0)).otherwise(F.col("_min")).cast("long").alias("min_chrom_markers"),
    )


def selected(table: DataFrame, total: int, per_chrom: int, rate: float) -> Column:
    """The three conditions of cell QC; a null rate does not pass."""
    return F.coalesce((F.col("total_markers") >= total) & (F.col("min_chrom_markers") >= per_chrom) & (F.col("switch_rate") <= rate), F.lit(False))


def wide(per_chrom: DataFrame, chroms: list[str], cell: str = "barcode", chrom: str = "chrom") -> DataFrame:
    """markers_<chrom> and switches_<chrom> for every chromosome, zero-filled; only for a sink, keep the long form else."""
    cols = [F.coalesce(F.sum(F.when(F.col(chrom) == c, F.col(m))), F.lit(0)).alias(f"{m}_{c}") for m in ("markers", "switches") for c in chroms]
    return per_chrom.groupBy(cell).agg(*cols)
