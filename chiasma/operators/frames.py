"""Frames behind diagnostic figures, and text reports as tidy tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chiasma.operators.markers import HET, is_snv, quantiles, single_alt

COLOURS = {1: "red", 0: "blue"}


def counts(df: DataFrame, value: str, bins: int) -> DataFrame:
    """(bin, left, right, n): rows in each of `bins` equal bins of the value's range, empty ones too; one bin where all are
    alike, none without values."""
    v = F.col(value)
    ends = df.agg(F.min(v).cast("double").alias("lo"), F.max(v).cast("double").alias("hi")).where("lo IS NOT NULL")
    ends = ends.withColumn("step", F.when(F.col("hi") > F.col("lo"), (F.col("hi") - F.col("lo")) / bins).otherwise(1.0)).withColumn("last", F.when(F.col("hi") > F.col("lo"), bins - 1).otherwise(0))
    own = df.where(v.isNotNull()).join(F.broadcast(ends)).groupBy(F.least(F.floor((v - F.col("lo")) / F.col("step")), F.col("last")).cast("int").alias("bin")).agg(F.count("*").alias("n"))
    grid = ends.select("lo", "step", F.explode(F.sequence(F.lit(0), F.col("last"))).alias("bin"))
    out = grid.join(own, "bin", "left")
    return out.select("bin", (F.col("lo") + F.col("bin") * F.col("step")).alias("left"), (F.col("lo") + (F.col("bin") + 1) * F.col("step")).alias("right"), F.coalesce("n", F.lit(0)).alias("n"))


def trimmed(df: DataFrame, value: str, q: float = 0.99) -> DataFrame:
    """Rows below the value's quantile."""
    return df.join(F.broadcast(quantiles(df, value, {"_top": q}).select("_top"))).where(F.col(value) < F.col("_top")).drop("_top")


def capped(df: DataFrame, value: str, by: DataFrame | None = None, q: float = 0.99) -> DataFrame:
    """(value) cut at its quantile, which is that of `by` where given; rows without a value go."""
    top = quantiles(df if by is None else by, value, {"_top": q}).select("_top")
    return df.where(F.col(value).isNotNull()).join(F.broadcast(top)).select(F.least(F.col(value).cast("double"), F.col("_top")).alias(value))


def stacked(frames: dict[str, DataFrame], name: str = "frame") -> DataFrame:
    out = None
    for k, f in frames.items():
        f = f.select(F.lit(k).alias(name), "*")
        out = f if out is None else out.unionByName(f)
    return out


def switch_frames(table: DataFrame, least: int = 300, bins: int = 50) -> DataFrame:
    """Histograms of markers a cell (below the 99% quantile) and of switch rates (cells of at least so many markers)."""
    return stacked({"markers": counts(trimmed(table, "total_markers"), "total_markers", bins), "switch_rate": counts(table.where(F.col("total_markers") >= least), "switch_rate", bins)})


def switch_scatter(table: DataFrame, least: int = 300, slopes: tuple = (0.10, 0.13)) -> DataFrame:
    """(barcode, total_markers, total_switches, below each slope) of cells with at least so many markers."""
    return table.where(F.col("total_markers") >= least).select("barcode", "total_markers", "total_switches", *[(F.col("total_switches") <= F.col("total_markers") * s).alias(f"below_{round(s * 100)}") for s in slopes])


def marker_frames(variants: DataFrame, bins: int = 100, ratio_bins: int = 50) -> DataFrame:
    """Histograms over biallelic SNVs: depth and quality, capped at their 99% quantiles; over heterozygous ones: the second
    allele's share and the depth, under the same cap."""
    snv = variants.where(single_alt() & is_snv())
    a, b = F.get("ad", F.lit(0)), F.get("ad", F.lit(1))
    het = snv.where(F.col("gt").isin(*HET)).withColumn("ratio", F.try_divide(b, a + b))
    return stacked({"dp": counts(capped(snv, "dp"), "dp", bins), "qual": counts(capped(snv, "qual"), "qual", bins), "ratio": counts(het, "ratio", ratio_bins), "het_dp": counts(capped(het, "dp", snv), "dp", bins)})


def crossover_scatter(co: DataFrame, chroms: DataFrame) -> DataFrame:
    """(chrom, row, pos): a mark for each crossover's start on its chromosome's row; chroms: chrom, row."""
    return co.join(F.broadcast(chroms), "chrom").select("chrom", "row", F.col("bp_start").alias("pos"))


def lollipops(markers: DataFrame, top: int = 20) -> DataFrame:
    """(barcode, chrom, pos, height, colour): reference counts upwards, alternative counts downwards, cut at the axis."""
    sides = F.array(F.struct(F.col("ref_count").alias("c"), F.lit(1).alias("s"), F.lit("red").alias("colour")), F.struct(F.col("alt_count").alias("c"), F.lit(-1).alias("s"), F.lit("blue").alias("colour")))
    x = markers.select("barcode", "chrom", "pos", F.explode(F.filter(sides, lambda s: s["c"] > 0)).alias("x"))
    return x.select("barcode", "chrom", "pos", (F.least("x.c", F.lit(top)) * F.col("x.s")).cast("long").alias("height"), "x.colour")


def rectangles(blocks: DataFrame) -> DataFrame:
    """(barcode, chrom, sta, end, colour) of haplotype blocks."""
    colour = F.lit("purple")
    for g, name in COLOURS.items():
        colour = F.when(F.col("genotype") == g, name).otherwise(colour)
    return blocks.select("barcode", "chrom", "sta", "end", colour.alias("colour"))


def of_types(features: DataFrame, chroms: DataFrame, types: list[str]) -> DataFrame:
    """Features of these types on known chromosomes (chrom)."""
    return features.where(F.col("type").isin(*types)).join(F.broadcast(chroms.select("chrom")), "chrom", "left_semi")


def section(name: str, row: DataFrame, shown: dict[str, str | None]) -> DataFrame:
    """(section, metric, value) of a one-row table: each shown column under its label, as `%` format or as it is."""
    def text(c: str, form: str | None) -> Column:
        return F.col(f"`{c}`").cast("string") if form is None else F.format_string(form, F.col(f"`{c}`"))

    pairs = F.array(*[F.struct(F.lit(c).alias("metric"), text(c, f).alias("value")) for c, f in shown.items()])
    return row.select(F.lit(name).alias("section"), F.inline(pairs))


def listing(name: str, table: DataFrame, metric: str, value: str, form: str | None = None) -> DataFrame:
    """(section, metric, value) of a table with a row for each entry."""
    v = F.col(value)
    return table.select(F.lit(name).alias("section"), F.col(metric).cast("string").alias("metric"), (v.cast("string") if form is None else F.format_string(form, v)).alias("value"))


def padded(columns: dict[str, int], formats: dict[str, str] | None = None) -> Column:
    """One line of a text table: each column cut to and padded on the right to its width, two blanks between."""
    f = formats or {}
    cell = lambda c: F.format_string(f[c], F.col(c)) if c in f else F.col(c).cast("string")
    return F.concat_ws("  ", *[F.rpad(F.coalesce(cell(c), F.lit("")), w, " ") for c, w in columns.items()])
