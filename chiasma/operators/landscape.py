"""Crossovers per cell and chromosome, genetic maps, crossover classes and sliding rates.

Crossovers are (barcode, chrom, bp_start, bp_end); sizes are (chrom, size), an assembly's few chromosomes; cells is a
one-column table of every cell, so cells without crossovers count.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.operators import intervals as I
from chiasma.operators.sampling import again, by_replicate, drawn, lane_sums

MB = 1_000_000


def midpoints(co: DataFrame) -> DataFrame:
    return co.withColumn("mid", (F.col("bp_start") + F.col("bp_end")) / 2.0)


def per_cell(co: DataFrame, cells: DataFrame) -> DataFrame:
    """(barcode, n_cos) of every cell."""
    n = co.groupBy("barcode").agg(F.count("*").alias("n_cos"))
    return cells.join(n, "barcode", "left").select("barcode", F.coalesce("n_cos", F.lit(0)).alias("n_cos"))


def summary(counts: DataFrame) -> DataFrame:
    """One row: total_cos, n_cells, cells_with_co, mean_cos, median_cos; from how many cells have each number."""
    by = counts.groupBy("n_cos").agg(F.count("*").alias("k"))
    every = Window.partitionBy()
    by = by.withColumns({"hi": F.sum("k").over(Window.orderBy("n_cos").rowsBetween(Window.unboundedPreceding, 0)), "n": F.sum("k").over(every)})
    at = lambda q: F.min(F.when(F.col("hi") > q, F.col("n_cos")))
    middle = (at(F.floor((F.col("n") - 1) / 2)) + at(F.floor(F.col("n") / 2))) / 2.0
    total = F.sum(F.col("n_cos") * F.col("k"))
    return by.agg(total.alias("total_cos"), F.coalesce(F.sum("k"), F.lit(0)).alias("n_cells"), F.coalesce(F.sum(F.when(F.col("n_cos") >= 1, F.col("k"))), F.lit(0)).alias("cells_with_co"),
                  F.try_divide(total, F.sum("k")).cast("double").alias("mean_cos"), middle.alias("median_cos"))


def contingency(co: DataFrame, cells: DataFrame, chroms: list[str]) -> DataFrame:
    """(barcode, chrom, n_cos) for every cell and every chromosome; the chromosomes are dealt to the cells as an array."""
    n = co.groupBy("barcode", "chrom").agg(F.count("*").alias("n_cos"))
    full = cells.select("barcode", F.explode(F.array(*map(F.lit, chroms))).alias("chrom"))
    return full.join(n, ["barcode", "chrom"], "left").select("barcode", "chrom", F.coalesce("n_cos", F.lit(0)).alias("n_cos"))


def chrom_table(co: DataFrame, sizes: DataFrame, n_cells: int) -> DataFrame:
    """Per chromosome: size, crossovers, map length in cM, mean per cell, cM per Mb; chromosomes without crossovers too."""
    n = co.groupBy("chrom").agg(F.count("*").alias("n"))
    out = sizes.join(n, "chrom", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    cm, mb = F.col("n") * 100.0 / n_cells, F.col("size") / MB
    return out.select("chrom", mb.alias("size_mb"), F.col("n").alias("n_cos"), cm.alias("cm"), (F.col("n") / n_cells).alias("mean_per_cell"), (cm / mb).alias("cm_per_mb"))


def genome(table: DataFrame) -> DataFrame:
    """One row of totals over chrom_table(), with the half crossover per chromatid that meiosis needs as expectation."""
    return table.agg(F.sum("cm").alias("total_cm"), F.sum("size_mb").alias("total_mb"), (F.sum("cm") / F.sum("size_mb")).alias("rate"), (F.count("*") * 0.5).alias("expected_cos"))


def classes(full: DataFrame, sizes: DataFrame, top: int = 4) -> DataFrame:
    """Per chromosome and class 0 to top (top: that or more): cells, their share, and the share of the chromosome."""
    n = full.groupBy("chrom", F.least(F.col("n_cos"), F.lit(top)).alias("class")).agg(F.count("*").alias("cells"))
    domain = sizes.select("chrom", "size", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(top).cast("long"))).alias("class"))
    out = domain.join(n, ["chrom", "class"], "left").withColumn("cells", F.coalesce("cells", F.lit(0)))
    share = F.try_divide("cells", F.sum("cells").over(Window.partitionBy("chrom")))
    return out.select("chrom", "class", "cells", share.alias("share"), (share * F.col("size") / MB).alias("segment_mb"))


def sliding_rate(mids: DataFrame, sizes: DataFrame, win: int, step: int, n_cells: int) -> DataFrame:
    """(chrom, pos_mb, rate): cM per Mb in each window, 0 where no crossover falls."""
    n = I.point_counts(mids, win, step, pos="mid")
    out = I.windows(sizes, win, step).join(n, ["chrom", "w"], "left")
    return out.select("chrom", ((F.col("lo") + F.col("hi")) / 2.0 / MB).alias("pos_mb"), (F.coalesce("n", F.lit(0)) * 100.0 / n_cells / (win / MB)).alias("rate"))


def numbered(cells: DataFrame, prefix: int = 6) -> DataFrame:
    """Cells with i from 0 in order of barcode and their number n. Numbers are counted in bins: of the barcode's value, or of
    the first letters of one of text, so bins are ordered in one task and not cells."""
    if dict(cells.dtypes)["barcode"] in ("tinyint", "smallint", "int", "bigint"):
        return I.numbered(cells.select("barcode"), "barcode").select("barcode", "i", "n")
    d = cells.select("barcode", F.lit(0).alias("_all"), F.substring("barcode", 1, prefix).alias("_bin"))
    n = d.count()
    d = I._carried(d, ("_all",), F.count("*"), F.sum)
    own = F.row_number().over(Window.partitionBy("_all", "_bin").orderBy("barcode")) - 1
    return d.select("barcode", (own + F.coalesce("_carry", F.lit(0))).cast("long").alias("i"), F.lit(n).cast("long").alias("n"))


def rate_band(mids: DataFrame, cells: DataFrame, sizes: DataFrame, win: int, step: int, n_cells: int, n_boot: int) -> DataFrame:
    """sliding_rate() with ymin and ymax, one standard deviation over replicates of drawn cells, floored at 0; chr_avg, the
    chromosome's own rate, and genome_rate. Replicates are bits of a cell and lanes of the sums by step (which divides the
    window), so crossovers are counted once."""
    if win % step:
        raise ValueError("a window is a whole number of steps")
    own = mids.where("mid >= 0").join(drawn(numbered(cells), n_boot), "barcode")
    by = own.groupBy("chrom", F.floor(F.col("mid") / step).cast("long").alias("_s")).agg(*lane_sums(n_boot))
    first = F.greatest(F.lit(0).cast("long"), F.col("_s") - (win // step - 1))
    by = by.withColumn("w", F.explode(F.sequence(first, F.col("_s")))).groupBy("chrom", "w").agg(*again(n_boot))
    # Replicates without a crossover in a window count 0 there, so sums over all replicates suffice.
    s = by.select("chrom", "w", by_replicate(n_boot).alias("_c"))
    s = s.select("chrom", "w", F.expr("aggregate(_c, 0D, (a, x) -> a + x)").alias("s1"), F.expr("aggregate(_c, 0D, (a, x) -> a + double(x) * x)").alias("s2"))
    var = (F.coalesce("s2", F.lit(0.0)) - F.pow(F.coalesce("s1", F.lit(0.0)), 2) / n_boot) / (n_boot - 1)
    sd = F.sqrt(F.greatest(F.lit(0.0), var)) * 100.0 / n_cells / (win / MB)
    base = I.windows(sizes, win, step).join(I.point_counts(mids, win, step, pos="mid"), ["chrom", "w"], "left").join(s, ["chrom", "w"], "left")
    rate = F.coalesce("n", F.lit(0)) * 100.0 / n_cells / (win / MB)
    own = chrom_table(mids, sizes, n_cells).select("chrom", F.col("cm_per_mb").alias("chr_avg"), (F.sum("cm").over(Window.partitionBy()) / F.sum("size_mb").over(Window.partitionBy())).alias("genome_rate"))
    return base.join(F.broadcast(own), "chrom").select(  # a row for each chromosome
        "chrom", ((F.col("lo") + F.col("hi")) / 2.0 / MB).alias("pos_mb"), rate.alias("rate"), F.greatest(rate - sd, F.lit(0.0)).alias("ymin"), (rate + sd).alias("ymax"), "chr_avg", "genome_rate")


def marey(mids: DataFrame, sizes: DataFrame, n_cells: int) -> DataFrame:
    """Cumulative map: (chrom, pos, cm) from (0, 0) by crossovers to (size, total); two rows of 0 where there is none."""
    steps = I.ranked(mids.select("chrom", "mid", "barcode"), ("chrom",), "mid", MB, "barcode").select("chrom", F.col("mid").alias("pos"), (F.col("rank") * 100.0 / n_cells).alias("cm"))
    total = sizes.join(mids.groupBy("chrom").agg(F.count("*").alias("n")), "chrom", "left")
    ends = total.select("chrom", F.explode(F.array(F.struct(F.lit(0.0).alias("pos"), F.lit(0.0).alias("cm")),
                                                   F.struct(F.col("size").cast("double").alias("pos"), (F.coalesce("n", F.lit(0)) * 100.0 / n_cells).alias("cm")))).alias("e"))
    return steps.unionByName(ends.select("chrom", "e.pos", "e.cm"))


def marey_labels(mids: DataFrame, sizes: DataFrame, n_cells: int) -> DataFrame:
    """Where each chromosome's curve ends and what stands there: (chrom, chrom_end_mb, total_cm, cm_per_mb)."""
    return chrom_table(mids, sizes, n_cells).select("chrom", F.col("size_mb").alias("chrom_end_mb"), F.col("cm").alias("total_cm"), "cm_per_mb")


def distances(mids: DataFrame) -> DataFrame:
    """(barcode, chrom, dist_mb) between neighbouring crossovers of a cell."""
    w = Window.partitionBy("barcode", "chrom").orderBy("mid")
    return mids.select("barcode", "chrom", ((F.col("mid") - F.lag("mid").over(w)) / MB).alias("dist_mb")).where("dist_mb IS NOT NULL")
