"""Audits over calls: sweeps of thresholds, floors, shares and saturation."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.operators.markers import quantiles


def block_sweep(blocks: DataFrame, sizes: list[int], markers: list[int], n_cells: int | None = None, chroms: list[str] | None = None, floor: float = 50.0) -> DataFrame:
    """(block_size, marker_num, n_blocks, n_breakpoints) of every pair of thresholds, in one pass over the blocks: a block
    is dealt to the settings that it survives, at most their number. With n_cells and chroms also the map's length in cM
    and the chromosomes below the floor."""
    grid = F.array(*[F.struct(F.lit(s).cast("long").alias("block_size"), F.lit(m).cast("long").alias("marker_num")) for s in sizes for m in markers])
    b = blocks.select("barcode", "chrom", "sta", "genotype", F.explode(F.filter(grid, lambda g: (F.col("end") - F.col("sta") >= g["block_size"]) & (F.col("markernum") >= g["marker_num"]))).alias("g")).select("barcode", "chrom", "sta", "genotype", "g.*")
    w = Window.partitionBy("block_size", "marker_num", "barcode", "chrom").orderBy("sta")
    b = b.withColumn("new", F.coalesce((F.col("genotype") != F.lag("genotype").over(w)).cast("long"), F.lit(0)))
    keys = ["block_size", "marker_num"]
    if not n_cells:
        return b.groupBy(*keys).agg(F.count("*").alias("n_blocks"), F.sum("new").alias("n_breakpoints"))
    per = b.groupBy(*keys, "chrom").agg(F.count("*").alias("k"), F.sum("new").alias("new"))
    met = F.count_if(F.col("new") * 100.0 / n_cells >= floor)
    out = per.groupBy(*keys).agg(F.sum("k").alias("n_blocks"), F.sum("new").alias("n_breakpoints"), met.alias("met"))
    return out.select(*keys, "n_blocks", "n_breakpoints", (F.col("n_breakpoints") * 100.0 / n_cells).alias("cm"), (F.lit(len(chroms)) - F.col("met")).alias("n_below"))


def selection_sweep(table: DataFrame, counts: DataFrame, rates: list[float], floor: float = 50.0) -> DataFrame:
    """(max_rate, n_cells, cos_per_cell, cm, n_below) for each limit of the switch rate: the cells that it selects of table
    (barcode, switch_rate), their crossovers (barcode, chrom, n_cos, of every cell and chromosome) and the chromosomes whose
    map is below the floor. A cell is dealt to the limits that it meets."""
    grid = F.array(*map(F.lit, map(float, rates)))
    t = table.select("barcode", F.explode(F.filter(grid, lambda r: F.col("switch_rate") <= r)).alias("max_rate"))
    per = t.join(counts, "barcode").groupBy("max_rate", "chrom").agg(F.count("*").alias("cells"), F.sum("n_cos").alias("cos"))
    cm = F.col("cos") * 100.0 / F.col("cells")
    return per.groupBy("max_rate").agg(F.max("cells").alias("n_cells"), (F.sum("cos") / F.max("cells")).alias("cos_per_cell"), F.sum(cm).alias("cm"), F.count_if(cm < floor).alias("n_below"))


def density_halves(per_chrom: DataFrame) -> DataFrame:
    """(half, n, co_per_mb): each cell's own chromosomes (barcode, chrom, markers, n_cos, size) parted at the middle of its
    marker density, so cells are compared with themselves; an odd chromosome in the middle counts for neither half."""
    w = Window.partitionBy("barcode").orderBy(F.col("markers") / F.col("size"), "chrom")
    d = per_chrom.withColumns({"_i": F.row_number().over(w), "_n": F.count("*").over(Window.partitionBy("barcode"))})
    half = F.when(2 * F.col("_i") <= F.col("_n") - F.col("_n") % 2, "low").when(2 * (F.col("_n") - F.col("_i") + 1) <= F.col("_n") - F.col("_n") % 2, "high")
    return d.withColumn("half", half).where("half IS NOT NULL").groupBy("half").agg(F.count("*").alias("n"), (F.sum("n_cos") / (F.sum("size") / 1_000_000)).alias("co_per_mb"))


def strand_shares(reads: DataFrame) -> DataFrame:
    """(orientation, n, share) of reads (strand, gene_strand): sense, antisense, or none where no gene is met."""
    o = F.when(F.col("gene_strand").isNull(), "none").when(F.col("strand") == F.col("gene_strand"), "sense").otherwise("antisense")
    n = reads.groupBy(o.alias("orientation")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))


def staged(stages: dict[str, DataFrame], limits: dict[str, tuple]) -> DataFrame:
    """(stage, metric, value, flag): the one-row summaries of the stages of a quality report, one row for each number, with
    a flag where it lies outside its limits (low, high; None: open)."""
    out = None
    for name, row in stages.items():
        pairs = []
        for c in row.columns:
            lo, hi = limits.get(c, (None, None))
            v = F.col(f"`{c}`").cast("double")
            flag = F.when(v < lo if lo is not None else F.lit(False), f"{c} is low").when(v > hi if hi is not None else F.lit(False), f"{c} is high")
            pairs.append(F.struct(F.lit(c).alias("metric"), v.alias("value"), flag.alias("flag")))
        t = row.select(F.lit(name).alias("stage"), F.inline(F.array(*pairs)))
        out = t if out is None else out.unionByName(t)
    return out


def map_floor(table: DataFrame, floor: float = 50.0) -> DataFrame:
    """(chrom, cm, below): chromosomes whose map is shorter than the obligate crossover gives; a flag, not a filter."""
    return table.select("chrom", "cm", (F.col("cm") < floor).alias("below"))


def zero_excess(counts: DataFrame) -> DataFrame:
    """Per chromosome from (chrom, n_cos): share of cells without a crossover, and less the binomial(2, 0.5) share of 1/4."""
    share = F.avg((F.col("n_cos") == 0).cast("double"))
    return counts.groupBy("chrom").agg(share.alias("zero_share"), (share - 0.25).alias("excess"))


def per_bivalent(counts: DataFrame, n_chroms: int) -> DataFrame:
    """Crossovers per bivalent: per cell over the haploid number, twice, for half of a bivalent's are seen."""
    return counts.agg((F.avg("n_cos") / n_chroms * 2).alias("per_bivalent"))


def contaminated_markers(observed: DataFrame, most: float = 0.1) -> DataFrame:
    """Per marker, never per observation: the share of cells with both alleles, where it is above `most`."""
    share = F.avg(((F.col("ref_count") > 0) & (F.col("alt_count") > 0)).cast("double"))
    return observed.where((F.col("ref_count") > 0) | (F.col("alt_count") > 0)).groupBy("chrom", "pos").agg(F.count("*").alias("n_cells"), share.alias("both")).where(F.col("both") > most)


def single_read_share(observed: DataFrame) -> DataFrame:
    """Share of observations with one read, mean depth, and the mean alternative fraction (reference bias below 1/2)."""
    dp = F.col("ref_count") + F.col("alt_count")
    o = observed.where(dp > 0)
    return o.agg(F.avg((dp == 1).cast("double")).alias("single_share"), F.avg(dp).alias("mean_dp"), F.avg(F.col("alt_count") / dp).alias("alt_fraction"))


def saturation(per_cell: DataFrame, bins: int = 5) -> DataFrame:
    """(bin, n_cells, mean_cos) over equal ranges of total markers: whether detection levels off."""
    ends = per_cell.agg(F.min("total_markers").alias("lo"), F.max("total_markers").alias("hi"))
    b = F.least(F.expr(f"(total_markers - lo) * {bins} div greatest(1, hi - lo)"), F.lit(bins - 1)).cast("long")
    return per_cell.join(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count("*").alias("n_cells"), F.avg("n_cos").alias("mean_cos"))


def introns(features: DataFrame) -> DataFrame:
    """Quantiles of the gaps between a transcript's exons, from (transcript, start, end), 1-based with ends included."""
    w = Window.partitionBy("transcript").orderBy("start")
    gap = F.lead("start").over(w) - F.col("end") - 1
    return quantiles(features.select(gap.alias("gap")).where("gap > 0"), "gap", {"median": 0.5, "q95": 0.95, "q99": 0.99}).select("n", "median", "q95", "q99")


def flags(table: DataFrame, conditions: dict[str, object]) -> DataFrame:
    """(flag, n): rows of table that meet each named condition."""
    row = table.agg(*[F.count_if(c).alias(k) for k, c in conditions.items()])
    return row.select(F.inline(F.array(*[F.struct(F.lit(k).alias("flag"), F.col(k).alias("n")) for k in conditions])))
