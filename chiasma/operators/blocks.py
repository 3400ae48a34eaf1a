"""Haplotype blocks and crossover breakpoints from smoothed genotypes, as windows over (cell, chromosome)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.operators.genotype import block_genotype, ordered

KEY = ("barcode", "chrom")


def runs(df: DataFrame, value: str = "smt_af", genotype: float = 0.2) -> DataFrame:
    """Run-length encoding on exact equality: sta, end, genotype, markernum of every run, numbered by blk from 1."""
    w = ordered(*KEY)
    changed = F.coalesce((F.col(value) != F.lag(value).over(w)).cast("int"), F.lit(1))
    return (
        df.withColumn("_c", changed).withColumn("blk", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
        .groupBy(*KEY, "blk")
        .agg(F.min("pos").alias("sta"), F.max("pos").alias("end"), F.first(block_genotype(F.col(value), genotype)).alias("genotype"), F.count("*").alias("markernum"))
    )


def long_enough(blocks: DataFrame, block_size: int, marker_num: int) -> DataFrame:
    return blocks.where((F.col("end") - F.col("sta") >= block_size) & (F.col("markernum") >= marker_num))


def enough_markers(markers: DataFrame, cell_markers: int, cell: str = "barcode") -> DataFrame:
    """The rows of cells with at least cell_markers rows, counted in a window: the shuffle by cell then serves what follows
    by (cell, chromosome), up to the second smoothing pass."""
    return markers.withColumn("_n", F.count("*").over(Window.partitionBy(cell))).where(F.col("_n") >= cell_markers).drop("_n")


def callable_chroms(markers: DataFrame) -> DataFrame:
    """Without chromosomes of a cell that have fewer than two markers."""
    return markers.withColumn("_n", F.count("*").over(Window.partitionBy(*KEY))).where("_n >= 2").drop("_n")


def breakpoints(blocks: DataFrame) -> DataFrame:
    """Between surviving blocks of different genotype: bp_start, bp_end, geno_pre, geno_post, and marker_count, the markers
    of the whole run of equal blocks on the left."""
    w = Window.partitionBy(*KEY).orderBy("sta")
    changed = F.coalesce((F.col("genotype") != F.lag("genotype").over(w)).cast("int"), F.lit(0))
    b = blocks.withColumn("_c", changed).withColumn("run", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = b.withColumn("_m", F.sum("markernum").over(Window.partitionBy(*KEY, "run")))
    return (
        b.withColumn("bp_start", F.lag("end").over(w)).withColumn("geno_pre", F.lag("genotype").over(w)).withColumn("marker_count", F.lag("_m").over(w))
        .where("_c = 1").select(*KEY, "bp_start", F.col("sta").alias("bp_end"), "geno_pre", F.col("genotype").alias("geno_post"), "marker_count")
    )


def called(smoothed: DataFrame, block_size: int, marker_num: int, value: str = "smt_af", genotype: float = 0.2) -> DataFrame:
    """Surviving blocks with the refined breakpoint before each, from smoothed rows in one pass over (cell, chromosome) alone,
    so the rows are smoothed once and never joined. A breakpoint is refined to the neighbouring markers of its gap, ends
    included, between which the genotypes differ most: the first largest of max(share of 0 left x share of 1 right, share of
    1 left x share of 0 right).

    (barcode, chrom, blk from 1, sta, end, genotype, markernum, run, acc, fresh, bp_start, bp_end, geno_pre, marker_count):
    run numbers the stretches of equal blocks from 0, acc is the running sum of markers of blocks that continue one, fresh
    marks a block of another genotype than the one before, whose breakpoint is given.

    Rows become runs of one value first, and all else works on those. The gap between two surviving blocks is the last row of
    the one, the runs between, and the first row of the next. Inside a run each of the two products that a border is scored by
    rises or falls throughout, so the best border of a run is the one after its first row or the one after its last."""
    w = ordered(*KEY)
    d = smoothed.select(*KEY, "pos", F.col(value).alias("_v"))
    d = d.withColumns({"_c": F.coalesce((F.col("_v") != F.lag("_v").over(w)).cast("int"), F.lit(1)), "_second": F.lead("pos").over(w)})
    d = d.withColumn("_blk", F.sum("_c").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    b = d.groupBy(*KEY, "_blk").agg(F.min("pos").alias("sta"), F.max("pos").alias("end"), F.count("*").alias("markernum"), F.first("_v").alias("_v"), F.max(F.when(F.col("_c") == 1, F.col("_second"))).alias("_second"))
    keep = (F.col("end") - F.col("sta") >= block_size) & (F.col("markernum") >= marker_num)
    o = Window.partitionBy(*KEY).orderBy("_blk")
    upto, before = o.rowsBetween(Window.unboundedPreceding, 0), o.rowsBetween(Window.unboundedPreceding, -1)
    b = b.withColumns({"genotype": block_genotype(F.col("_v"), genotype), "_keep": keep})
    b = b.withColumns({"_k": F.sum(F.col("_keep").cast("long")).over(upto), "_g": F.last(F.when(F.col("_keep"), F.col("genotype")), ignorenulls=True).over(before)})
    cont = F.col("_keep") & (F.col("_g") == F.col("genotype"))
    b = b.withColumn("fresh", F.coalesce(F.col("_keep") & (F.col("_g") != F.col("genotype")), F.lit(False)))
    b = b.withColumns({"run": F.sum(F.col("fresh").cast("long")).over(upto), "acc": F.sum(F.when(cont, F.col("markernum")).otherwise(0)).over(upto)})
    b = b.withColumn("_m", F.sum(F.when(F.col("_keep"), F.col("markernum"))).over(Window.partitionBy(*KEY, "run")))
    part = lambda on, gap, role, first, second, last, n: F.when(on, F.struct(gap.alias("gap"), F.lit(role).alias("role"), first.alias("first"), second.alias("second"), last.alias("last"), n.alias("n")))
    one, none, c = F.lit(1).cast("long"), F.lit(None).cast("long"), F.col
    parts = F.array_compact(F.array(
        part(~c("_keep") & (c("_k") > 0), c("_k"), 0, c("sta"), c("_second"), c("end"), c("markernum")),
        part(c("_keep"), c("_k"), 1, c("end"), none, c("end"), one), part(c("_keep"), c("_k") - 1, 2, c("sta"), none, c("sta"), one)))
    g = b.withColumn("_p", F.explode(parts)).select(*KEY, "_v", "sta", "end", "genotype", "markernum", "run", "acc", "fresh", "_m", "_p.*")
    whole = Window.partitionBy(*KEY, "gap")
    q = whole.orderBy("first", "role")
    so_far = q.rowsBetween(Window.unboundedPreceding, -1)
    zero, real = F.when(c("_v") == 0, c("n")).otherwise(0), F.when(c("_v") == 1, c("n")).otherwise(0)
    sums = {"_i": (c("n"), "_n"), "_l0": (zero, "_t0"), "_l1": (real, "_t1")}
    g = g.withColumns({"_next": F.lead("first").over(q)} | {k: F.coalesce(F.sum(v).over(so_far), F.lit(0)) for k, (v, _) in sums.items()} | {t: F.sum(v).over(whole) for v, t in sums.values()})

    def border(rows, pos, after):
        """Score of the border after so many rows of a run, as (score, place before all, position, next position)."""
        i, l0, l1 = c("_i") + rows, c("_l0") + F.when(c("_v") == 0, rows).otherwise(0), c("_l1") + F.when(c("_v") == 1, rows).otherwise(0)
        rest = F.nullif(c("_n") - i, F.lit(0))
        score = F.greatest((l0 / i) * ((c("_t1") - l1) / rest), (l1 / i) * ((c("_t0") - l0) / rest))
        return F.when(after.isNotNull(), F.struct(score.alias("score"), (-i).alias("i"), pos.alias("pos"), after.alias("next")))

    best = F.greatest(border(c("n"), c("last"), c("_next")), F.when(c("n") > 1, border(one, c("first"), c("second"))))
    own = ("sta", "end", "genotype", "markernum", "run", "acc", "fresh")
    g = g.groupBy(*KEY, "gap").agg(
        F.max(F.when(c("role") == 2, F.struct(*own))).alias("_b"), F.max(F.when(c("role") == 1, F.struct("genotype", "_m"))).alias("_a"), F.max(best).alias("_p")).where("_b IS NOT NULL")
    on = lambda x: F.when(c("_b.fresh"), c(x))
    return g.select(*KEY, (c("gap") + 1).alias("blk"), *[c(f"_b.{x}").alias(x) for x in own], on("_p.pos").alias("bp_start"), on("_p.next").alias("bp_end"),
                    on("_a.genotype").alias("geno_pre"), on("_a._m").alias("marker_count"))


def refined(calls: DataFrame) -> DataFrame:
    """The breakpoints of called()."""
    return calls.where("fresh").select(*KEY, "bp_start", "bp_end", "geno_pre", F.col("genotype").alias("geno_post"), "marker_count")


def haplotypes(calls: DataFrame, sizes: DataFrame) -> DataFrame:
    """Runs of equal surviving blocks from 1 to the chromosome's end (chrom, size), numbered by run, with refined borders, from
    called(): one more aggregation over the same partitions. n_markers is their markers; markernum_acc is the running sum over
    the blocks that continue a run, which is never reset."""
    out = calls.groupBy(*KEY, "run").agg(
        F.min("sta").alias("_s"), F.max("end").alias("_e"), F.first("genotype").alias("genotype"), F.max("acc").alias("markernum_acc"), F.sum("markernum").alias("n_markers"),
        F.max("bp_start").alias("_bs"), F.max("bp_end").alias("_be"))
    r = Window.partitionBy(*KEY).orderBy("run")
    out = out.join(F.broadcast(sizes.select("chrom", "size")), "chrom")  # one row for each chromosome of an assembly
    out = out.withColumns({"_nr": F.lead("run").over(r), "_ns": F.lead("_bs").over(r)})
    sta = F.coalesce("_be", F.when(F.col("run") == 0, F.lit(1)).otherwise(F.col("_s")))
    end = F.coalesce("_ns", F.when(F.col("_nr").isNull(), F.greatest("_e", "size")).otherwise(F.col("_e")))
    return out.select(*KEY, "run", sta.cast("long").alias("sta"), end.alias("end"), F.col("genotype").cast("int").alias("genotype"), "markernum_acc", "n_markers")
