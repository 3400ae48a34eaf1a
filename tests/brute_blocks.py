"""Refined breakpoints and final blocks step by step, by joins over rows: what the one-pass calls are held against."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.operators.blocks import KEY


def refine(points: DataFrame, smoothed: DataFrame, value: str = "smt_af") -> DataFrame:
    """Each breakpoint moved to the neighbouring markers of its gap (ends included) between which the genotypes differ
    most: the first largest of max(share of 0 left x share of 1 right, share of 1 left x share of 0 right)."""
    gap = smoothed.join(points, list(KEY)).where((F.col("pos") >= F.col("bp_start")) & (F.col("pos") <= F.col("bp_end")))
    whole = Window.partitionBy(*KEY, "bp_start", "bp_end")
    w = whole.orderBy("pos")
    left = w.rowsBetween(Window.unboundedPreceding, 0)
    zero, one = (F.col(value) == 0).cast("int"), (F.col(value) == 1).cast("int")
    g = gap.select(
        *points.columns, "pos", F.lead("pos").over(w).alias("_next"), F.row_number().over(w).alias("_i"), F.count("*").over(whole).alias("_n"),
        F.sum(zero).over(left).alias("_l0"), F.sum(one).over(left).alias("_l1"), F.sum(zero).over(whole).alias("_t0"), F.sum(one).over(whole).alias("_t1"),
    ).where("_next IS NOT NULL")
    rest = F.col("_n") - F.col("_i")
    score = F.greatest((F.col("_l0") / F.col("_i")) * ((F.col("_t1") - F.col("_l1")) / rest), (F.col("_l1") / F.col("_i")) * ((F.col("_t0") - F.col("_l0")) / rest))
    best = F.max_by(F.struct("pos", "_next"), F.struct(score, -F.col("_i")))
    return (
        g.groupBy(*points.columns).agg(best.alias("_b"))
        .select(*KEY, F.col("_b.pos").alias("bp_start"), F.col("_b._next").alias("bp_end"), "geno_pre", "geno_post", "marker_count")
    )


def final_blocks(blocks: DataFrame, sizes: DataFrame, refined: DataFrame | None = None) -> DataFrame:
    """Runs of equal surviving blocks from 1 to the chromosome's end (chrom, size), numbered by run. n_markers is their
    markers; markernum_acc is the running sum over the blocks that continue a run, which is never reset. With refined
    breakpoints the inner borders move to them."""
    w = Window.partitionBy(*KEY).orderBy("sta")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    same = F.coalesce(F.col("genotype") == F.lag("genotype").over(w), F.lit(False))
    fresh = F.coalesce((F.col("genotype") != F.lag("genotype").over(w)).cast("int"), F.lit(0))
    b = blocks.withColumn("_f", fresh).withColumn("_a", F.when(same, F.col("markernum")).otherwise(0))
    b = b.withColumn("run", F.sum("_f").over(upto)).withColumn("_acc", F.sum("_a").over(upto))
    out = b.groupBy(*KEY, "run").agg(F.min("sta").alias("sta"), F.max("end").alias("end"), F.first("genotype").alias("genotype"), F.max("_acc").alias("markernum_acc"), F.sum("markernum").alias("n_markers"))
    r = Window.partitionBy(*KEY).orderBy("run")
    out = out.join(F.broadcast(sizes.select("chrom", "size")), "chrom")  # one row for each chromosome of an assembly
    out = out.withColumn("sta", F.when(F.col("run") == 0, F.lit(1)).otherwise(F.col("sta")))
    out = out.withColumn("end", F.when(F.lead("run").over(r).isNull(), F.greatest("end", "size")).otherwise(F.col("end")))
    if refined is not None:
        p = refined.withColumn("_k", F.row_number().over(Window.partitionBy(*KEY).orderBy("bp_start"))).select(*KEY, "_k", "bp_start", "bp_end")
        before, after = p.alias("x"), p.alias("y")
        o = out.alias("o")
        on = lambda t, k: (F.col("o.barcode") == F.col(f"{t}.barcode")) & (F.col("o.chrom") == F.col(f"{t}.chrom")) & (k == F.col(f"{t}._k"))
        out = o.join(before, on("x", F.col("o.run")), "left").join(after, on("y", F.col("o.run") + 1), "left").select(
            "o.barcode", "o.chrom", "o.run", F.coalesce("x.bp_end", "o.sta").alias("sta"), F.coalesce("y.bp_start", "o.end").alias("end"), "o.genotype", "o.markernum_acc", "o.n_markers")
    return out.select(*KEY, F.col("run").cast("long").alias("run"), F.col("sta").cast("long").alias("sta"), "end", F.col("genotype").cast("int").alias("genotype"), "markernum_acc", "n_markers")
