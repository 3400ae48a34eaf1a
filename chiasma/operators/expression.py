"""Marker genes: best hits and their expression in real cells."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from chiasma.operators.sets import member_or_all


def best_hits(hits: DataFrame, top: int, most: float = 1e-10) -> DataFrame:
    """(marker, gene, evalue, rank): per marker and gene the best hit, then the marker's `top` best genes. Ties go to the
    earlier line (column line)."""
    h = hits.where(F.col("evalue") <= most)
    one = h.groupBy("marker", "gene").agg(F.min(F.struct("evalue", "line")).alias("b")).select("marker", "gene", "b.evalue", "b.line")
    rank = F.row_number().over(Window.partitionBy("marker").orderBy("evalue", "line"))
    return one.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top).drop("line")


def scaffold(gene):
    """The scaffold in a gene's name (`_scaffold_33_000020` gives `_scaffold_33`); other names as they are."""
    p = F.split(gene, "_")
    return F.when(F.get(p, F.lit(1)) == "scaffold", F.concat_ws("_", F.slice(p, 1, 3))).otherwise(gene)


def marker_expression(markers: DataFrame, matrix: DataFrame, cells: DataFrame, on_chrom: list[str] | None = None) -> DataFrame:
    """Per marker gene: whether the matrix has it, cells that express it, reads, share of cells in percent, mean over
    expressing cells; both to two digits. An empty or missing list of chromosomes counts every gene as on one."""
    n_cells = cells.agg(F.count("*").alias("n_cells"))
    own = matrix.join(cells.select("barcode"), "barcode", "left_semi").groupBy("gene").agg(F.count_if(F.col("n") > 0).alias("expr"), F.sum("n").alias("umi"))
    known = matrix.select("gene").distinct().withColumn("in_matrix", F.lit(True))
    out = markers.join(known, "gene", "left").join(own, "gene", "left").join(F.broadcast(n_cells))
    expr, umi = F.coalesce("expr", F.lit(0)), F.coalesce("umi", F.lit(0))
    place = member_or_all(F.col("scaffold"), on_chrom or [])
    return out.select(
        *markers.columns, F.coalesce("in_matrix", F.lit(False)).alias("in_matrix"), place.alias("on_chrom"), expr.alias("n_cells_expr"), umi.alias("total_umi"),
        F.bround(F.coalesce(F.try_divide(expr * 100.0, F.col("n_cells")), F.lit(0.0)), 2).alias("pct"), F.bround(F.coalesce(F.try_divide(umi, expr), F.lit(0.0)), 2).alias("mean_expr"))


def off_chromosome(table: DataFrame) -> DataFrame:
    """Markers none of whose hits is on a chromosome, with the sorted scaffolds that they hit."""
    g = table.groupBy("marker").agg(F.bool_or("on_chrom").alias("any"), F.array_sort(F.collect_set("scaffold")).alias("scaffolds"))
    return g.where(~F.col("any")).select("marker", F.concat_ws(",", "scaffolds").alias("scaffolds"))
