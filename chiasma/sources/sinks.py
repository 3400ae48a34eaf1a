"""Sinks: tables, lists and partitioned writes. All overwrite, so running again gives the same files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.sources import block_files as B
from chiasma.sources import cell_files as C


def tsv(df: DataFrame, path: str, header: bool = True) -> None:
    """Tab-separated without quotes; nulls as NA."""
    df.write.mode("overwrite").csv(path, sep="\t", header=header, quote="", nullValue="NA", emptyValue="")


def bed(df: DataFrame, path: str) -> None:
    tsv(df, path, header=False)


def line_list(df: DataFrame, column: str, path: str) -> None:
    df.select(F.col(column).cast("string").alias("value")).write.mode("overwrite").text(path)


def per_cell(df: DataFrame, path: str, key: str = "barcode") -> None:
    """A folder for each cell, which replaces one file per cell. Rows are dealt by ranges of cell and place, so a cell has
    few files and a large one is written by several tasks."""
    C.write(df, path, key, "chrom", "pos")


def replaced_partitions(df: DataFrame, path: str, *keys: str) -> None:
    """Only the partitions that df has are replaced."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*keys).parquet(path)


def indexed(df: DataFrame, path: str, chrom: str = "chrom", pos: str = "pos") -> None:
    """Parquet in (chrom, pos) order over range partitions: row-group statistics serve region queries."""
    df.repartitionByRange(chrom, pos).sortWithinPartitions(chrom, pos).write.mode("overwrite").parquet(path)


def packed_lines(df: DataFrame, path: str, column: str = "value") -> None:
    """A block-compressed text file for each task, lines in the order of its rows."""
    B.write(df.select(F.col(column).cast("string").alias("value")), path, "text")


def alignments(df: DataFrame, path: str, references: list[tuple[str, int]]) -> None:
    """A binary alignment file for each task, from columns named as reader bam() gives them; references: (name, size)."""
    B.write(df, path, "alignments", references)


def report(row: DataFrame) -> DataFrame:
    """(metric, value) of a one-row summary, as text."""
    return row.select(F.inline(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(f"`{c}`").cast("string").alias("value")) for c in row.columns])))


def params_log(spark: SparkSession, params: dict, path: str | None = None) -> DataFrame:
    """One row with a column for each parameter, as text, written beside the results that they led to where a path is given."""
    row = spark.range(1).select(*[F.lit(None if v is None else str(v)).cast("string").alias(k) for k, v in params.items()])
    if path:
        row.coalesce(1).write.mode("overwrite").json(path)
    return row


def params_logs(resolved: DataFrame, path: str) -> None:
    """The resolved parameters (sample_id, section, key, value) of all samples, a JSON line for each, values as text."""
    resolved.select(F.col("sample_id").alias("sample"), F.concat_ws(".", "section", "key").alias("parameter"), F.col("value").cast("string").alias("value")).write.mode("overwrite").json(path)


def barcode_lists(lists: DataFrame, path: str) -> None:
    """(list, barcode) as a folder of lines for each list, the list `called` among them."""
    lists.select("list", F.col("barcode").cast("string").alias("value")).write.mode("overwrite").partitionBy("list").text(path)


def text_report(report: DataFrame, path: str, width: int = 40) -> None:
    """(section, metric, value) as one text file for each section: the metric padded to a width, then the value."""
    line = F.concat(F.rpad("metric", width, " "), F.col("value"))
    report.select("section", line.alias("value")).coalesce(1).write.mode("overwrite").partitionBy("section").text(path)
