"""What the operators of this subpackage share: the shared folder, written tables and word rules."""

from __future__ import annotations

import functools

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chiasma.session import delete, scratch

#: A word is a run of characters other than space and the ASCII controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, every other character as it is."""
    return F.translate(c, UPPER, LOWER)


def shared_dir(spark: SparkSession) -> str:
    """A new folder in the one that driver and executors share."""
    return scratch(spark)


def written(df: DataFrame, name: str = "table") -> DataFrame:
    """df as a table in the shared folder, read again: lineage ends there, and a lost executor costs nothing."""
    path = f"{shared_dir(df.sparkSession)}/{name}"
    df.write.option("compression", "zstd").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    return out


def dropped(*tables: DataFrame) -> None:
    """Deletes written tables of which all that is read has been."""
    for df in tables:
        delete(df.sparkSession.sparkContext, df.__dict__["_written"])


def repeated(df: DataFrame, times: str, most: int = 4096) -> DataFrame:
    """df with each row as often as its column `times` (a long, 1 at least) says; no array grows with that number."""
    t, outer = F.col(times), F.col("_outer")
    steps = df.withColumn("_outer", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((t - 1) / (most * most)))))
    steps = steps.withColumn("_outer", F.explode(F.sequence(outer * most, F.least(outer * most + most - 1, F.floor((t - 1) / most)))))
    return steps.withColumn("_inner", F.explode(F.sequence(outer * most, F.least(outer * most + most, t) - 1))).drop("_outer", "_inner")


def in_file_order(docs: DataFrame) -> tuple[DataFrame, str]:
    """docs with a further long column, and its name: it ascends as rows stand in the files that docs is read from, by file
    name and place. docs that are not read from files are written first, partition after partition."""
    if not docs.inputFiles():
        docs = written(docs, "in_order")
    name = "_place"
    while name in docs.columns:
        name += "_"
    m, spark = docs.metadataColumn("_metadata"), docs.sparkSession
    files = sorted(f.rsplit("/", 1)[-1] for f in docs.inputFiles())
    rank = F.broadcast(spark.createDataFrame(list(enumerate(files)), f"{name}_rank long, {name}_file string"))  # a row for each file
    placed = docs.select(*[F.col(f"`{c}`") for c in docs.columns], m["file_name"].alias(f"{name}_own"), m["row_index"].alias(name))
    placed = placed.join(rank, F.col(f"{name}_own") == F.col(f"{name}_file")).withColumn(name, F.shiftleft(f"{name}_rank", 40) + F.col(name))
    return placed.select(*[F.col(f"`{c}`") for c in docs.columns], name), name


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def tidy(run):
    """An Arrow mapper that gives a Python worker's free memory back before and after a task, since workers live on and
    serve other stages."""

    @functools.wraps(run)
    def mapper(batches):
        _release()
        try:
            yield from run(batches)
        finally:
            _release()

    return mapper


def _release() -> None:
    import ctypes
    import gc

    import pyarrow as pa

    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc alone has it
    if trim:
        trim(0)
