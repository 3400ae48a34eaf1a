"""Parameters, sample sheets and reference choices."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def resolve(wanted: DataFrame, params: DataFrame, default: str = "default") -> DataFrame:
    """wanted (section, species, key) with value: the species' own, else the section's default, else an error."""
    own = params.select("section", "species", "key", F.col("value").alias("_own"))
    base = params.where(F.col("species") == default).select("section", "key", F.col("value").alias("_base"))
    j = wanted.join(own, ["section", "species", "key"], "left").join(base, ["section", "key"], "left")
    missing = F.raise_error(F.concat(F.lit("no value for "), F.col("section"), F.lit("."), F.col("key")))
    return j.select(*wanted.columns, F.coalesce("_own", "_base", missing.cast("double")).alias("value"))


#: Barcode and molecule lengths, whitelist and strand of the read chemistries.
CHEMISTRIES = {
    "10x_5p_v1": (16, 10, "whitelist_5p_v1", "Reverse"),
    "10x_3p_v4": (16, 12, "whitelist_3p_v4", "Reverse"),
}


def with_chemistry(samples: DataFrame) -> DataFrame:
    """samples with cb_len, umi_len, whitelist, strand; an unknown chemistry is an error."""
    out = F.raise_error(F.concat(F.lit("unknown chemistry "), F.coalesce("chemistry", F.lit("null")))).cast("struct<cb_len: int, umi_len: int, whitelist: string, strand: string>")
    for name, (cb, umi, whitelist, strand) in CHEMISTRIES.items():
        v = F.struct(F.lit(cb).alias("cb_len"), F.lit(umi).alias("umi_len"), F.lit(whitelist).alias("whitelist"), F.lit(strand).alias("strand"))
        out = F.when(F.col("chemistry") == name, v).otherwise(out)
    return samples.withColumn("_c", out).select(*samples.columns, "_c.*")


def cdna_reads(samples: DataFrame) -> DataFrame:
    """samples with cdna: the column that cdna_read (R2 or R3) names."""
    bad = F.raise_error(F.concat(F.lit("cdna_read must be R2 or R3, not "), F.coalesce("cdna_read", F.lit("null"))))
    return samples.withColumn("cdna", F.when(F.col("cdna_read") == "R2", F.col("scrna_r2")).when(F.col("cdna_read") == "R3", F.col("scrna_r3")).otherwise(bad.cast("string")))


def lanes(samples: DataFrame, first: str, second: str, sep: str = ";") -> DataFrame:
    """(sample_id, lane, first, second): paired files of every lane, blank ones left out; unequal numbers are an error."""
    a, b = (F.filter(F.transform(F.split(c, sep), lambda x: F.trim(x)), lambda x: x != "") for c in (first, second))
    same = F.when(F.size(a) == F.size(b), F.lit(True)).otherwise(F.raise_error(F.concat(F.lit("unequal lanes of "), F.col("sample_id"))).cast("boolean"))
    return samples.where(same).select("sample_id", F.posexplode(F.arrays_zip(a.alias("a"), b.alias("b"))).alias("lane", "x")).select("sample_id", "lane", F.col("x.a").alias(first), F.col("x.b").alias(second))


def marker_reference(samples: DataFrame, flag: str = "is_marker_reference") -> DataFrame:
    """(species, sample_id): the first sample of each species flagged yes, in order of column line."""
    return samples.where(F.col(flag) == "yes").groupBy("species").agg(F.min_by("sample_id", "line").alias("sample_id"))


def marker_samples(samples: DataFrame) -> DataFrame:
    """(sample_id, marker_sample): the reference of each sample's species; a species without one is an error."""
    ref = marker_reference(samples).select("species", F.col("sample_id").alias("_r"))
    missing = F.raise_error(F.concat(F.lit("no marker reference for species "), F.coalesce("species", F.lit("null")))).cast("string")
    return samples.join(ref, "species", "left").select("sample_id", F.coalesce("_r", missing).alias("marker_sample"))


def dense_ids(names: DataFrame, present: DataFrame, key: str = "name", order: str = "line") -> DataFrame:
    """names that occur in present, numbered internal_id from 1 in their order: an assembly's few sequences."""
    kept = names.join(present.select(F.col(key)).distinct(), key, "left_semi")
    return kept.withColumn("internal_id", F.row_number().over(Window.orderBy(order)).cast("long"))
