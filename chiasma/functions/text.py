"""Column functions over names, attributes and paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def attribute(attributes: Column, key: str) -> Column:
    """The value of KEY "value" in a GTF attribute column; null where absent."""
    return F.nullif(F.regexp_extract(attributes, rf'(?:^|[; ]){key} "([^"]*)"', 1), F.lit(""))


def gff3_attribute(attributes: Column, key: str) -> Column:
    """The value of KEY=value in a GFF3 attribute column; null where absent."""
    return F.nullif(F.regexp_extract(attributes, rf"(?:^|;\s*){key}=([^;]*)", 1), F.lit(""))


def with_attribute(attributes: Column, key: str, value: Column) -> Column:
    """attributes with KEY's value replaced."""
    return F.regexp_replace(attributes, F.lit(rf'{key} "[^"]*"'), F.concat(F.lit(f'{key} "'), value, F.lit('"')))


def gene_and_transcript(attributes: Column) -> Column:
    """Only gene_id and transcript_id, in this order, each with its semicolon."""
    one = lambda k: F.concat(F.lit(f'{k} "'), attribute(attributes, k), F.lit('";'))
    return F.concat_ws(" ", one("gene_id"), one("transcript_id"))


def transcript_id(feature: Column, attributes: Column) -> Column:
    """mRNA rows take ID, others Parent; where that is missing gene_id.1, else what is there."""
    own = F.when(feature == "mRNA", gff3_attribute(attributes, "ID")).otherwise(gff3_attribute(attributes, "Parent"))
    return F.coalesce(own, F.concat(attribute(attributes, "gene_id"), F.lit(".1")), attribute(attributes, "transcript_id"))


def without_prefix(name: Column, prefix: str) -> Column:
    return F.when(name.startswith(prefix), F.substring(name, len(prefix) + 1, 1 << 30)).otherwise(name)


def without_transcript_suffix(name: Column) -> Column:
    """Without a final .1 to .5."""
    return F.regexp_replace(name, r"\.[1-5]$", "")


def product(attributes: Column) -> Column:
    """The first field of an attribute column without Name=."""
    return F.regexp_replace(F.split(attributes, ";")[0], "Name=", "")


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def dirname(path: Column) -> Column:
    return F.regexp_replace(path, "/[^/]*$", "")


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")
