"""Reads to genes. A read belongs to a gene as a spliced molecule (Gene) where all its blocks fit one of the gene's
transcripts, exon by exon, or as any molecule of it (GeneFull) where they lie within its body; to none where they fit several.

Candidates meet by equality: a gene is dealt to the bins of its body, a read to the bin in which its first block begins,
and what is dealt is one row for each bin with all its transcripts, so the join gives each read one row and no shuffle by read
follows. Bins with very many reads are dealt with salts (intervals.dealt). CIGARs and exons are compared by column, a batch of
reads at a time."""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from chiasma.functions import text as T
from chiasma.operators import intervals as I

BLOCKS = "array<struct<start: bigint, end: bigint>>"


OPS = re.compile("([0-9]+)([MDN=X])")


@lru_cache(1 << 16)
def _offsets(cigar: str) -> tuple:
    """First and last places from the read's start of each stretch of reference that a CIGAR covers, one after another."""
    out, first, at = [], 0, 0
    for n, op in OPS.findall(cigar):
        if op == "N":
            out += [first, at - 1] if at > first else []
            first = at + int(n)
        at += int(n)
    return (*out, first, at - 1) if at > first else tuple(out)


def _lengths(lists) -> np.ndarray:
    return pc.list_value_length(lists).fill_null(0).to_numpy().astype(np.int64)


def _ends(spans) -> tuple[np.ndarray, np.ndarray]:
    """start and end of (start, end), missing ones such that nothing fits them."""
    return tuple(pc.struct_field(spans, c).fill_null(v).to_numpy() for c, v in (("start", np.iinfo(np.int64).max), ("end", np.iinfo(np.int64).min)))


def _within(n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For owners with n elements each: every element's owner, and its place in it."""
    owner = np.repeat(np.arange(len(n)), n)
    return owner, np.arange(len(owner)) - (np.cumsum(n) - n)[owner]


def _blocks(start: pa.Array, cigar: pa.Array) -> pa.Array:
    """Each CIGAR of a batch is taken apart once."""
    own = cigar.dictionary_encode()
    offsets = [_offsets(c) for c in own.dictionary.to_pylist()]
    flat, n = np.array([x for o in offsets for x in o], dtype=np.int64).reshape(-1, 2), np.array([len(o) // 2 for o in offsets], dtype=np.int64)
    missing = pc.or_(start.is_null(), cigar.is_null()).to_numpy(zero_copy_only=False)
    at, which = np.flatnonzero(~missing), own.indices.fill_null(0).to_numpy()
    size = np.zeros(len(start), dtype=np.int64)
    size[at] = n[which[at]]
    row, k = _within(size)
    spans = flat[(np.cumsum(n) - n)[which[row]] + k] + start.fill_null(0).to_numpy()[row, None]
    ends = pa.array(np.concatenate([[0], np.cumsum(size)]), pa.int32())
    return pa.ListArray.from_arrays(ends, pa.StructArray.from_arrays([pa.array(spans[:, 0]), pa.array(spans[:, 1])], ["start", "end"]), mask=pa.array(missing))


def _once(f, returned):
    """A function of whole columns that a filter on its results does not make run again."""
    return F.arrow_udf(f, returned).asNondeterministic()


def blocks(start: Column, cigar: Column) -> Column:
    """The stretches of reference that a read covers, both ends included: matches, mismatches and deletions between skips
    (N). Clips, pads and insertions cover nothing; a read that covers nothing has no blocks."""
    return _once(_blocks, BLOCKS)(start.cast("long"), cigar)


def first_base(start: Column, cigar: Column) -> Column:
    """Where the first block begins, null without blocks: at the start, but for skips in front of it."""
    lead = F.regexp_extract(cigar, "^(.*?)[0-9]*[1-9][0-9]*[MD=X]", 1)
    skipped = F.aggregate(F.regexp_extract_all(lead, F.lit("([0-9]+)N"), F.lit(1)), F.lit(0).cast("long"), lambda a, n: a + n.cast("long"))
    return F.when(cigar.rlike("[1-9][0-9]*[MD=X]"), start + F.when(lead.contains("N"), skipped).otherwise(0))


def transcripts(exons: DataFrame) -> DataFrame:
    """(gene, chrom, strand, start, end, exons in order) of each transcript, from (gene, transcript, chrom, strand, start,
    end), both ends included. A transcript is bounded by its gene."""
    own = F.array_sort(F.collect_set(F.struct(F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))))
    return exons.groupBy("gene", "transcript", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"), own.alias("exons")).drop("transcript")


def bodies(exons: DataFrame) -> DataFrame:
    """(gene, chrom, strand, start, end) from the first base of a gene's exons to the last."""
    return exons.groupBy("gene", "chrom", "strand").agg(F.min("start").alias("start"), F.max("end").alias("end"))


def _fitting(blocks: pa.Array, near: pa.Array) -> pa.Array:
    """The only gene of which a transcript near a read fits it: the k-th of the read's blocks lies in the k-th exon from the
    first one on that holds the first block, and ends where an exon ends wherever it is followed by a skip, and begins where
    one begins after it. Pairs of reads and transcripts are columns, as are their blocks and exons."""
    models, n_blocks = near.flatten(), _lengths(blocks)
    exons = pc.struct_field(models, "exons")
    n_exons, (bs, be), (es, ee) = _lengths(exons), _ends(blocks.flatten()), _ends(exons.flatten())
    read, _ = _within(_lengths(near))
    b0, e0 = (np.cumsum(n_blocks) - n_blocks)[read], np.cumsum(n_exons) - n_exons
    pair, k = _within(n_exons)
    hold = np.flatnonzero((es <= bs[b0[pair]]) & (ee >= be[b0[pair]]))[::-1]
    first = np.full(len(read), -1)
    first[pair[hold]] = k[hold]  # of several the last written, which is the first exon
    fit = first >= 0
    pair, k = _within(np.where(fit, n_blocks[read], 0))
    there = first[pair] + k < n_exons[pair]
    b, e = b0[pair] + k, e0[pair] + np.where(there, first[pair] + k, 0)
    good = there & (es[e] <= bs[b]) & (ee[e] >= be[b]) & ((k == 0) | (es[e] == bs[b])) & ((k == n_blocks[read[pair]] - 1) | (ee[e] == be[b]))
    fit[pair[~good]] = False
    genes = pc.struct_field(models, "gene").dictionary_encode()
    code, at = genes.indices.fill_null(-1).to_numpy(), np.flatnonzero(fit)
    one = np.full(len(near), -1, dtype=np.int32)
    one[read[at]] = code[at]
    one[read[at][code[at] != one[read[at]]]] = -1
    return genes.dictionary.take(pa.array(one, mask=one < 0))


def assigned(reads: DataFrame, models: DataFrame, strand: str = "Reverse", width: int = 1 << 14, most: int = I.HOT) -> DataFrame:
    """reads (chrom, start, cigar, strand and others) with gene: the only gene of which a model fits, null for none or several.
    Of transcripts() all blocks have to fit the exons, of bodies() to lie between the ends. strand: whether reads come from the
    gene's strand (Forward), the other (Reverse) or either (Unstranded). A bin's row holds the models that meet it, which an
    annotation bounds, not the reads."""
    return assigned_by(reads, {"gene": models}, strand, width, most)


def assigned_by(reads: DataFrame, models: dict[str, DataFrame], strand: str = "Reverse", width: int = 1 << 14, most: int = I.HOT) -> DataFrame:
    """reads with a column for each of several sets of models, as in assigned(); reads are dealt and taken apart once."""
    same = lambda m: F.lit(True) if strand == "Unstranded" else (m["strand"] == F.col("strand")) == (strand == "Forward")
    by = None
    for i, m in enumerate(models.values()):
        span = F.sequence(F.floor(F.col("start") / width), F.floor(F.col("end") / width))
        own = m.select("chrom", F.explode(span).alias("_bin"), F.struct("gene", "strand", "start", "end", *(["exons"] if "exons" in m.columns else [])).alias(f"_m{i}"))
        by = own if by is None else by.unionByName(own, allowMissingColumns=True)
    by = by.groupBy("chrom", "_bin").agg(*[F.collect_list(f"_m{i}").alias(f"_m{i}") for i in range(len(models))])
    r = reads.withColumn("_bin", F.floor(first_base(F.col("start"), F.col("cigar")) / width)).withColumn("_blocks", blocks(F.col("start"), F.col("cigar")))
    left, right, on = I.dealt(r, by, ["chrom", "_bin"], most)
    first, last = F.get("_blocks", F.lit(0))["start"], F.try_element_at("_blocks", F.lit(-1))["end"]
    near = []  # few of a bin's models, which go no further
    for i, m in enumerate(models.values()):
        x = F.filter(f"_m{i}", lambda x: same(x) & (x["start"] <= first) & (x["end"] >= last))
        kept = (lambda x: F.struct(x["gene"].alias("gene"), x["exons"].alias("exons"))) if "exons" in m.columns else (lambda x: x["gene"])
        near.append(F.transform(x, kept).alias(f"_n{i}"))
    own = [c for c in reads.columns if c not in models]
    out = left.join(right, on, "left").select(*[F.col(f"`{c}`") for c in own], "_blocks", *near)
    for i, (name, m) in enumerate(models.items()):
        if "exons" in m.columns:
            out = out.withColumn(name, _once(_fitting, m.schema["gene"].dataType)(F.col("_blocks"), F.col(f"_n{i}")))
        else:
            genes = F.array_distinct(f"_n{i}")
            out = out.withColumn(name, F.when(F.size(genes) == 1, F.get(genes, F.lit(0))))
    return out.select(*own, *models)


def exons_of(annotation: DataFrame) -> DataFrame:
    """Exon rows of readers.gff() with gene and transcript from their attributes: gene_id and transcript_id of a GTF, or Parent
    (its transcript) and, by way of the transcript's row, that one's Parent (its gene) of a GFF3."""
    a, kind = F.col("attributes"), F.col("type")
    rows = annotation.where(kind == "exon").withColumns({"transcript": F.coalesce(T.attribute(a, "transcript_id"), T.gff3_attribute(a, "Parent")), "gene": T.attribute(a, "gene_id")})
    owners = annotation.where(kind.isin("mRNA", "transcript", "lnc_RNA")).select(T.gff3_attribute(a, "ID").alias("transcript"), T.gff3_attribute(a, "Parent").alias("_gene"))
    owners = owners.where("transcript IS NOT NULL").groupBy("transcript").agg(F.min("_gene").alias("_gene"))
    out = rows.join(owners, "transcript", "left").withColumn("gene", F.coalesce("gene", "_gene", "transcript"))
    return out.select("gene", "transcript", "chrom", "strand", "start", "end")
